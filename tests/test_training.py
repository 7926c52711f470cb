"""Training prep, splits and evaluation against brute force."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.operators import training as TN
from riskspark.sources import fixtures as FX
from tests.conftest import SF001, SF01


def _u(i):
    return int(hashlib.md5(f"42-{i}".encode()).hexdigest()[:8], 16)


def _prep(spark, sf):
    return TN.train_prep(FX.posts(spark, sf).join(FX.training_labels(spark, sf), "post_id", "left"))


@pytest.mark.parametrize("fn", ["split_stratified", "split_labels"])
def test_stratified_split_is_exact(spark, fn):
    prep = _prep(spark, SF01)
    got = {r.post_id: r.split for r in getattr(TN, fn)(prep, "post_id").collect()}
    rows = prep.select("post_id", "label").collect()
    by = {}
    for r in rows:
        by.setdefault(r.label, []).append(r.post_id)
    for lab, ids in by.items():
        ids.sort(key=lambda i: (_u(i), i))
        k = math.ceil(0.2 * len(ids))
        assert {i for i in ids if got[i] == "test"} == set(ids[:k]), lab


def test_plain_split(spark):
    df = spark.range(200).withColumnRenamed("id", "post_id")
    got = {r.post_id: r.split for r in TN.split_plain(df, "post_id").collect()}
    assert all((got[i] == "test") == (_u(i) < 0.2 * 2 ** 32) for i in range(200))


def test_min_rows_guard(spark):
    with pytest.raises(TN.InsufficientDataError):
        TN.require_rows(_prep(spark, SF001))  # 87 labelled documents at sf0.001
    assert TN.require_rows(_prep(spark, SF01)) >= 100


def test_label_column_choice_is_table_level(spark):
    df = spark.createDataFrame([(1, "some long enough text", None, "HIGH")],
                               "post_id long, caption string, true_label string, mm_risk_level string")
    assert TN.pick_label_col(df) == "true_label"
    assert TN.train_prep(df).count() == 0  # true_label present -> NULL row dropped, no fallback
    df2 = df.drop("true_label")
    assert TN.train_prep(df2).first().label == "HIGH"


def test_text_and_label_normalisation(spark):
    df = spark.createDataFrame([(1, "See http://x.y/z @Ali #Sad  NOW more", " high "), (2, "0123456789", "LOW"),
                                (3, "long enough text here", "unknown")],
                               "post_id long, caption string, true_label string")
    got = TN.train_prep(df).collect()
    assert [(r.post_id, r.text, r.label) for r in got] == [(1, "see now more", "HIGH")]


def test_train_prep_cleans_each_text_once(spark):
    """The length rule must not be inlined into a pushed-down filter: no
    Filter in the plan may contain the cleaning regexes, and the cleaning
    runs after the join with the labels."""
    plan = _prep(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    filters = [ln for ln in plan.splitlines() if "Filter" in ln]
    assert filters and not any("regexp_replace" in ln for ln in filters)
    assert plan.count("regexp_replace(regexp_replace(regexp_replace(lower(coalesce(transcript") == 1


def _pred(spark, pairs):
    return spark.createDataFrame(pairs, "label string, pred string")


def test_confusion_and_report_brute_force(spark):
    pairs = [("HIGH", "HIGH"), ("HIGH", "LOW"), ("LOW", "LOW"), ("LOW", "LOW"), ("MEDIUM", "HIGH"), ("LOW", "MEDIUM")]
    conf = {r.label: (r.pred_HIGH, r.pred_LOW, r.pred_MEDIUM) for r in TN.confusion(_pred(spark, pairs)).collect()}
    assert conf == {"HIGH": (1, 1, 0), "LOW": (0, 2, 1), "MEDIUM": (1, 0, 0)}
    rep = {r["class"]: r for r in TN.class_report(_pred(spark, pairs)).collect()}
    for c in rules.LEVELS:
        tp = sum(1 for a, b in pairs if a == c == b)
        prd = sum(1 for _, b in pairs if b == c)
        sup = sum(1 for a, _ in pairs if a == c)
        p = tp / prd if prd else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        assert (rep[c].precision, rep[c].recall, rep[c].f1, rep[c].support) == \
            (pytest.approx(p, abs=1e-6), pytest.approx(r, abs=1e-6), pytest.approx(f, abs=1e-6), sup)
    assert rep["accuracy"].f1 == pytest.approx(3 / 6, abs=1e-6)


def test_pipeline_v1_invariants_and_persistence(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from riskspark.operators import scoring as SC

    d = TN.train_prep_v1(FX.posts(spark, SF01))
    model = TN.pipeline_v1(text_col="full_text", label_col="risk_label", trees=5, max_depth=5).fit(d)
    assert TN.fitted_labels(model) == sorted(TN.fitted_labels(model))  # alphabetical class order
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    probe = spark.createDataFrame([(1, "i want to die. nobody cares. kill myself"), (2, "funny video lol hahaha")],
                                  "post_id long, full_text string")
    out = TN.rf_probability_columns(again, probe, "full_text")
    for r in out.select("__rf_probs", SC.rf_score(F.col("__rf_probs")[0], F.col("__rf_probs")[1],
                                                   F.col("__rf_probs")[2]).alias("s")).collect():
        assert sum(r["__rf_probs"]) == pytest.approx(1.0)
        assert 0.1 - 1e-9 <= r.s <= 1.0 + 1e-9


def test_report_edge_cases_brute_force(spark):
    """NULL and unknown labels or predictions, and a class that never
    occurs: support counts true labels, predicted totals count predictions,
    whatever the other side is."""
    pairs = [("HIGH", None), ("HIGH", "HIGH"), (None, "HIGH"), ("odd", "LOW"), ("LOW", "odd"), ("LOW", "LOW")]
    conf = {r.label: (r.pred_HIGH, r.pred_LOW, r.pred_MEDIUM) for r in TN.confusion(_pred(spark, pairs)).collect()}
    assert conf == {"HIGH": (1, 0, 0), "LOW": (0, 1, 0), "MEDIUM": (0, 0, 0)}
    rep = {r["class"]: r for r in TN.class_report(_pred(spark, pairs)).collect()}
    per = {}
    for c in rules.LEVELS:
        tp = sum(1 for a, b in pairs if a == c == b)
        prd = sum(1 for _, b in pairs if b == c)
        sup = sum(1 for a, _ in pairs if a == c)
        p = tp / prd if prd else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * tp / (sup + prd) if sup + prd else 0.0
        per[c] = (p, r, f, sup)
        assert (rep[c].precision, rep[c].recall, rep[c].f1, rep[c].support) == \
            (pytest.approx(p, abs=1e-6), pytest.approx(r, abs=1e-6), pytest.approx(f, abs=1e-6), sup)
    n = sum(v[3] for v in per.values())
    assert rep["accuracy"].support == n == 4
    assert rep["accuracy"].f1 == pytest.approx(2 / 4, abs=1e-6) and rep["accuracy"].precision is None
    assert rep["macro avg"].recall == pytest.approx(sum(v[1] for v in per.values()) / 3, abs=1e-6)
    assert rep["weighted avg"].f1 == pytest.approx(sum(v[2] * v[3] for v in per.values()) / n, abs=1e-6)


def test_vector_stages_match_their_formulas(spark):
    import math

    from pyspark.ml.linalg import Vectors
    from riskspark.operators.vectors import SmoothIdf, SublinearTf

    df = spark.createDataFrame([(1, Vectors.sparse(3, {0: 4.0, 1: 1.0})), (2, Vectors.sparse(3, {0: 1.0})),
                                (3, Vectors.sparse(3, {}))], ["id", "tf"])
    logged = SublinearTf(inputCol="tf", outputCol="l").transform(df)
    out = {r.id: list(r.o.toArray()) for r in
           SmoothIdf(inputCol="l", outputCol="o").fit(logged).transform(logged).collect()}
    idf = [math.log(4 / 3) + 1, math.log(4 / 2) + 1]
    assert out[1] == pytest.approx([(1 + math.log(4)) * idf[0], idf[1], 0.0])
    assert out[2] == pytest.approx([idf[0], 0.0, 0.0]) and out[3] == [0.0, 0.0, 0.0]


PROBES = ["i want to die. nobody cares. kill myself", "funny video lol hahaha", "", "today was a good day"]


def test_pipeline_v2_probes_and_model_key(spark):
    from riskspark.operators import scoring as SC

    posts = FX.posts(spark, SF01)
    prep = TN.train_prep(posts.join(FX.training_labels(spark, SF01), "post_id", "left"))
    train = TN.balanced_weights(prep)
    pipe = TN.pipeline_v2(trees=3, max_depth=4)
    assert TN.data_key(pipe, train) == TN.data_key(TN.pipeline_v2(trees=3, max_depth=4), train.repartition(3))
    assert TN.data_key(pipe, train) != TN.data_key(pipe, train.limit(50))
    assert TN.data_key(pipe, train) != TN.data_key(TN.pipeline_v2(trees=4, max_depth=4), train)
    model = TN.fit_or_load(pipe, train)
    probe = spark.createDataFrame(list(enumerate(PROBES)), "post_id long, text string")
    out = TN.rf_probability_columns(model, probe, "text", nnz="nnz")
    p = [F.col("__rf_probs")[i] for i in range(3)]
    rows = out.select("post_id", "nnz", "__rf_probs", SC.rf_score(*p).alias("s")).orderBy("post_id").collect()
    assert rows[2].nnz == 0 and len(rows) == len(PROBES)
    for r in rows:
        assert sum(r["__rf_probs"]) == pytest.approx(1.0)
        assert 0.1 - 1e-9 <= r.s <= 1.0 + 1e-9


def test_char_grams_of_the_pipeline_match_the_long_form(spark):
    from collections import Counter

    from riskspark.operators import features as FE

    texts = ["a bb ccc  dddd", "  Ein\u00a0\u00dcber Wort\n", "\U0001F600ab x\U0001F600 \U0001F600", "", "abcdefg"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    long_form = {}
    for r in FE.term_counts(df, "doc", "text", "char").collect():
        long_form.setdefault(r.doc, {})[r.term] = r.tf
    got = {r.doc: Counter(r.g) for r in df.selectExpr("doc", TN._char_sql("text") + " AS g").collect()}
    assert {k: dict(v) for k, v in got.items() if v} == long_form
