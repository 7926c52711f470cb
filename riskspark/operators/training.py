"""Training data, splits, evaluation and the text-forest pipelines.

Splits are deterministic functions of (seed, id): ``u`` = the first 32 bits
of md5("<seed>-<id>").  The plain split takes ``u < share * 2^32`` (no
shuffle at all).  The stratified split takes exactly ceil(share * n_label)
rows per label -- the ones with the smallest (u, id) -- without a window
over a whole label (three labels would mean three tasks): a per-label
histogram of ``u`` over 65,536 buckets (partial aggregation) and a running
count over it find the bucket holding the cut (one row per label reaches
the driver), and only that one bucket per label is ranked.

Evaluation (confusion matrix, per-class report) is one global aggregation
of predictions to a single row of counts (true x predicted cells, support,
predicted totals), partial per task, so its only shuffle carries one row per
task; the report rows are column arithmetic on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import patterns as P
from riskspark.functions import text as X
from riskspark.operators.features import model_text
from riskspark.schemas import available_columns

BUCKETS = 65536
TWO32 = 4294967296.0


class InsufficientDataError(ValueError):
    pass


def pick_label_col(df: DataFrame, priority=rules.LABEL_PRIORITY) -> str:
    """The first label column present in the table (a table-level choice,
    not a per-row coalesce)."""
    cols = available_columns(df, priority)
    if not cols:
        raise ValueError(f"no label column among {list(priority)}; present: {df.columns}")
    return cols[0]


def train_prep(df: DataFrame, id_col: str = "post_id", label_col: str | None = None,
               text_cols=rules.TRAIN_TEXT_COLS) -> DataFrame:
    """(id, text, label): cleaned merged text longer than 10 characters and a
    label in LOW / MEDIUM / HIGH (upper-cased, stripped)."""
    label_col = label_col or pick_label_col(df)
    label = F.upper(X.strip_ws(F.col(label_col).cast("string")))
    present = available_columns(df, text_cols)
    labelled = df.select(F.col(id_col), *present, label.alias("label")).filter(F.col("label").isin(*rules.LEVELS))
    # The length rule keeps the text in a 0- or 1-element array that is then
    # exploded.  A plain filter on length(text) would be pushed below the
    # projection (and below a join with the labels) with the whole cleaning
    # expression inlined, so every text would be cleaned twice, labelled or
    # not; here it is cleaned once, after the label filter.
    text = F.filter(F.array(model_text(labelled, text_cols)),
                    lambda t: F.length(t) > F.lit(rules.MIN_TEXT_CHARS))
    return labelled.select(F.col(id_col), F.explode(text).alias("text"), "label")


def require_rows(df: DataFrame, minimum: int = rules.MIN_TRAIN_ROWS) -> int:
    """Stop with a clear error when fewer than ``minimum`` usable rows."""
    n = df.count()
    if n < minimum:
        raise InsufficientDataError(f"only {n} usable training rows; at least {minimum} are needed")
    return n


def train_prep_v1(df: DataFrame, id_col: str = "post_id") -> DataFrame:
    """(id, full_text, risk_label): caption + " " + transcript (missing as
    ""), label from the 0-100 score by 70 / 40."""
    text = F.concat(F.coalesce(F.col("caption"), F.lit("")), F.lit(" "), F.coalesce(F.col("transcript"), F.lit("")))
    return df.select(id_col, text.alias("full_text"), N.percent_label("risk_yuzdesi").alias("risk_label"))


def hash_u32(id_col: str, seed: int = rules.SPLIT_SEED) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def split_plain(df: DataFrame, id_col: str, test_share: float = rules.SPLIT_TEST_SHARE,
                seed: int = rules.SPLIT_SEED) -> DataFrame:
    """Adds ``split`` = 'test' for u < share * 2^32, else 'train'."""
    u = hash_u32(id_col, seed).cast("double")
    return df.withColumn("split", F.when(u < F.lit(test_share * TWO32), F.lit("test")).otherwise(F.lit("train")))


def _cut_points(narrow: DataFrame, id_col: str, label_col: str, test_share: float) -> dict:
    """Per label, the (u, id) of the last test row, from a per-label
    histogram of u and a ranking inside the one bucket holding the cut."""
    # Per label, the running count over buckets finds the one bucket where the
    # k-th row lies; the histogram has at most 65,536 rows per label, and only
    # one row per label reaches the driver.
    hist = narrow.groupBy(label_col, "__b").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(label_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select(label_col, "__b", "n", F.sum("n").over(upto).alias("cum"),
                    F.ceil(F.lit(float(test_share)) * F.sum("n").over(Window.partitionBy(label_col))).alias("k"))
    crossing = h.filter((F.col("cum") >= F.col("k")) & (F.col("cum") - F.col("n") < F.col("k")))
    cut = {r[label_col]: (r["__b"], r["k"] - (r["cum"] - r["n"]))
           for r in crossing.select(label_col, "__b", "n", "cum", "k").collect()}
    cut = {lab: (b, r) for lab, (b, r) in cut.items() if r > 0}
    if not cut:
        return {}
    edge = None
    for lab, (b, _) in cut.items():
        cond = (F.col(label_col) == F.lit(lab)) & (F.col("__b") == F.lit(b))
        edge = cond if edge is None else (edge | cond)
    w = Window.partitionBy(label_col, "__b").orderBy("__u", id_col)
    ranked = narrow.filter(edge).withColumn("__r", F.row_number().over(w))
    want = None
    for lab, (b, r) in cut.items():
        c = (F.col(label_col) == F.lit(lab)) & (F.col("__r") == F.lit(r))
        want = c if want is None else (want | c)
    return {row[label_col]: (row["__u"], row[id_col])
            for row in ranked.filter(want).select(label_col, "__u", id_col).collect()}


def _is_test(thresholds: dict, id_col: str, label_col: str) -> Column:
    test = F.lit(False)
    for lab, (tu, tid) in thresholds.items():
        below = (F.col("__u") < F.lit(tu)) | ((F.col("__u") == F.lit(tu)) & (F.col(id_col) <= F.lit(tid)))
        test = F.when(F.col(label_col) == F.lit(lab), below).otherwise(test)
    return F.when(test, F.lit("test")).otherwise(F.lit("train"))


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("__u", hash_u32(id_col, seed)).withColumn("__b", F.floor(F.col("__u") / F.lit(BUCKETS)))


def split_stratified(df: DataFrame, id_col: str, label_col: str = "label",
                     test_share: float = rules.SPLIT_TEST_SHARE, seed: int = rules.SPLIT_SEED) -> DataFrame:
    """Adds ``split``: per label, the ceil(share * n_label) rows with the
    smallest (u, id) are 'test'.  All input columns are kept."""
    from pyspark import StorageLevel

    h = _hashed(df, id_col, seed)
    # the two counting passes need only (id, label, u); keep that narrow
    # projection for them and release it once the thresholds are known
    narrow = h.select(id_col, label_col, "__u", "__b").persist(StorageLevel.MEMORY_AND_DISK)
    thresholds = _cut_points(narrow, id_col, label_col, test_share)
    narrow.unpersist()
    return h.withColumn("split", _is_test(thresholds, id_col, label_col)).drop("__u", "__b")


def split_labels(df: DataFrame, id_col: str, label_col: str = "label",
                 test_share: float = rules.SPLIT_TEST_SHARE, seed: int = rules.SPLIT_SEED) -> DataFrame:
    """(id, label, split) of the same stratified split, for consumers that
    need no other column (evaluation).  The narrow (id, label, u) table is
    written once as a reliable checkpoint in the shared checkpoint folder,
    so the input (e.g. text cleaning) is computed once and the lineage is
    cut -- a lost executor does not send the job back to the raw input."""
    from riskspark.session import cut_lineage

    narrow = cut_lineage(_hashed(df, id_col, seed).select(id_col, label_col, "__u", "__b"))
    thresholds = _cut_points(narrow, id_col, label_col, test_share)
    return narrow.select(id_col, label_col, _is_test(thresholds, id_col, label_col).alias("split"))


def _eval_counts(pred: DataFrame, label_col: str, pred_col: str, labels) -> DataFrame:
    """One row of counts: ``c_i_j`` rows with true label i and prediction j,
    ``sup_i`` rows with true label i, ``prd_j`` rows predicted j (labels are
    indices into ``labels``).  A single global aggregation: each task emits
    one partial row, so one small exchange is the only shuffle, however
    many predictions there are."""
    t, p = F.col(label_col), F.col(pred_col)
    aggs = []
    for i, a in enumerate(labels):
        aggs.append(F.count_if(t == F.lit(a)).alias(f"sup_{i}"))
        aggs.append(F.count_if(p == F.lit(a)).alias(f"prd_{i}"))
        aggs += [F.count_if((t == F.lit(a)) & (p == F.lit(b))).alias(f"c_{i}_{j}") for j, b in enumerate(labels)]
    return pred.agg(*aggs)


def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
              labels=rules.LEVELS) -> DataFrame:
    """Dense confusion matrix: one row per true label (all labels), one
    BIGINT column ``pred_<LABEL>`` per predicted label."""
    rows = [F.struct(F.lit(a).alias("label"),
                     *[F.col(f"c_{i}_{j}").cast("bigint").alias(f"pred_{b}") for j, b in enumerate(labels)])
            for i, a in enumerate(labels)]
    return _eval_counts(pred, label_col, pred_col, labels).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def class_report(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
                 labels=rules.LEVELS, places: int = 6) -> DataFrame:
    """precision / recall / f1 / support per class, then accuracy, macro and
    weighted averages (0 where a ratio is 0/0)."""
    zero = F.lit(0.0)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(zero)
    per = []
    for i, _ in enumerate(labels):
        sup, prd = F.col(f"sup_{i}").cast("double"), F.col(f"prd_{i}").cast("double")
        tp = F.col(f"c_{i}_{i}").cast("double")
        per.append({"precision": safe(tp, prd), "recall": safe(tp, sup),
                    "f1": safe(F.lit(2.0) * tp, sup + prd), "sup": sup, "tp": tp})
    k = float(len(labels))
    total = lambda key: sum((m[key] for m in per[1:]), per[0][key])
    wsum = lambda key: sum((m[key] * m["sup"] for m in per[1:]), per[0][key] * per[0]["sup"])
    n = total("sup")

    def row(name, precision, recall, f1, support):
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    rows = [row(a, m["precision"], m["recall"], m["f1"], m["sup"]) for a, m in zip(labels, per)]
    none = F.lit(None).cast("double")
    rows += [
        row("accuracy", none, none, safe(total("tp"), n), n),
        row("macro avg", total("precision") / F.lit(k), total("recall") / F.lit(k), total("f1") / F.lit(k), n),
        row("weighted avg", safe(wsum("precision"), n), safe(wsum("recall"), n), safe(wsum("f1"), n), n),
    ]
    out = _eval_counts(pred, label_col, pred_col, labels).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    r = lambda x: N.round_half_away(F.col(x), places)
    return out.select("class", r("precision").alias("precision"), r("recall").alias("recall"),
                      r("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


# --- Spark ML pipelines ------------------------------------------------------

def _char_sql(col: str) -> str:
    """SQL of the char n-gram array (same definition as the long form): at
    every position of the words, padded with one space, the 3 to 5 characters
    from there on that lie within one padded word.  Patterns, not lambdas: a
    Python stage follows, and Spark does not plan one over lambdas."""
    padded = f"concat(' ', trim(regexp_replace(lower(coalesce({col}, '')), r'{P.WS}+', ' ')), ' ')"
    return "concat(" + ", ".join(
        f"regexp_extract_all({padded}, r'(?s)(?=( [^ ]{{{n - 1}}}|[^ ]{{{n}}}|[^ ]{{{n - 1}}} | [^ ]{{{n - 2}}} )).', 1)"
        for n in (3, 4, 5)) + ")"


def pipeline_v1(text_col: str = "text", label_col: str = "label", trees: int = rules.V1_TREES,
                max_depth: int = 30, seed: int = rules.SPLIT_SEED):
    """Word TF-IDF (5,000 single words, idf + 1) + random forest of depth 30 at most
    (``operators/sparseforest.py``).  Each level of the trees is written to the
    shared ``spark.checkpoint.dir``, so lineage stays short and survives lost
    executors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import CountVectorizer, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer

    from riskspark.operators.sparseforest import SparseForest
    from riskspark.operators.vectors import SmoothIdf

    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=P.TOKEN2, gaps=False, toLowercase=True),
        CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=rules.V1_MAX_FEATURES),
        SmoothIdf(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
        StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep"),
        SQLTransformer(statement="SELECT * EXCEPT (tokens, tf, tfidf) FROM __THIS__"),
        SparseForest(featuresCol="features", labelCol="label_idx", numTrees=trees, maxDepth=max_depth, seed=seed),
    ])


def pipeline_v2(text_col: str = "text", label_col: str = "label", trees: int = rules.V2_TREES,
                max_depth: int = 30, seed: int = rules.SPLIT_SEED, weight_col: str | None = "weight",
                draw_by: str | None = None, groups: int = 4):
    """Word 1-2-gram (60,000) + char 3-5-gram (80,000) TF-IDF with sublinear tf
    and idf + 1, assembled, and a class-balanced random forest.

    With ``draw_by``, the column that identifies a row, the trees are dealt in
    ``groups`` with a bootstrap draw each, balanced on that draw
    (``operators/forest.py``); without it the weights n / (k * n_class) of all
    rows in ``weight_col`` are used for every tree."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer

    from riskspark.operators.forest import BalancedForest
    from riskspark.operators.sparseforest import SparseForest
    from riskspark.operators.termvectors import AsVector, TermVectors

    index = StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
    if draw_by:
        rf = BalancedForest(featuresCol="features", labelCol="label_idx", idCol=draw_by, numTrees=trees, groups=groups,
                            maxDepth=max_depth, seed=seed)
        return Pipeline(stages=[TermVectors(inputCol=text_col, outputCol="terms"),
                                AsVector(inputCol="terms", outputCol="features"), index, rf])
    rf = SparseForest(featuresCol="features", labelCol="label_idx", numTrees=trees, maxDepth=max_depth, seed=seed)
    if weight_col:
        rf.setWeightCol(weight_col)
    return Pipeline(stages=[TermVectors(inputCol=text_col, outputCol="features"), index, rf])


def balanced_weights(df: DataFrame, label_col: str = "label", weight_col: str = "weight") -> DataFrame:
    """weight = n / (k * n_class): a handful of class counts, applied as a map."""
    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = float(sum(counts.values())), float(len(counts))
    pairs = []
    for lab, c in counts.items():
        pairs += [F.lit(lab), F.lit(n / (k * c))]
    return df.withColumn(weight_col, F.create_map(*pairs)[F.col(label_col)])


def fitted_labels(model) -> list[str]:
    from pyspark.ml.feature import StringIndexerModel

    for st in model.stages:
        if isinstance(st, StringIndexerModel):
            return list(st.labels)
    raise ValueError("pipeline has no StringIndexerModel")


def rf_probability_columns(model, df: DataFrame, text_col: str, out: str = "__rf_probs",
                           nnz: str | None = None) -> DataFrame:
    """Transform once and read the probability vector by class *name*:
    ``out`` = [P(HIGH), P(LOW), P(MEDIUM)], a class unseen in training -> 0.
    ``nnz`` names a further column, the non-zero entries of the feature vector."""
    from pyspark.ml.functions import vector_to_array

    labels = fitted_labels(model)
    stage_in = model.stages[0].getInputCol()
    src = df.withColumn(stage_in, F.col(text_col)) if stage_in != text_col else df
    if "label" not in src.columns:
        src = src.withColumn("label", F.lit(None).cast("string"))
    scored = model.transform(src)
    arr = vector_to_array(F.col("probability"))
    probs = [arr[labels.index(lab)] if lab in labels else F.lit(0.0) for lab in rules.LEVELS]
    keep = [c for c in df.columns]
    plain = isinstance(scored.schema["features"].dataType, T.StructType)
    held = (F.col("features") if plain else F.unwrap_udt("features"))["values"]
    more = [F.size(F.filter(held, lambda x: x != 0)).cast("bigint").alias(nnz)] if nnz else []
    return scored.select(*keep, F.array(*probs).alias(out), *more)


def data_key(pipeline, train: DataFrame) -> str:
    """A key over every row and column of ``train`` (in any order) and every
    parameter of every stage."""
    import hashlib

    row = F.xxhash64(*sorted(train.columns))
    n, a, b = train.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1_000_003)))).first()
    stages = [(type(st).__name__, sorted((p.name, str(v)) for p, v in st.extractParamMap().items()
                                         if p.name not in ("inputCol", "outputCol") or not str(v).startswith(st.uid)))
              for st in pipeline.getStages()]
    return hashlib.sha256(repr((n, a, b, sorted(train.dtypes), stages)).encode()).hexdigest()[:32]


def fit_or_load(pipeline, train: DataFrame):
    """Fit ``pipeline`` once and keep the model in the shared checkpoint
    folder (``spark.checkpoint.dir``); a later call with the same rows and
    parameters loads it.  Other rows or parameters give another model; a
    model that cannot be read is an error."""
    from pyspark.ml import PipelineModel

    from riskspark.session import ensure_checkpoint_dir

    spark = train.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{data_key(pipeline, train)}"
    # the metadata is written first, the marker last: a model without it is incomplete
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.done")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        pipeline.fit(train).write().overwrite().save(path)
        fs.create(done, True).close()
    return PipelineModel.load(path)
