"""The toxicity classifier learns from every labelled row and whole texts."""

import pytest

from riskspark.llm import toxicity as X

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Only texts of more than 20,000 characters are toxic, by a word at their end."""
    filler = [f"w{i % 389}" for i in range(5200)]
    rows = [(i, " ".join(filler[i % 97:5000 + i % 97] + ["vile"]) if i % 4 == 0 else " ".join(filler[i % 89:i % 89 + 60]), "en") for i in range(240)]
    assert min(len(t) for i, t, _ in rows if i % 4 == 0) > 20_000
    return (spark.createDataFrame(rows, SCHEMA).cache(),
            spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], LABELS).cache())


@pytest.mark.parametrize("shard", [8192, 60])
def test_long_texts_are_learned_from(corpus, monkeypatch, shard):
    monkeypatch.setattr(X, "SHARD_ROWS", shard)
    docs, labels = corpus
    model = X.train(docs, labels)
    assert model.trained and model.langs == ["en"]
    got = {r["doc_id"]: r["score"] >= X.CUT for r in X.score(docs.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in got) > 0.95 * len(got)
    again = X.train(docs.repartition(5), labels)
    assert (again.common, again.threshold.tolist()) == (model.common, model.threshold.tolist())


def test_counts_are_those_of_all_rows(spark):
    rows = [(i, "a b b" if i % 3 else "a c", "en" if i % 2 else "fr") for i in range(700)] + [(3, "a d", "en"), (700, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = (docs.selectExpr("text", "lang", "CAST(doc_id % 2 AS INT) AS toxic", "doc_id % 4 = 0 AS fourth").repartition(5))
    for fourth, used in ((None, rows), (False, [r for r in rows if r[0] % 4]), (True, [r for r in rows if r[0] % 4 == 0])):
        sums = X._summed(held.mapInArrow(X._counted(fourth), X._BLOCKS))
        assert sums["rows"][:2, 0].tolist() == [sum(r[0] % 2 == k for r in used) for k in (0, 1)]
        assert sums["langfr"].sum() == sum(len(r[1].split()) for r in used if r[2] == "fr" and r[1])
        assert sums["odds0"].sum() == sum(len(set(r[1].split())) for r in used if r[1])
