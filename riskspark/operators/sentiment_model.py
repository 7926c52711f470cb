"""A sentiment model trained in Spark, used as a batch scorer.

Spark ML fits TF-IDF over a bounded vocabulary, scaled to unit length, and a
multinomial logistic regression; both are distributed.  What is kept is one
small table, a row per term (idf and three weights) and one of intercepts, so
the model is stored as Parquet, read back whole (at most ``vocabulary`` + 1
rows) and shipped to workers, where ``make_scorer`` gives the function that
``sentiment.score_sentiment`` runs on Arrow batches.

Defined cases: rows without a text or with a label that is none of the three
are not learned from; a text without a known term gets the model's prior; a
class without rows keeps a probability near 0; no rows at all are an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.functions import patterns as P
from riskspark.functions import text as X

VOCABULARY = 20_000     # terms, the most frequent ones
MIN_DF = 2              # texts that hold a term
SCHEMA = "term string, idf double, neg double, neu double, pos double"


@dataclass(frozen=True)
class SentimentModel:
    """``weights`` are (terms, 3), by term and class; ``intercept`` is (3,)."""

    terms: dict[str, int]
    idf: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    def make_scorer(self) -> Callable:
        """A factory as ``score_sentiment`` wants it; the function gives probabilities."""
        terms, idf, weights, intercept = self.terms, self.idf, self.weights, self.intercept

        def factory():
            import regex

            word = regex.compile(P.TOKEN1)

            def score(texts):
                out = np.empty((len(texts), 3))
                for i, text in enumerate(texts):
                    counts = Counter(terms[w] for w in word.findall(text.lower()) if w in terms)
                    at = np.fromiter(counts, dtype=np.int64, count=len(counts))
                    x = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) * idf[at]
                    norm = np.sqrt((x * x).sum()) or 1.0
                    z = intercept + (x / norm) @ weights[at]
                    e = np.exp(z - z.max())
                    out[i] = e / e.sum()
                return out

            return score

        return factory

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, float(self.idf[i]), *map(float, self.weights[i])) for t, i in self.terms.items()]
        rows.append((None, 0.0, *map(float, self.intercept)))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentimentModel:
        rows = spark.read.schema(SCHEMA).parquet(path).collect()      # at most VOCABULARY + 1 rows
        known = [r for r in rows if r["term"] is not None]
        intercept = next(r for r in rows if r["term"] is None)
        return SentimentModel({r["term"]: i for i, r in enumerate(known)}, np.array([r["idf"] for r in known]),
                              np.array([r[2:] for r in known], dtype=np.float64).reshape(len(known), 3),
                              np.array(intercept[2:], dtype=np.float64))


def pipeline(vocabulary: int = VOCABULARY, min_df: int = MIN_DF, reg: float = 1e-3, iterations: int = 50):
    """The Spark ML stages over columns ``words`` and ``label``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    return Pipeline(stages=[
        CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary, minDF=min_df),
        IDF(inputCol="counts", outputCol="weighed"),
        Normalizer(inputCol="weighed", outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=iterations, regParam=reg, standardization=False)])


def training_rows(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(words, label): tokens and the number of the class, usable rows only."""
    number = F.array_position(F.array(*[F.lit(x) for x in rules.SENTIMENT_LABELS]), F.col(label_col)) - 1
    rows = df.where(F.col(text_col).isNotNull()).select(X.tokens(F.col(text_col)).alias("words"),
                                                        number.cast("double").alias("label"))
    return rows.where("label >= 0")


def fit(df: DataFrame, text_col: str = "text", label_col: str = "label", **how) -> SentimentModel:
    """Learn from rows with a text and one of the three sentiment labels."""
    stages = pipeline(**how).fit(training_rows(df, text_col, label_col)).stages
    counts, idf, lr = stages[0], stages[1], stages[3]
    weights, intercept = np.zeros((3, len(counts.vocabulary))), np.full(3, -30.0)
    seen = lr.numClasses                                              # classes beyond the last one seen have no row
    weights[:seen], intercept[:seen] = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    return SentimentModel({t: i for i, t in enumerate(counts.vocabulary)}, idf.idf.toArray(), weights.T.copy(), intercept)
