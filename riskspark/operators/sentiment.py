"""Sentiment scoring: a pluggable batch model, and a lexicon stand-in.

No sentiment network ships with this library.  ``score_sentiment`` takes a
*scorer factory* -- called once per Python worker, returning a function from
a NumPy array of texts to an (n, 3) array of [neg, neu, pos] probabilities
(or logits with ``logits=True``) -- and runs it on Arrow batches through
``predict_batch_udf``.  Without a factory the lexicon scorer is used: pure
Column arithmetic, no Python worker, oracle-checkable:

    n, p = distinct negative / positive lexicon tokens in the text
    neg = n / (n + p + 2),  neu = 2 / (n + p + 2),  pos = p / (n + p + 2)

Empty text gives (0, 1, 0) -> neutral.  This is a stand-in, not a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import patterns as P
from riskspark.functions import text as X


def lexicon_probabilities(text, profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Column:
    """ARRAY<DOUBLE>[neg, neu, pos] from distinct lexicon tokens."""
    toks = X.tokens(text)
    neg_words = F.array(*[F.lit(w) for w in profile.lexicon_negative])
    pos_words = F.array(*[F.lit(w) for w in profile.lexicon_positive])
    n = F.size(F.array_intersect(toks, neg_words)).cast("double")
    p = F.size(F.array_intersect(toks, pos_words)).cast("double")
    total = n + p + F.lit(rules.LEXICON_PRIOR)
    return F.array(n / total, F.lit(rules.LEXICON_PRIOR) / total, p / total)


def lexicon_scorer(profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> Callable:
    """The lexicon as a batch scorer's factory, for stages that run in Python."""
    negative, positive = frozenset(profile.lexicon_negative), frozenset(profile.lexicon_positive)

    def factory():
        import numpy as np
        import regex

        word = regex.compile(P.TOKEN1)

        def score(texts):
            found = [set(word.findall(t.lower())) for t in texts]
            counts = np.array([(len(w & negative), rules.LEXICON_PRIOR, len(w & positive)) for w in found], dtype="float64")
            return counts.reshape(len(found), 3) / counts.reshape(len(found), 3).sum(axis=1, keepdims=True)

        return score

    return factory


def batch_model_probabilities(text, make_scorer: Callable, logits: bool = False,
                              batch_size: int = 64) -> Column:
    """ARRAY<DOUBLE>[neg, neu, pos] from a batch model on Arrow batches.

    ``make_scorer()`` runs once per Python worker (load weights there), and
    the returned ``fn(texts: np.ndarray) -> np.ndarray[n, 3]`` sees whole
    batches.  NULL text is scored as "".
    """
    from pyspark.ml.functions import predict_batch_udf

    def factory():
        import numpy as np

        fn = make_scorer()

        def predict(texts):
            out = np.asarray(fn(texts), dtype="float64").reshape(len(texts), 3)
            if logits:
                out = out - out.max(axis=1, keepdims=True)
                out = np.exp(out)
                out = out / out.sum(axis=1, keepdims=True)
            return out

        return predict

    udf = predict_batch_udf(factory, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    col = F.col(text) if isinstance(text, str) else text
    return udf(F.coalesce(col, F.lit("")))


def score_sentiment(df: DataFrame, text_col: str, make_scorer: Callable | None = None,
                    labels=rules.SENTIMENT_LABELS, prefix: str = "",
                    profile: rules.RiskProfile = rules.DEFAULT_PROFILE, logits: bool = False) -> DataFrame:
    """Append ``{prefix}neg, neu, pos`` and ``{prefix}sentiment`` (argmax,
    ties to the first of NEG < NEU < POS).  Blank text -> (0, 1, 0)."""
    text = F.col(text_col)
    blank = X.strip_ws(F.coalesce(text, F.lit(""))) == F.lit("")
    if make_scorer is None:
        probs = lexicon_probabilities(text, profile)
    else:
        probs = F.when(blank, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(
            batch_model_probabilities(text, make_scorer, logits=logits)
        )
    tmp = f"__{prefix}probs"
    out = df.withColumn(tmp, probs)
    p = [F.col(tmp)[i] for i in range(3)]
    return out.withColumns(
        {
            f"{prefix}neg": p[0],
            f"{prefix}neu": p[1],
            f"{prefix}pos": p[2],
            f"{prefix}sentiment": N.argmax3_label(p[0], p[1], p[2], labels),
        }
    ).drop(tmp)


def sentiment_columns(text, make_scorer: Callable | None = None, labels=rules.SENTIMENT_LABELS,
                      profile: rules.RiskProfile = rules.DEFAULT_PROFILE) -> dict[str, Column]:
    """Column expressions (no DataFrame) for callers that fuse projections."""
    probs = lexicon_probabilities(text, profile) if make_scorer is None else batch_model_probabilities(text, make_scorer)
    return {"probs": probs, "label": N.argmax3_label(probs[0], probs[1], probs[2], labels)}
