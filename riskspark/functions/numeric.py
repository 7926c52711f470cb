"""Numeric Column helpers: clamps, levels, rounding, softmax, argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import rules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp01(x) -> Column:
    """max(0, min(1, x)) that keeps NULL as NULL (greatest/least skip NULLs)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    )


def round_half_away(x, places: int) -> Column:
    """round(x * 10^p) / 10^p, half away from zero on the exact double.

    Spark's ``round`` on a DOUBLE rounds the shortest decimal string, so
    1.005 -> 1.01; scaling first rounds the binary value instead (1.0), the
    same as DuckDB's ``round``.  Ties of the binary value go away from zero
    (Python's ``round`` goes to even there: 0.0625 -> 0.062 vs 0.063).
    """
    scale = float(10 ** places)
    return F.round(_c(x) * F.lit(scale)) / F.lit(scale)


def risk_level(score) -> Column:
    """>= 0.70 HIGH, >= 0.40 MEDIUM, else LOW; NULL stays NULL."""
    s = _c(score)
    return (
        F.when(s >= F.lit(rules.LEVEL_HIGH), F.lit("HIGH"))
        .when(s >= F.lit(rules.LEVEL_MEDIUM), F.lit("MEDIUM"))
        .when(s.isNotNull(), F.lit("LOW"))
    )


def percent_label(pct) -> Column:
    """0-100 score -> level with thresholds 70 / 40; NULL or NaN -> LOW."""
    p = _c(pct)
    valid = p.isNotNull() & ~F.isnan(p)
    return (
        F.when(valid & (p >= F.lit(70.0)), F.lit("HIGH"))
        .when(valid & (p >= F.lit(40.0)), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def softmax3(a, b, c) -> Column:
    """Softmax of three logits as ARRAY<DOUBLE>[p0, p1, p2]."""
    a, b, c = _c(a), _c(b), _c(c)
    m = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - m), F.exp(b - m), F.exp(c - m)
    s = ea + eb + ec
    return F.array(ea / s, eb / s, ec / s)


def argmax3_label(p0, p1, p2, labels=rules.SENTIMENT_LABELS) -> Column:
    """Label of the largest of three values; ties go to the first."""
    p0, p1, p2 = _c(p0), _c(p1), _c(p2)
    return (
        F.when((p0 >= p1) & (p0 >= p2), F.lit(labels[0]))
        .when(p1 >= p2, F.lit(labels[1]))
        .otherwise(F.lit(labels[2]))
    )


def unparsable(cell) -> Column:
    """True for a cell that is present but is no number ('' included)."""
    return cell.isNotNull() & cell.try_cast("double").isNull()


def safe_float(cell, default: float) -> Column:
    """The cell as DOUBLE; ``default`` if it is no number; NULL stays NULL."""
    return F.when(unparsable(cell), F.lit(default)).otherwise(cell.try_cast("double"))
