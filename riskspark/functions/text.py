"""String Column helpers: strip, cleaning, keyword hits, count parsing, booleans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace at both ends
    (Spark's ``trim`` removes only spaces)."""
    return F.trim(_c(x), F.lit(P.WS_CHARS))


def drop_invalid_utf8(x) -> Column:
    """Drop byte sequences that are not valid UTF-8 (text read from binary
    sources); a valid string is returned unchanged.  In a string that has
    invalid bytes, a U+FFFD that was already there is dropped with them."""
    c = _c(x)
    return F.when(F.is_valid_utf8(c), c).otherwise(F.regexp_replace(F.make_valid_utf8(c), "\ufffd", ""))


def collapse_ws(x) -> Column:
    """``" ".join(s.split())``: whitespace runs -> one space, stripped.

    Every whitespace character is first mapped to a space with
    ``translate`` (a per-character table), so the regex only looks for runs
    of one literal character: a third faster than one Unicode whitespace
    regex over whole documents, with the same result.  ``x`` is referenced
    once, so no upstream expression is duplicated in generated code."""
    spaced = F.translate(_c(x), P.WS_CHARS, " " * len(P.WS_CHARS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "), F.lit(" "))


def clean_text(x) -> Column:
    """Training-text cleaning: lower-case, URL / @mention / #hashtag -> space,
    collapse whitespace, strip.  NULL -> "".  Emoji and punctuation stay."""
    s = F.lower(F.coalesce(_c(x).cast("string"), F.lit("")))
    s = F.regexp_replace(s, P.URL, " ")
    s = F.regexp_replace(s, P.MENTION, " ")
    s = F.regexp_replace(s, P.HASHTAG, " ")
    return collapse_ws(s)


def clean_caption(x, mode: str = "reference") -> Column:
    """Caption cleaner of the collector.

    ``reference``: the collector's patterns carry doubled backslashes and match
    nothing in practice, so only the final strip acts.  ``documented``: the
    described behaviour -- URLs, emoji, #hashtags and @mentions removed,
    whitespace collapsed.
    """
    s = _c(x).cast("string")
    if mode == "reference":
        return strip_ws(s)
    if mode == "documented":
        s = F.regexp_replace(s, P.URL, "")
        s = F.regexp_replace(s, P.EMOJI, "")
        s = F.regexp_replace(s, P.HASHTAG, "")
        s = F.regexp_replace(s, P.MENTION, "")
        return collapse_ws(s)
    raise ValueError(f"unknown mode {mode!r}")


def keyword_hits(text, keywords: Iterable[str]) -> Column:
    """Number of distinct keywords that occur as substrings of lower(text).

    Substring, not word, semantics on purpose ("alone" hits "standalone").
    A sum of ``contains`` tests: generated code with the lower-cased text
    computed once (common subexpression), about 4x faster than a lambda
    over an array of keywords.
    """
    kws = list(dict.fromkeys(keywords))
    if not kws:
        return F.lit(0)
    lc = F.lower(F.coalesce(_c(text), F.lit("")))
    total = None
    for k in kws:
        t = lc.contains(F.lit(k)).cast("int")
        total = t if total is None else total + t
    return total


def tokens(text, pattern: str = P.TOKEN1) -> Column:
    """Lower-cased tokens (maximal runs of word characters) as ARRAY<STRING>."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(pattern), 0)


def to_bool(x, dtype: T.DataType | None = None, null_as: bool | None = None) -> Column:
    """Loose boolean: booleans as is, numbers != 0 (NaN -> true), strings
    "true"/"1"/"yes" (case-insensitive, stripped) -> true, else false.

    ``null_as`` decides a NULL input (``None`` keeps NULL).  A missing value
    read back from a CSV is a float NaN, which counts as true.
    """
    c = _c(x)
    if isinstance(dtype, T.BooleanType):
        v = c
    elif isinstance(dtype, T.NumericType):
        v = (c != F.lit(0)) | F.isnan(c.cast("double"))
    else:
        v = F.lower(strip_ws(c.cast("string"))).isin("true", "1", "yes")
    if null_as is None:
        return v
    return F.when(c.isNull(), F.lit(null_as)).otherwise(v)


_FLOAT_BODY = r"^" + P.WS + r"*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?" + P.WS + r"*$"
_INT_BODY = r"^" + P.WS + r"*[+-]?[0-9]+" + P.WS + r"*$"


def parse_count(x) -> Column:
    """Abbreviated count text -> BIGINT ("1.2K" -> 1200, "1,5k" -> 1500,
    "1,234" -> 1234, " 3M " -> 3000000); anything unparsable -> 0.

    With a K/M suffix the comma is a decimal point; without it the comma is a
    thousands separator.  Scaled values are truncated toward zero.
    """
    raw = _c(x).cast("string")
    s = F.upper(strip_ws(raw))
    body = F.substring(s, F.lit(1), F.length(s) - F.lit(1))
    body_dot = F.regexp_replace(body, ",", ".")
    plain = F.regexp_replace(s, ",", "")

    def scaled(mult: float) -> Column:
        val = strip_ws(body_dot).try_cast("double") * F.lit(mult)
        return F.when(body_dot.rlike(_FLOAT_BODY), val.try_cast("bigint"))

    parsed = (
        F.when(s.endswith("K"), scaled(1000.0))
        .when(s.endswith("M"), scaled(1_000_000.0))
        .otherwise(F.when(plain.rlike(_INT_BODY), strip_ws(plain).try_cast("bigint")))
    )
    return F.when(raw.isNull() | (raw == F.lit("")), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(parsed, F.lit(0).cast("bigint"))
    )
