"""Quality rules by host, with DataFrame operations only.

Every text is measured once (words, symbols, repeated lines, repeated
three-word windows) and checked against a few rules.  Failures are counted
per host with partial sums, so a host holding most rows is no hot key.  A
host's rate of failures is shrunk towards the rate of all hosts by a beta
prior whose strength is estimated from the spread between hosts: a host of
few documents is judged by the others, a host of many by itself.  A host
whose shrunk rate reaches ``MAX_RATE`` for one rule is rejected, and its
verdict is joined back to its documents.

Defined cases: a null or empty text has no words and fails the rule on
length; a null host is a host of its own; null and repeated ids are rows
like any others; one host alone is its own prior; hosts that differ no
more than by chance all get the common rate; an empty table gives an empty
result; further columns are ignored, whatever their names.  Windows are
compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from riskspark.llm.staging import Stage
from riskspark.plans.strategy import join_small

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50        # percent of the words that lie in repeated windows
MAX_SYMBOLS = 10         # symbols per 100 words
MAX_DUP_LINES = 30       # percent of the lines with a word
WORD_CHARS = (2, 30)     # mean length; scripts written without spaces make long words
MAX_RATE = 0.5           # shrunk share of failing documents at which a host is rejected
RULES = ("short", "repeated", "symbols", "lines", "word_length")
BASE = ("short", "repeated")


def _repeated(marks: str) -> Column:
    """Words covered by windows met twice; ``marks`` holds (hash, place) of
    every window, sorted, so equal windows stand side by side."""
    near = F.arrays_zip(F.col(f"{marks}.place").alias("place"), F.col(f"{marks}.window").alias("window"),
                        F.expr(f"slice({marks}.window, 2, size({marks}))").alias("after"),
                        F.expr(f"concat(array(cast(null AS bigint)), {marks}.window)").alias("before"))
    met = F.filter(near, lambda x: (x["window"] == x["after"]) | (x["window"] == x["before"]))
    return F.sort_array(F.transform(met, lambda x: x["place"]))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every row; no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"),
                       F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                       F.filter(F.split(whole, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
                       F.array_remove(F.split(whole, SPACE), "").alias("w"))
    windows = F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"), F.expr("slice(w, 3, size(w))").alias("c"))
    marks = F.transform(F.filter(windows, lambda x: x["c"].isNotNull()),
                        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("window"), i.alias("place")))
    rows = rows.select("doc_id", "host", "n_symbols", F.size("w").cast("long").alias("n_words"),
                       F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                       F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.sort_array(marks).alias("marks"))
    rows = rows.select("*", _repeated("marks").alias("at")).drop("marks")
    # places in order: a window covers three words, less where the next begins earlier
    cover = F.zip_with("at", F.expr("slice(at, 2, size(at))"), lambda a, b: F.least(F.lit(3), b - a))
    total = F.aggregate(cover, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(3)))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       total.alias("n_repeat_words"), "n_lines")


def failures() -> dict[str, Column]:
    """Each rule as a condition on the measures; true where the document fails."""
    n, lo, hi = F.col("n_words"), *WORD_CHARS
    return {
        "short": n < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MAX_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * n,
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "word_length": (n > 0) & ((F.col("word_chars") < lo * n) | (F.col("word_chars") > hi * n)),
    }


def beta_prior(sums: Row, rule: str) -> tuple[float, float]:
    """(mean, weight) of the beta prior of one rule, from the sums over the
    hosts: weight is the number of documents the prior counts for.  The
    spread between hosts beyond chance is the intraclass correlation of the
    one-way layout; without any the weight is unbounded (None to callers is
    never given: a weight of -1 says that every host has the mean)."""
    k, docs, squares = sums["hosts"], sums["docs"] or 0, sums["squares"] or 0
    failed, parts = sums[f"failed_{rule}"] or 0, sums[f"parts_{rule}"] or 0.0
    if docs == 0:
        return 0.0, -1.0
    mean = failed / docs
    if k < 2 or docs <= k or failed in (0, docs):
        return mean, -1.0
    between = (parts - failed * failed / docs) / (k - 1)
    within = (failed - parts) / (docs - k)
    size = (docs - squares / docs) / (k - 1)
    rho = round((between - within) / (between + (size - 1) * within), 6)
    return mean, (1 - rho) / rho if rho > 0 else -1.0


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, rate_<rule> ..., host_rejected): one row per host."""
    fails = failures()
    per = measured.groupBy("host").agg(F.count("*").alias("n_docs"),
                                       *[F.count_if(fails[r]).alias(f"failed_{r}") for r in RULES])
    per = Stage(measured.sparkSession, "hosts").write(per, "counts")
    sums = per.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("squares"),
                   *[F.sum(f"failed_{r}").alias(f"failed_{r}") for r in RULES],
                   *[F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("n_docs")).alias(f"parts_{r}")
                     for r in RULES]).first()       # one row
    rates = []
    for r in RULES:
        mean, weight = beta_prior(sums, r)
        shrunk = F.lit(mean) if weight < 0 else (F.col(f"failed_{r}") + mean * weight) / (F.col("n_docs") + weight)
        rates.append(F.round(shrunk, 6).alias(f"rate_{r}"))
    out = per.select("host", "n_docs", *rates)
    return out.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) >= max_rate)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          max_rate: float = MAX_RATE) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, kept, failed_rules (the
    rules it fails itself) and host_rejected.  A document goes if it fails a
    base rule or its host is rejected."""
    # texts are measured once; counts and verdicts read the stored numbers
    measured = Stage(docs.sparkSession, "rules").write(measures(docs, doc_id, text, host), "measures")
    bad = (host_verdicts(measured, max_rate).where("host_rejected")
           .select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected")))
    fails = failures()
    base = F.lit(False)
    for r in BASE:
        base = base | fails[r]
    out = join_small(measured, bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (~base & ~rejected).alias("kept"),
                      F.concat_ws(",", *[F.when(fails[r], F.lit(r)) for r in RULES]).alias("failed_rules"),
                      rejected.alias("host_rejected"))
