"""Text features in long form: n-grams and TF-IDF as (doc, term, value) rows.

The long form is the exact feature definition (the one checked against
SQL):

* word n-grams: lower-cased tokens of two or more word characters; 1-grams,
  or 1- and 2-grams of consecutive tokens joined by one space;
* char n-grams within word boundaries: each whitespace-separated word is
  padded with one space on both sides; n runs from 3 to 5 and stops at the
  first n that reaches the padded length (that gram is the whole word);
* vocabulary: terms with ``min_df <= df <= max_df * N``, then the
  ``max_features`` most frequent by total count (ties: term ascending);
* weight: tf (or ``1 + ln tf`` when sublinear) times ``ln((1+N)/(1+df)) + 1``,
  L2-normalised per document.

Plan: the corpus is hash-partitioned by document *before* it is expanded (a
document is one row, so this moves text, about 10x less than the expanded
terms, and cannot create a hot key).  A document's terms are counted where
its text is, in Arrow batches, and leave the task as one list, so neither
counting nor the norm of a document shuffles or sorts terms.  Document
frequency per term is one shuffle with partial aggregation; the vocabulary
is a top-V (``top_terms``: when V rows from every partition would be too
many for one task, a cutoff from a histogram of totals first), its byte
size is measured and it is broadcast below 64 MiB, else joined by a shuffle
join.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.functions import patterns as P
from riskspark.functions import text as X
from riskspark.plans.strategy import DEFAULT_BROADCAST_BYTES, payload_bytes
from riskspark.session import written


def word_terms(text) -> Column:
    """ARRAY of word 1-grams followed by 2-grams."""
    return word_terms_of(X.tokens(text, P.TOKEN2))


def word_terms_of(toks: Column) -> Column:
    """ARRAY of the 1-grams ``toks`` followed by their 2-grams.  ``toks`` is
    referenced several times: pass a column, not the tokenizer expression."""
    n = F.size(toks)
    bigrams = F.when(n >= 2, F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                                          lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


def char_wb_terms(word: Column, lo: int = 3, hi: int = 5) -> Column:
    """ARRAY of char n-grams of one word (padded with one space each side)."""
    return char_terms_of_padded(F.concat(F.lit(" "), word, F.lit(" ")), lo, hi)


def char_terms_of_padded(padded: Column, lo: int = 3, hi: int = 5) -> Column:
    """ARRAY of char n-grams of an already padded word.  ``padded`` is read
    once per n-gram: pass a column, not the padding expression."""
    plen = F.length(padded)
    return F.flatten(F.transform(
        F.sequence(F.lit(lo), F.least(F.lit(hi), plen)),
        lambda n: F.transform(F.sequence(F.lit(1), plen - n + 1), lambda i: F.substring(padded, i, n)),
    ))


LIST_TERMS = 1 << 16    # (term, value) pairs in one row or record batch of ``term_lists``
LIST_ROWS = 1 << 8      # texts that are Python strings at once
LIST_CHARS = 1 << 20    # their characters, of complete documents or of one that goes on


def _count_words(counts: Counter, text: str, max_words: int) -> None:
    """Add the n-grams of tokens that one space separates."""
    toks = text.split(" ") if text else []
    counts.update(toks)
    if max_words == 2:
        counts.update(map("%s %s".__mod__, zip(toks, toks[1:])))


def _count_chars(counts: Counter, text: str, alphabet: int = 1 << 12) -> None:
    """Add the char n-grams (see ``char_wb_terms``) of a text.  ``str.split``
    splits at the characters of ``patterns.WS``.  With few different
    characters, an n-gram is one 60-bit number and numpy counts them."""
    words = text.split()
    if not words:
        return
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    letters, code = np.unique(points, return_inverse=True)
    if len(letters) >= alphabet or letters[0] == 0:     # 0 stands for no character below
        padded = Counter(f" {w} " for w in words)
        for p, k in padded.items():
            for n in range(3, min(5, len(p)) + 1):
                for i in range(len(p) - n + 1):
                    counts[p[i:i + n]] += k
        return
    code = code.astype(np.uint64) + np.uint64(1)
    spaces = np.concatenate([[0], np.cumsum(points == 32)])
    keys, grams = np.zeros(len(code), np.uint64), []
    for n in range(1, 6):
        left = len(code) - n + 1
        if left <= 0:
            break
        keys = keys[:left] | code[n - 1:] << np.uint64(60 - 12 * n)
        if n >= 3:      # only its ends may be the space between two words
            grams.append(keys[spaces[n - 1:n - 1 + left] == spaces[1:1 + left]])
    found, tf = np.unique(np.concatenate(grams), return_counts=True)
    parts = (found[:, None] >> np.arange(48, -1, -12, dtype=np.uint64)) & np.uint64(4095)
    terms = np.concatenate([[0], letters]).astype(np.uint32)[parts.astype(np.intp)].view("<U5").ravel()
    counts.update(dict(zip(terms.tolist(), tf.tolist())))


def _weigh(counts: dict[str, int], known: dict[str, tuple[int, float]], sublinear: bool) -> dict[int, float]:
    """L2-normalised weights of the known terms, by the term's number."""
    found = [(known[t], n) for t, n in counts.items() if t in known]
    w = {k: (1.0 + math.log(n) if sublinear else float(n)) * idf for (k, idf), n in found}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {k: x / norm for k, x in w.items()}


Counts = tuple[list, np.ndarray, np.ndarray, np.ndarray]    # terms, and (document, number of term, tf) by document


def _of_counters(counters: list[Counter]) -> Counts:
    index: dict[str, int] = {}
    number = np.array([index.setdefault(t, len(index)) for c in counters for t in c], np.int64)
    doc = np.repeat(np.arange(len(counters)), [len(c) for c in counters])
    return list(index), doc, number, np.array([n for c in counters for n in c.values()], np.int64)


def word_counts(docs: list[list[str]], max_words: int = 2) -> Counts:
    """Counts of the n-grams of texts of tokens that one space separates."""
    counters = [Counter() for _ in docs]
    for counts, texts in zip(counters, docs):
        for text in texts:
            _count_words(counts, text, max_words)
    return _of_counters(counters)


def gram_counts(docs: list[list[str]]) -> Counts:
    """Counts of the char n-grams (see ``_count_chars``), those of all documents by one sort of (document, n-gram)
    numbers; where these have no room in 64 bits, of fewer documents at a time."""
    joined = ["".join([f" {' '.join(w)} " for w in map(str.split, texts) if w]) for texts in docs]
    points = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32)
    if len(points) == 0:
        return [], *(np.zeros(0, np.int64),) * 3
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    bits = len(letters).bit_length()
    if seen[0] or 5 * bits + (len(docs) - 1).bit_length() > 64:
        if len(docs) == 1:
            counts: Counter = Counter()
            for text in docs[0]:
                _count_chars(counts, text)
            return _of_counters([counts])
        half = len(docs) // 2
        a, b = gram_counts(docs[:half]), gram_counts(docs[half:])
        return a[0] + b[0], *map(np.concatenate, ((a[1], b[1] + half), (a[2], b[2] + len(a[0])), (a[3], b[3])))
    code = np.zeros(len(seen), np.uint64)
    code[letters] = np.arange(1, len(letters) + 1)
    code = code.take(points)
    spaces = np.concatenate([[0], np.cumsum(points == 32)])
    keys, grams = np.repeat(np.arange(len(docs), dtype=np.uint64) << np.uint64(5 * bits), [len(x) for x in joined]), []
    for n in range(1, 6):
        left = len(code) - n + 1
        if left <= 0:
            break
        keys = keys[:left] | code[n - 1:] << np.uint64(bits * (5 - n))
        if n >= 3:      # only its ends may be the space between two words
            grams.append(keys[spaces[n - 1:n - 1 + left] == spaces[1:1 + left]])
    every = np.sort(np.concatenate(grams))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    tf = np.diff(first, append=len(every))
    every = every[first]
    found, number = np.unique(every & np.uint64((1 << 5 * bits) - 1), return_inverse=True)
    parts = (found[:, None] >> np.arange(4 * bits, -1, -bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    terms = np.concatenate([[0], letters]).astype(np.uint32)[parts.astype(np.intp)].view("<U5").ravel()
    return terms.tolist(), (every >> np.uint64(5 * bits)).astype(np.int64), number, tf


def known_weights(counts: Counts, known: dict[str, tuple[int, float]], sublinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, weight) of the known terms: the weights of ``_weigh``."""
    terms, doc, number, tf = counts
    found = [known.get(t, (-1, 0.0)) for t in terms]
    names, idf = np.array([k for k, _ in found], np.int64), np.array([x for _, x in found], float)
    held = np.flatnonzero(names[number] >= 0) if len(number) else number
    doc, number, tf = doc[held], number[held], tf[held].astype(float)
    w = (1.0 + np.log(tf) if sublinear else tf) * idf[number]
    norm = np.sqrt(np.bincount(doc, w * w))
    return doc, names[number], w / norm[doc]


def _counted(corpus: DataFrame, doc_col: str, text_col: str, kind: str, max_words: int, keep: tuple[str, ...]):
    """The columns and texts of the documents, those of one document adjacent, and what counts some of them, or adds
    the terms of a text to a counter."""
    if max_words not in (1, 2):
        raise ValueError(f"max_words must be 1 or 2, not {max_words}")
    if kind == "word":
        body = F.array_join(X.tokens(F.col(text_col), P.TOKEN2), " ")
        some, one = functools.partial(word_counts, max_words=max_words), functools.partial(_count_words, max_words=max_words)
    elif kind == "char":
        body, some, one = F.lower(F.coalesce(F.col(text_col), F.lit(""))), gram_counts, _count_chars
    else:
        raise ValueError(kind)
    # an explicit count: adaptive execution would merge a byte-small corpus
    # into one task, but expanding text is CPU-heavy
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [doc_col, *keep]
    rows = (corpus.select(*own, text_col).repartition(n, doc_col).sortWithinPartitions(*own)
            .select(*own, body.alias("__text")))
    return rows, some, one


def _documents(batches: Iterator[pa.RecordBatch], some, one) -> Iterator[tuple[list[tuple], Counts]]:
    """(own columns, counts) of some documents at a time, with ``LIST_CHARS`` characters or ``LIST_ROWS`` texts.  A
    document with more is counted text by text and comes alone."""
    keys, docs, chars = [], [], 0
    long: Counter = Counter()       # of the last document, where it is long

    def whole() -> Counts:
        if not long:
            return some(docs)
        for x in docs[0]:
            one(long, x)
        return _of_counters([long])

    for batch in (b.slice(i, LIST_ROWS) for b in batches for i in range(0, b.num_rows, LIST_ROWS)):
        own_rows = zip(*[c.to_pylist() for c in batch.columns[:-1]])
        for at, text in zip(own_rows, batch.columns[-1].to_pylist()):
            if not keys or at != keys[-1]:
                if long or chars >= LIST_CHARS or len(docs) >= LIST_ROWS:
                    yield keys, whole()
                    keys, docs, chars = [], [], 0
                    long.clear()
                keys.append(at)
                docs.append([])
            docs[-1].append(text)
            chars += len(text)
            if len(docs[-1]) > 1 and (chars >= LIST_CHARS or len(docs[-1]) >= LIST_ROWS):
                if len(docs) > 1:       # those before are complete
                    yield keys[:-1], some(docs[:-1])
                    keys, docs = keys[-1:], docs[-1:]
                for x in docs[0]:
                    one(long, x)
                docs[0], chars = [], 0
    if keys:
        yield keys, whole()


def term_lists(corpus: DataFrame, doc_col: str, text_col: str, kind: str = "word", max_words: int = 2,
               keep: tuple[str, ...] = (), known=None, sublinear: bool = False) -> DataFrame:
    """The document's columns and ``terms``, an array of (term, tf) of the
    distinct terms of the document; with ``known``, a broadcast variable of
    term -> (number, idf), an array of (number, weight) of the terms it holds.  Documents
    without a term have no row, those of more than ``LIST_TERMS`` terms
    several with different terms.

    Rows of one document are made adjacent by a sort of the texts inside a
    partition and counted together; what a task holds is the distinct terms
    of one document, or of some with ``LIST_CHARS`` characters."""
    rows, some, one = _counted(corpus, doc_col, text_col, kind, max_words, keep)
    fields = ([T.StructField("term", T.StringType(), False), T.StructField("tf", T.LongType(), False)] if known is None else
              [T.StructField("number", T.IntegerType(), False), T.StructField("weight", T.DoubleType(), False)])
    schema = T.StructType([rows.schema[c] for c in (doc_col, *keep)]
                          + [T.StructField("terms", T.ArrayType(T.StructType(fields), False), False)])
    names, columns, most = [f.name for f in fields], schema.names, LIST_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [c.type for c in b.columns[:-1]]
                yield b

        for keys, counts in _documents(seen(), some, one):
            if known is None:
                doc, values = counts[1], counts[3]
                named = pa.array(counts[0], pa.string()).take(pa.array(counts[2]))
            else:
                doc, number, values = known_weights(counts, known.value, sublinear)
                named = pa.array(number.astype(np.int32))
            if len(doc) == 0:
                continue
            # a list ends with its document, or with ``LIST_TERMS`` terms of it
            new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            starts = np.concatenate([np.arange(a, b, most) for a, b in zip(new, [*new[1:], len(doc)])])
            pairs = pa.StructArray.from_arrays([named, pa.array(values)], names=names)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)), pa.int32()), pairs)
            own = zip(*[keys[k] for k in doc[starts]])
            out = pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(own, types)], lists], names=columns)
            for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // most)) + 1):
                yield out.slice(part[0], len(part))

    return rows.mapInArrow(run, schema)


def term_totals(corpus: DataFrame, doc_col: str, text_col: str, kind: str = "word", max_words: int = 2) -> DataFrame:
    """(term, df, total) of the corpus, as ``term_stats`` of its ``term_counts``: summed up over some documents where they
    are counted, before terms are rows."""
    rows, some, one = _counted(corpus, doc_col, text_col, kind, max_words, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (terms, _, number, tf) in _documents(batches, some, one):
            df, total = np.bincount(number, minlength=len(terms)), np.bincount(number, tf, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(df), pa.array(total)],
                                             names=["term", "df", "total"])

    parts = rows.mapInArrow(run, "term string, df long, total long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_counts(corpus: DataFrame, doc_col: str, text_col: str, kind: str = "word",
                max_words: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, term, tf BIGINT) and the document's ``keep`` columns for every
    term occurring in a document.  Word terms are n-grams of up to
    ``max_words`` (1 or 2) tokens."""
    return term_lists(corpus, doc_col, text_col, kind, max_words, keep).select(doc_col, *keep, F.inline("terms"))


def term_summary(lists: DataFrame, doc_col: str) -> DataFrame:
    """(doc, n_grams, n_distinct, min_term, max_term) of ``term_lists``.  A
    document is summed up in its row: terms as rows would be sorted by
    document for the least and greatest of them."""
    per = lists.select(doc_col, F.aggregate("terms.tf", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
                       F.size("terms").alias("d"), F.array_min("terms.term").alias("lo"),
                       F.array_max("terms.term").alias("hi"))
    return per.groupBy(doc_col).agg(F.sum("n").alias("n_grams"), F.sum("d").alias("n_distinct"),
                                    F.min("lo").alias("min_term"), F.max("hi").alias("max_term"))


@dataclass(frozen=True)
class TfidfSpec:
    kind: str = "word"
    max_features: int | None = None
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = False
    max_words: int = 2      # longest word n-gram, in tokens


V1_WORD = TfidfSpec("word", rules.V1_MAX_FEATURES, max_words=1)
V2_WORD = TfidfSpec("word", rules.V2_WORD_MAX_FEATURES, rules.V2_MIN_DF, rules.V2_WORD_MAX_DF, True)
V2_CHAR = TfidfSpec("char", rules.V2_CHAR_MAX_FEATURES, rules.V2_MIN_DF, rules.V2_CHAR_MAX_DF, True)


# Above this many rows (k times the shuffle partitions), the ordered limit
# first cuts the terms by a histogram of totals (see ``top_terms``).
DEFAULT_FUNNEL_ROWS = 4_000_000


def top_terms(stats: DataFrame, k: int, max_funnel_rows: int = DEFAULT_FUNNEL_ROWS) -> DataFrame:
    """The ``k`` terms with the largest ``total`` (ties: term ascending).

    ``orderBy(...).limit(k)`` sends the top ``k`` rows of *every* partition
    to one task: at most k times the shuffle partitions (adaptive execution
    only merges partitions).  While that bound is under ``max_funnel_rows``
    it is used as is.  Above it, the term table is written once to the
    shared checkpoint folder, a histogram of its totals (one row per
    distinct total: at most sqrt(2 * tokens) rows) with a running count
    gives the total T at which the k-th term lies, and only terms with
    total >= T -- fewer than k, plus the ties at T -- reach the ordered
    limit."""
    from riskspark.session import cut_lineage

    order = [F.col("total").desc(), F.col("term").asc()]
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if k * parts <= max_funnel_rows:
        return stats.orderBy(*order).limit(k)
    stats = cut_lineage(stats)
    hist = stats.groupBy("total").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy(F.col("total").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select("total", "c", F.sum("c").over(upto).alias("cum"))
    edge = h.filter((F.col("cum") >= F.lit(k)) & (F.col("cum") - F.col("c") < F.lit(k))).select("total").first()
    if edge is not None:  # otherwise there are at most k terms: all are kept
        stats = stats.filter(F.col("total") >= F.lit(edge["total"]))
    return stats.orderBy(*order).limit(k)


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df, total) of (doc, term, tf) rows."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary_of(stats: DataFrame, n_docs: int, spec: TfidfSpec) -> DataFrame:
    """(term, df, total, idf) of the kept vocabulary, from a table of term statistics."""
    stats = stats.filter((F.col("df") >= F.lit(spec.min_df))
                         & (F.col("df").cast("double") <= F.lit(float(spec.max_df)) * F.lit(float(n_docs))))
    if spec.max_features is not None:
        stats = top_terms(stats, spec.max_features)
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df").cast("double"))) + F.lit(1.0)
    return stats.select("term", F.col("df").cast("bigint").alias("df"), F.col("total").cast("bigint").alias("total"),
                        idf.alias("idf"))


def vocabulary(counts: DataFrame, n_docs: int, spec: TfidfSpec, doc_col: str) -> DataFrame:
    """(term, df, total, idf) of the kept vocabulary of (doc, term, tf) rows."""
    return vocabulary_of(term_stats(counts), n_docs, spec)


def oov_stats(counts: DataFrame, in_training: str) -> DataFrame:
    """(term, df, total) as in ``term_stats`` over the documents flagged
    ``in_training``, for the terms of all documents (0 where only others
    hold a term), written once: the vocabulary and the unknown terms are
    both read from it."""
    mine = F.col(in_training)
    return written(counts.groupBy("term").agg(
        F.count(F.when(mine, 1)).alias("df"), F.coalesce(F.sum(F.when(mine, F.col("tf"))), F.lit(0)).alias("total")), "terms")


def term_weights(corpus: DataFrame, doc_col: str, text_col: str, spec: TfidfSpec, vocab: DataFrame,
                 max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """(doc, term, weight) of the terms of ``vocab`` (term, idf).  A vocabulary
    below ``max_bytes`` is broadcast: a document is weighed where it is
    counted and leaves the task with the numbers of its terms, to which a
    broadcast join gives the terms.  Else the terms are joined by a shuffle."""
    vocab = vocab.select("term", "idf")
    if payload_bytes(vocab) <= max_bytes:
        spark = corpus.sparkSession
        found = vocab.collect()
        known = spark.sparkContext.broadcast({r["term"]: (k, r["idf"]) for k, r in enumerate(found)})
        words = spark.createDataFrame([(k, r["term"]) for k, r in enumerate(found)], "number int, term string")
        lists = term_lists(corpus, doc_col, text_col, spec.kind, spec.max_words, known=known, sublinear=spec.sublinear)
        return (lists.select(doc_col, F.inline("terms")).join(F.broadcast(words), "number")
                .select(doc_col, "term", "weight"))
    kept = term_counts(corpus, doc_col, text_col, spec.kind, spec.max_words).join(vocab, "term")
    tf = F.col("tf").cast("double")
    if spec.sublinear:
        tf = F.lit(1.0) + F.log(tf)
    w = kept.select(doc_col, "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_col)))
    return w.select(doc_col, "term", (F.col("w") / norm).alias("weight"))


def tfidf(corpus: DataFrame, doc_col: str, text_col: str, spec: TfidfSpec,
          n_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary): weights = (doc, term, weight) for kept terms."""
    if n_docs is None:
        n_docs = corpus.select(doc_col).count()
    stats = term_totals(corpus, doc_col, text_col, spec.kind, spec.max_words)
    vocab = vocabulary_of(stats, n_docs, spec).cache()  # V rows: measured, then broadcast
    return term_weights(corpus, doc_col, text_col, spec, vocab), vocab


def model_text(df: DataFrame, cols=rules.TRAIN_TEXT_COLS) -> Column:
    """Training text: cleaned parts of the text columns present, blanks
    skipped, joined by one space."""
    from riskspark.schemas import available_columns

    present = available_columns(df, cols)
    if not present:
        raise ValueError(f"none of the text columns {list(cols)} is present")
    # each cleaned part is referenced once (``nullif`` would evaluate it twice)
    parts = F.array(*[X.clean_text(F.col(c)) for c in present])
    return X.strip_ws(F.array_join(F.filter(parts, lambda s: s != F.lit("")), " "))


def nnz(weights: DataFrame, docs: DataFrame, doc_col: str) -> DataFrame:
    """(doc, nnz): kept terms per document, 0 for documents with none."""
    per = weights.groupBy(doc_col).agg(F.count(F.lit(1)).alias("nnz"))
    return docs.select(doc_col).join(per, doc_col, "left").select(
        doc_col, F.coalesce(F.col("nnz"), F.lit(0)).cast("bigint").alias("nnz"))


def round_weights(weights: DataFrame, places: int = 6) -> DataFrame:
    return weights.withColumn("weight", N.round_half_away(F.col("weight"), places))
