"""Matching texts with a user's dictionary: one automaton, one pass a text.

The built-in lists are matched by one fused ``contains`` expression
(``functions.text.keyword_hits``).  A user dictionary is a table of any
size with entries of any length.  Its lower-cased entries become an
Aho-Corasick automaton that reads each text once, whatever the number of
entries, over Arrow batches.

The automaton's size follows from the characters of the entries, which are
counted first.  Up to ``part_chars`` of them the entries are broadcast and
each worker builds the automaton once.  A larger dictionary is dealt by
hash into parts of that size; every text visits every part.  Entries and
texts then meet by a shuffle, sorted so that the entries of a part come
first: a task builds one automaton at a time, and neither the driver nor a
worker holds the dictionary.  Hits are united per id in either case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_CHARS = 1 << 20        # characters of the entries of one automaton, some 100 bytes each
FLUSH_ROWS = 1 << 16


class _Matcher:
    """Distinct entries found in each text."""

    def __init__(self, words: list[str] = ()):
        import ahocorasick

        self.tree, self.words, self.ready = ahocorasick.Automaton(), [], False
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        self.tree.add_word(word, len(self.words))
        self.words.append(word)

    def find(self, text: str) -> list[int]:
        if not self.words:
            return []
        if not self.ready:
            self.tree.make_automaton()
            self.ready = True
        return list({i for _, i in self.tree.iter(text)})


_matchers: dict[str, _Matcher] = {}     # the latest dictionary of this worker


def _matcher(key: str, words: list[str]) -> _Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = _Matcher(words)
    return _matchers[key]


def _found(ids: pa.Array, rows: list[int], words: list[str], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(words, pa.string())], names=names)


def _broadcast_matches(texts: DataFrame, words: list[str], schema: T.StructType) -> DataFrame:
    shared, key = texts.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, shared.value)
        for b in batches:
            rows, hits = [], []
            for r, t in enumerate(b.column(1)):
                some = m.find(t.as_py())
                rows += [r] * len(some)
                hits += [m.words[i] for i in some]
                if len(rows) > FLUSH_ROWS:
                    yield _found(b.column(0), rows, hits, names)
                    rows, hits = [], []
            yield _found(b.column(0), rows, hits, names)

    return texts.mapInArrow(run, schema)


def _dealt_matches(texts: DataFrame, entries: DataFrame, parts: int, schema: T.StructType) -> DataFrame:
    """Entries and texts by (part, salt): each salt has a share of the texts and all entries of its part."""
    spark = texts.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))
    id_col, id_type = schema.names[0], schema[0].dataType
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = entries.select(F.pmod(F.xxhash64("__kw"), F.lit(parts)).cast("int").alias("__part"), each(salts).alias("__salt"),
                          F.lit(False).alias("__is_text"), F.lit(None).cast(id_type).alias(id_col), F.col("__kw").alias("__t"))
    theirs = texts.select(each(parts).alias("__part"), F.pmod(F.xxhash64(id_col, "__lc"), F.lit(salts)).cast("int").alias("__salt"),
                          F.lit(True).alias("__is_text"), F.col(id_col), F.col("__lc").alias("__t"))
    order = ["__part", "__salt", "__is_text"]
    dealt = mine.unionByName(theirs).repartition("__part", "__salt").sortWithinPartitions(*order)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m = None, _Matcher()
        for b in batches:
            rows, hits = [], []
            part, salt, is_text = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for r in range(b.num_rows):
                if (part[r], salt[r]) != at:
                    at, m = (part[r], salt[r]), _Matcher()
                t = b.column(4)[r].as_py()
                if not is_text[r]:
                    m.add(t)
                    continue
                some = m.find(t)
                rows += [r] * len(some)
                hits += [m.words[i] for i in some]
                if len(rows) > FLUSH_ROWS:
                    yield _found(b.column(3), rows, hits, names)
                    rows, hits = [], []
            yield _found(b.column(3), rows, hits, names)

    return dealt.select(*order, id_col, "__t").mapInArrow(run, schema)


def keyword_matches(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str,
                    keyword_col: str = "keyword", part_chars: int = PART_CHARS) -> DataFrame:
    """(id, keyword): the dictionary entries, lower-cased, that occur as
    substrings of lower(text); one row per id and entry.  NULL and empty
    texts and entries match nothing; an id that repeats has the entries of
    all its texts; a NULL id is an id like any other."""
    entries = dictionary.select(F.lower(F.col(keyword_col)).alias("__kw")).filter(F.length("__kw") > 0).distinct()
    chars = entries.agg(F.coalesce(F.sum(F.length("__kw")), F.lit(0))).first()[0]
    low = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("__lc")).filter(F.length("__lc") > 0)
    schema = T.StructType([T.StructField(id_col, texts.schema[id_col].dataType), T.StructField("keyword", T.StringType())])
    if chars <= part_chars:
        found = _broadcast_matches(low, sorted(r[0] for r in entries.collect()), schema)    # at most part_chars characters
    else:
        found = _dealt_matches(low, entries, -(-chars // part_chars), schema)
    return found.distinct()


def keyword_hits_join(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str,
                      keyword_col: str = "keyword", part_chars: int = PART_CHARS) -> DataFrame:
    """(id, kw_hits BIGINT): number of distinct dictionary entries occurring as
    substrings of lower(text).  Texts without a hit, NULL texts among them,
    get 0; NULL and empty entries match nothing; an id that repeats gets one
    row, with the entries of all its texts."""
    found = keyword_matches(texts, dictionary, id_col, text_col, keyword_col, part_chars)
    rows = found.select(id_col, "keyword").unionByName(texts.select(id_col, F.lit(None).cast("string").alias("keyword")))
    return rows.groupBy(id_col).agg(F.count("keyword").cast("bigint").alias("kw_hits"))


def keyword_posts(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str,
                  keyword_col: str = "keyword", part_chars: int = PART_CHARS) -> DataFrame:
    """(keyword, n_texts BIGINT, first_id): ids holding each entry, 0 and NULL for an entry found nowhere."""
    entries = dictionary.select(F.lower(F.col(keyword_col)).alias("keyword")).filter(F.length("keyword") > 0).distinct()
    found = keyword_matches(texts, dictionary, id_col, text_col, keyword_col, part_chars)
    rows = found.select("keyword", F.col(id_col).alias("__id"), F.lit(1).alias("__one")).unionByName(
        entries.select("keyword", F.lit(None).cast(texts.schema[id_col].dataType).alias("__id"), F.lit(None).cast("int").alias("__one")))
    return rows.groupBy("keyword").agg(F.count("__one").alias("n_texts"), F.min("__id").alias("first_id"))
