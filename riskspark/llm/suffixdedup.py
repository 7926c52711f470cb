"""Removal of every byte covered by a long string that also starts elsewhere.

The repeated strings are found by induced suffix sorting (``inducedsort``).
Only text that can repeat is sorted: the least hash among the k-grams of a
window of ``length`` bytes is the same for equal windows, so each text is
cut into segments of consecutive windows with the same least hash, and a
hash met in one segment only rules its windows out (unless the k-gram
occurs twice in that segment).  Segments that are equal byte for byte repeat
as a whole and are marked at once.  The different segments that share a hash
go, by hash, to the shards that are suffix-sorted; each task sorts its
shards one after the other.  A hash with more text than ``HOT_BYTES`` (a
k-gram or passage of very many texts, each with its own neighbours) goes to
no shard: its windows are counted by a 128-bit hash of all their bytes, with
partial counts, and those met twice are marked.  A further text equal to one
its task has read adds its marks and no segments, so copies are combined
before the shuffle.

Defined cases: null and empty texts and texts shorter than ``length`` lose
nothing; strings are judged on the input, overlaps included; a null id and
repeated rows are rows like others (repeated rows repeat each other);
other columns are not read; an empty table gives an empty result.  Removal
may end inside a character; ``deduplicated`` drops such broken characters
from its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.arrowtext import give_back, mix, powers, slices, text_bytes, tidy
from riskspark.llm.inducedsort import repeated_starts
from riskspark.llm.staging import Stage
from riskspark.plans.strategy import DEFAULT_BROADCAST_BYTES

LENGTH = 200
GRAM = 16
SLICE_BYTES = 1 << 19
MAX_WINDOWS = 4096      # windows in one segment; longer runs are cut
SHARD_BYTES = 1 << 20   # bytes sorted together, unless one hash alone has more,
HOT_BYTES = 4 << 20     # which is no hash with more than this
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xAEF17502108EF2D9
_INV2 = pow(_BASE2, -1, 1 << 64)
_TABLE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_TABLE2 = np.random.default_rng(32).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - have:]) if width > have else out


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, least hash, content hash, recurs) of the segments
    of some texts; ``recurs``: the k-gram occurs twice in the segment."""
    gram = min(GRAM, length)
    width = length - gram + 1
    n = len(data)
    none = tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if n < length:
        return none
    p, q = powers(n, _BASE), powers(n, _INV)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * p, out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * q[:n - gram + 1])
    low = _least(h, width)                                   # of the window at each position
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(low)]
    ok = np.arange(len(low)) + length <= offsets[1:][text]   # windows within their text
    at = np.flatnonzero(ok)
    if len(at) == 0:
        return none
    local = at - offsets[:-1][text[at]]
    new = np.ones(len(at), bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]) \
        | (local[1:] % MAX_WINDOWS == 0)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    value = low[start]
    end = start + windows + length - 1
    content = mix((sums[end] - sums[start]) * q[start] + windows.astype(np.uint64))
    # A window that repeats within its segment makes the k-gram recur there with some period, so that it is met
    # both as the first k-gram of a window and as the last k-gram of one, at different places.
    opens = np.concatenate([[0], np.cumsum(h[:len(low)] == low)])
    closes = np.concatenate([[0], np.cumsum(h[width - 1:] == low)])
    stop = start + windows
    inner = np.minimum(start + width - 1, stop)
    met = opens[stop] - opens[start] + closes[stop] - closes[start] - (opens[stop] - opens[inner])
    recurs = met > 1
    return text[start], start - offsets[:-1][text[start]], windows, value, content, recurs


def _text_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=12).digest()


_SEG = "least long, content long, rid long, at int, windows int, recurs boolean"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) -> segment rows.  The second of equal texts in a task
    repeats the first one's segments (so they count as two), later ones add
    the mark that all of their windows repeat (least 0, content 0)."""
    met: dict[bytes, int] = {}
    names = ["least", "content", "rid", "at", "windows", "recurs"]
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        rids = b.column(0).to_numpy()
        for i, j in slices(offsets, SLICE_BYTES):
            lo = offsets[i]
            part, bounds = data[lo:offsets[j]], offsets[i:j + 1] - lo
            sizes = np.diff(bounds)
            again = np.zeros(j - i, bool)
            for d in np.flatnonzero(sizes >= LENGTH):
                k = _text_key(part[bounds[d]:bounds[d + 1]].tobytes())
                met[k] = met.get(k, 0) + 1
                again[d] = met[k] > 2
            text, at, windows, least, content, recurs = segments(part, bounds)
            use = ~again[text] if len(text) else np.zeros(0, bool)
            whole = np.flatnonzero(again)
            z = len(whole)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([least[use].view(np.int64), np.zeros(z, np.int64)])),
                pa.array(np.concatenate([content[use].view(np.int64), np.zeros(z, np.int64)])),
                pa.array(np.concatenate([rids[i:j][text[use]], rids[i:j][whole]])),
                pa.array(np.concatenate([at[use], np.zeros(z, np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([windows[use], sizes[whole] - LENGTH + 1]).astype(np.int32)),
                pa.array(np.concatenate([recurs[use], np.zeros(z, bool)]))], names=names)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, pieces) -> the bytes of each piece."""
    def rows_of(part: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        least, rid, at, raw = zip(*part)
        return pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(rid, pa.int64()), pa.array(at, pa.int32()),
                                           pa.array(raw, pa.binary())], names=["least", "rid", "at", "piece"])

    for b in batches:
        part, size = [], 0
        for r, text, pieces in zip(b.column(0), b.column(1), b.column(2)):
            t = text.as_py().encode("utf-8", "surrogatepass")
            for p in pieces.as_py():
                part.append((p["least"], r.as_py(), p["at"], t[p["at"]:p["at"] + p["windows"] + LENGTH - 1]))
                size += len(part[-1][3])
                if size > SLICE_BYTES:
                    yield rows_of(part)
                    part, size = [], 0
        if part:
            yield rows_of(part)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, pieces) -> (a, b, rid, at): two hashes of each window of the pieces."""
    def hashed(part: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
        n = len(data)
        sizes = np.array([len(x[2]) for x in part], np.int64)
        windows = sizes - LENGTH + 1
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + inner
        cols = []
        for table, base, inv in ((_TABLE, _BASE, _INV), (_TABLE2, _BASE2, _INV2)):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[data] * powers(n, base), out=sums[1:])
            cols.append(pa.array(mix((sums[at + LENGTH] - sums[at]) * powers(n, inv)[at]).view(np.int64)))
        rid = np.repeat(np.array([x[0] for x in part], np.int64), windows)
        start = np.repeat(np.array([x[1] for x in part], np.int64), windows) + inner
        return pa.RecordBatch.from_arrays([*cols, pa.array(rid), pa.array(start.astype(np.int32))], names=["a", "b", "rid", "at"])

    for b in batches:
        part, size = [], 0
        for r, text, pieces in zip(b.column(0), b.column(1), b.column(2)):
            t = text.as_py().encode("utf-8", "surrogatepass")
            for p in pieces.as_py():
                part.append((r.as_py(), p["at"], t[p["at"]:p["at"] + p["windows"] + LENGTH - 1]))
                size += len(part[-1][2])
                if size > SLICE_BYTES:
                    yield hashed(part)
                    part, size = [], 0
        if part:
            yield hashed(part)


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by hash -> marks (rid, at, windows).  A shard holds whole
    hashes; pieces that repeated rows bring twice are sorted once."""
    rows: list[tuple[int, int, int, bytes]] = []
    size = 0

    def sort_now(part: list) -> Iterator[pa.RecordBatch]:
        rid, at, n = [], [], []
        part = list({x[:3]: x for x in part}.values())
        for (_, r, a, _), starts in zip(part, repeated_starts([x[3] for x in part], LENGTH)):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                for run in np.split(starts, cut):
                    rid.append(r)
                    at.append(a + int(run[0]))
                    n.append(len(run))
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())],
                                         names=["rid", "at", "windows"])

    for b in batches:
        for cells in zip(*(b.column(i) for i in range(4))):
            row = tuple(x.as_py() for x in cells)
            if size > SHARD_BYTES and row[0] != rows[-1][0]:
                yield from sort_now(rows)
                rows, size = [], 0
                give_back()         # what the sort has freed, before the next shard
            rows.append(row)
            size += len(row[3])
    if rows:
        yield from sort_now(rows)


def _hot(picked: DataFrame) -> DataFrame:
    """(least): hashes whose pieces are too much for one shard; all text over HOT_BYTES many at most."""
    return (picked.groupBy("least").agg(F.sum(F.col("windows").cast("long") + LENGTH - 1).alias("bytes"))
            .where(F.col("bytes") > HOT_BYTES).select("least"))


def _hot_marks(rows: DataFrame, picked: DataFrame, stage: Stage) -> DataFrame:
    """(rid, at, windows): the windows of pieces that repeat, counted by their hashes."""
    lists = picked.groupBy("rid").agg(F.collect_list(F.struct("at", "windows")).alias("pieces"))
    met = stage.write(_join_lists(rows, lists, picked.count()).select("rid", "text", "pieces").mapInArrow(
        tidy(_window_rows), "a long, b long, rid long, at int"), "windows")
    twice = stage.write(met.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "twice")
    found = stage.write(met.join(twice, ["a", "b"], "left_semi").select("rid", "at").distinct(), "found")
    run = F.col("at") - F.row_number().over(Window.partitionBy("rid").orderBy("at"))      # constant along a run
    return found.withColumn("run", run).groupBy("rid", "run").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("windows")) \
        .select("rid", "at", "windows")


def removal_marks(rows: DataFrame, stage: Stage) -> DataFrame:
    """(rid, at, windows) for rows (rid, text): the runs of windows that repeat.

    Segments are counted by content with partial counts per task, so a
    passage that very many texts share is no hot group; the joins back read
    written tables, which adaptive execution may split by a hot key."""
    segs = stage.write(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(tidy(_segment_rows), _SEG), "segments")
    whole = (F.col("least") == 0) & (F.col("content") == 0)
    same = ["least", "content", "windows"]
    classes = stage.write(segs.where(~whole).groupBy(*same).agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"), F.max("recurs").alias("recurs")), "classes")
    several = stage.write(classes.groupBy("least").agg(F.count("*").alias("k")).where("k > 1").select("least"), "several")
    alone = classes.where("recurs").join(several, "least", "left_anti")
    picked = stage.write(classes.join(several, "least", "left_semi").unionByName(alone)
                         .select("least", "one.rid", "one.at", "windows"), "picked")
    equal = segs.where(~whole).join(classes.where("n > 1").select(*same), same, "left_semi")

    hot = stage.write(_hot(picked), "hot")
    crowded = not hot.isEmpty()
    if crowded:
        hot_marks = _hot_marks(rows, picked.join(F.broadcast(hot), "least", "left_semi"), stage)
        picked = picked.join(F.broadcast(hot), "least", "left_anti")
    lists = picked.groupBy("rid").agg(F.collect_list(F.struct("least", "at", "windows")).alias("pieces"))
    pieces = _join_lists(rows, lists, picked.count()).select("rid", "text", "pieces").mapInArrow(
        tidy(_piece_rows), "least long, rid long, at int, piece binary")
    sorted_marks = pieces.repartition("least").sortWithinPartitions("least").mapInArrow(
        tidy(_sort_shards), "rid long, at int, windows int")
    marks = (segs.where(whole).select("rid", "at", "windows").unionByName(equal.select("rid", "at", "windows"))
             .unionByName(sorted_marks))
    marks = stage.write(marks.unionByName(hot_marks) if crowded else marks, "marks")
    stage.release("segments", "classes", "several", "picked", "hot", *(["windows", "twice", "found"] if crowded else []))
    return marks


def _join_lists(rows: DataFrame, lists: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Rows joined with lists of ``n`` entries in all: 24 bytes an entry, so
    the size is known and small lists are broadcast; else texts are shuffled."""
    if n * 24 <= DEFAULT_BROADCAST_BYTES:
        lists = F.broadcast(lists)
    return rows.join(lists, "rid", how)


def _kept(text: str | None, marks: list[dict] | None) -> tuple[bytes, int, int, int]:
    """(remaining bytes, size, removed, spans) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not marks:
        return raw, len(raw), 0, 0
    step = np.zeros(len(raw) + 1, np.int32)
    at = np.array([m["at"] for m in marks])
    np.add.at(step, at, 1)
    np.add.at(step, at + np.array([m["windows"] for m in marks]) + LENGTH - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), spans


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of ``docs``, in order, then the ``marks`` of its text."""
    stage = Stage(docs.sparkSession, "suffix")
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"), F.col(text).alias("text"))
    marks = removal_marks(rows, stage)
    lists = marks.groupBy("rid").agg(F.collect_set(F.struct("at", "windows")).alias("marks"))
    whole = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"), *[
        docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return _join_lists(whole, lists, marks.count(), "left").drop("rid")


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_kept(t, m) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)),
                 pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
                          + [T.StructField("kept_sha256", T.StringType())])
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _marked(slim, "doc_id", "text").mapInArrow(tidy(run), schema)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``; all rows and columns stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if not m else _kept(t, m)[0].decode("utf-8", "ignore")
                   for t, m in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=docs_names)

    docs_names = list(docs.columns)
    return _marked(docs, doc_id, text).mapInArrow(tidy(run), docs.schema)
