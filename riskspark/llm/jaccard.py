"""Exact Jaccard join of documents on their sets of word 5-grams, through
PartEnum signatures.

Sets are put into overlapping size windows: a set whose size lies between
two bounds (powers of 1.5) may be the smaller of a pair there, and sets up
to a quarter larger the larger one.  Within a window the feature domain is
cut into a fixed number of parts by hash.  Two sets of similarity 0.8 differ
in at most h = (n + m) / 9 features, each spoils one part, so of the
non-empty parts of either set at least ``slack`` = parts - h are equal in
the other: one signature per non-empty part finds every pair.  A part is
three features or so, more than a chance common shingle fills.  A set too
small or too unevenly spread for a slack of 1 adds each of its features as a
signature.  Of its signatures in a window each set leaves out the largest
``spared(slack)``.  What two sets share loses only from its upper end, by the
larger of their two numbers, so they still share as many as the slack that is
left of either; that takes the place of the slack.

Signatures shared by more than ``HOT`` sets come from common passages or
large groups of copies.  As every link shares ``slack`` signatures, a set
with fewer hot ones than that may drop them all and lose no link.  The rest
(sets made of little else) keep their rarest hot ones, all but slack - 1, of
which a pair sharing hot ones only must share one.  Each set is first compared
with some members of its most frequent one, which joins large groups of near
copies; then, of the hot signatures that still hold several components, all
sets outside the largest of them are compared with its other members too; parities of features by cell bound
the distance of such a pair from below before it becomes a row.

Candidate pairs are verified on the sets themselves: first the best pair of
each document, then those whose ends are still in different components.
Equal sets are one node from the start, so copies are never paired.

Defined cases: null and empty texts and texts of white space have size 0
and are linked with nothing; texts of fewer than five words have one shingle;
a row with a null id gets its size and the component of its text, and links
others like any text; rows repeating an id are linked by their own texts; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.arrowtext import mix, powers, text_slices, tidy, words
from riskspark.llm.graph import components
from riskspark.llm.staging import Stage
from riskspark.plans.strategy import DEFAULT_BROADCAST_BYTES, join_small, payload_bytes

SHINGLE = 5
RATIO = 1.5             # between the bounds of size windows
PARTS = 0.3             # parts of a window, over its upper bound; a quarter is spoiled at most
HOT = 48
PIVOTS = 32
PARITIES = 16           # longs of parities
SPARED = 0.5            # of a slack
SLICE_BYTES = 1 << 20
_BOUNDS = np.unique(np.ceil(np.power(RATIO, np.arange(80))).astype(np.int64))     # up to sets of 10^13 features
_ORDER = powers(SHINGLE + 1, 0xD6E8FEB86659FD93)[1:]


def feature_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and their offsets."""
    n = len(bounds) - 1
    rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        rolled += hashes[j:len(hashes) - SHINGLE + 1 + j] * _ORDER[j] if len(rolled) else np.uint64(0)
    rolled = mix(rolled)
    sets = []
    for d in range(n):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        if hi - lo >= SHINGLE:
            sets.append(np.unique(rolled[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            sets.append(mix((hashes[lo:hi] * _ORDER[:hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def nodes(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, equal for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(features * np.uint64(0x9FB21C651E98DF25)))])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def spared(slack: np.ndarray) -> np.ndarray:
    """Signatures left out at each slack; neither these nor what is left of the slack fall as it rises."""
    return np.floor(SPARED * np.maximum(slack, 0)).astype(np.int64)


def signatures(features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, slack) rows of non-empty sets."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes > 0)
    main = np.searchsorted(_BOUNDS, sizes, side="right") - 1
    # the larger of a pair may lie one window above the smaller
    larger = some[(main[some] > 0) & (4 * sizes[some] <= 5 * (_BOUNDS[main[some]] - 1))]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows, window, larger_only in ((some, main[some], False), (larger, main[larger] - 1, True)):
        if len(rows) == 0:
            continue
        n, top = sizes[rows], _BOUNDS[window + 1]
        parts = np.ceil(PARTS * top).astype(np.int64) + 3
        spoiled = (n + top - 1) // 9 if larger_only else n // 4
        first = np.concatenate([[0], np.cumsum(parts)])
        at = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in rows])
        own = np.repeat(np.arange(len(rows)), n)
        f = features[at]
        cell = first[:-1][own] + ((f >> np.uint64(17)) % parts.astype(np.uint64)[own]).astype(np.int64)
        total = np.zeros(int(first[-1]), np.uint64)
        np.add.at(total, cell, mix(f + np.uint64(0x632BE59BD9B4E019)))
        full = np.flatnonzero(np.bincount(cell, minlength=len(total)))
        text = np.searchsorted(first, full, side="right") - 1
        tag = (full - first[text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (window[text].astype(np.uint64) << np.uint64(50))
        slack = np.bincount(text, minlength=len(rows)) - spoiled
        sig = mix(total[full] + tag).view(np.int64)
        order = np.lexsort((sig, text))
        rank = np.arange(len(sig)) - np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(rows)))])[text]
        kept = order[rank < (np.bincount(text, minlength=len(rows)) - spared(slack))[text]]
        out.append((sig[kept], rows[text[kept]], (slack - spared(slack))[text[kept]]))
        thin = (slack < 1)[own]
        if thin.any():
            raw = mix(f[thin] + (window[own][thin].astype(np.uint64) << np.uint64(40)) + np.uint64(1))
            out.append((raw.view(np.int64), rows[own[thin]], slack[own[thin]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, features, offsets), some texts at a time."""
    for i, _, data, offsets in text_slices(column, SLICE_BYTES):
        hashes, bounds, _ = words(data, offsets)
        yield i, *feature_sets(hashes, bounds)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, f, at in _sets_of(b.column(2)):
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, len(n)), b.column(1).slice(i, len(n)), pa.array(n), pa.array(nodes(f, at), mask=n == 0)],
                names=["doc_id", "text_hash", "n_shingles", "node"])


def _signatures(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The signatures of a set that go to the same of ``parts`` partitions, in
    one row: their exchange carries node, size and slack once for them all."""
    seen: set[int] = set()          # sets this task has emitted already: copies add nothing
    for b in batches:
        for _, f, at in _sets_of(b.column(0)):
            node, n = nodes(f, at), np.diff(at)
            fresh = np.zeros(len(node), bool)
            for d in np.flatnonzero(n):
                if int(node[d]) not in seen:
                    seen.add(int(node[d]))
                    fresh[d] = True
            sig, text, slack = signatures(f, at)
            use = fresh[text] if len(text) else np.zeros(0, bool)
            sig, text, slack = sig[use], text[use], slack[use]
            part = np.mod(sig, parts)
            order = np.lexsort((part, slack, text))
            sig, text, slack, part = sig[order], text[order], slack[order], part[order]
            new = np.ones(len(sig), bool)
            new[1:] = (text[1:] != text[:-1]) | (slack[1:] != slack[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts, len(sig))
            for k in range(0, len(starts), 1 << 15):
                s, e = starts[k:k + (1 << 15)], ends[k:k + (1 << 15) + 1]
                lists = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(sig[e[0]:e[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[s].astype(np.int32)), pa.array(node[text[s]]), pa.array(n[text[s]].astype(np.int32)),
                     pa.array(slack[s].astype(np.int32)), lists], names=["part", "node", "n", "slack", "sigs"])


_SIGS = "part int, node long, n int, slack int, sigs array<long>"
_FOUND = "hot boolean, x long, y long, a int, b int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, node) -> pairs of short runs (x < y nodes, slacks
    a, b) and the rows of long ones (x sig, y node, a size, b slack).  A run
    may span many batches; of an unfinished one at most HOT rows are held."""
    held = [np.zeros(0, np.int64) for _ in range(4)]
    hot_sig: int | None = None

    def emit(hot: bool, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(cols[0]), 1 << 16):
            c = [x[k:k + (1 << 16)] for x in cols]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c[0]), hot)), pa.array(c[0]), pa.array(c[1]), pa.array(c[2].astype(np.int32)),
                 pa.array(c[3].astype(np.int32))], names=["hot", "x", "y", "a", "b"])

    def work(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, hot_sig
        sig, node = cols[0], cols[1]
        if len(sig) == 0:
            return
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        cols = [c[keep] for c in cols]
        sig = cols[0]
        edges = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
        size = np.diff(edges)
        long = size > HOT
        if hot_sig is not None and sig[0] == hot_sig:
            long[0] = True
        end = len(size)
        if not last:
            if long[-1]:
                hot_sig, rest = int(sig[-1]), [c[-1:] for c in cols]
            else:
                end -= 1
                rest = [c[edges[-2]:] for c in cols]
                hot_sig = hot_sig if end == 0 and hot_sig == sig[0] else None
        else:
            rest = [np.zeros(0, np.int64) for _ in range(4)]
        for length in np.unique(size[:end][~long[:end] & (size[:end] > 1)]):
            at = edges[:-1][:end][(size[:end] == length) & ~long[:end]]
            i, j = np.triu_indices(int(length), 1)
            left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            a, b = cols[2][left], cols[2][right]
            near = 100 * np.minimum(a, b) >= 80 * np.maximum(a, b)
            left, right = left[near], right[near]
            yield from emit(False, cols[1][left], cols[1][right], cols[3][left], cols[3][right])
        if long[:end].any():
            at = np.flatnonzero(np.repeat(long[:end], size[:end]))
            if not last and long[-1]:
                at = at[:-1]        # the last row goes on as the run's head
            yield from emit(True, *(c[at] for c in cols))
        held = rest

    for b in batches:
        new = [b.column(i).to_numpy().astype(np.int64) for i in range(4)]
        yield from work([np.concatenate([h, c]) for h, c in zip(held, new)], False)
    yield from work(held, True)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, again, f) of the texts that are what their node says."""
    for b in batches:
        for i, f, at in _sets_of(b.column(2)):
            known = b.column(0).slice(i, len(at) - 1).to_numpy()
            right = np.flatnonzero(nodes(f, at) == known)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[right]), b.column(1).slice(i, len(at) - 1).take(pa.array(right)),
                 pa.array([f[at[k]:at[k + 1]].tobytes() for k in right], pa.binary())], names=["node", "again", "f"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity of the number of features in each of 64 * PARITIES cells; the
    parities of two sets differ in no more cells than the sets in features."""
    for b in batches:
        out = np.zeros((b.num_rows, 64 * PARITIES), np.uint8)
        for k, raw in enumerate(b.column(1)):
            cell = (_unpack(raw.as_py()) % np.uint64(64 * PARITIES)).astype(np.int64)
            out[k] = np.bincount(cell, minlength=64 * PARITIES) & 1
        words_ = np.packbits(out, axis=1, bitorder="little").view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, words_.size + 1, PARITIES, dtype=np.int32), words_.ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "bits"])


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = np.zeros(b.num_rows, bool)
        for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            u, v = _unpack(x.as_py()), _unpack(y.as_py())
            both = len(np.intersect1d(u, v, assume_unique=True))
            ok[k] = 100 * both >= 80 * (len(u) + len(v) - both)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], names=["x", "y", "linked"])


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the classes of linked
    documents, named by their smallest id."""
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    rows = stage.write(source.mapInArrow(tidy(_sizes), "doc_id long, text_hash long, n_shingles long, node long"), "rows")
    # copies are one node; a row of the smallest id stands for it, one without an id only where there is no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = stage.write(rows.where("node IS NOT NULL").groupBy("node").agg(first.alias("row"))
                          .select("node", "row.*").withColumnRenamed("doc_id", "least"), "classes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sigs = (source.select("text").mapInArrow(tidy(partial(_signatures, parts=parts)), _SIGS).repartitionById(parts, "part")
            .select(F.explode("sigs").alias("sig"), "node", "n", "slack").sortWithinPartitions("sig", "node"))
    found = stage.write(sigs.mapInArrow(tidy(_runs), _FOUND), "found")
    # a set with fewer hot signatures than its slack may do without them
    hot = found.where("hot").select(F.col("x").alias("sig"), F.col("y").alias("node"), F.col("a").alias("n"), F.col("b").alias("slack"))
    dropped = stage.write(hot.groupBy("node", "slack").agg(F.count("*").alias("d")), "dropped")
    heavy = dropped.where("d >= slack")
    met = hot.groupBy("sig").agg(F.count("*").alias("freq"))
    rarest = F.row_number().over(Window.partitionBy("node", "slack").orderBy("freq", "sig"))
    hot = stage.write(hot.join(heavy, ["node", "slack"]).join(met, "sig").withColumn("r", rarest)
                      .where(F.col("r") <= F.col("d") - F.greatest("slack", F.lit(1)) + 1).select("sig", "node", "n", "freq"), "hot")
    # a link shares as many signatures as either set's slack, all but the hot ones here
    pairs = found.where("NOT hot").groupBy("x", "y", "a", "b").agg(F.count("*").alias("near"))
    for node, slack in (("x", "a"), ("y", "b")):
        pairs = (join_small(pairs, dropped.select(F.col("node").alias(node), F.col("slack").alias(slack), "d"), [node, slack], "left")
                 .where(F.col("near") >= F.col(slack) - F.coalesce("d", F.lit(0))).drop("d"))
    pairs = pairs.select("x", "y", "near")

    pairs = stage.write(pairs.groupBy("x", "y").agg(F.max("near").alias("near")), "pairs")
    stage.release("found", "dropped")

    sets_made: list[DataFrame] = []
    bits: list[DataFrame] = []

    def sets() -> DataFrame:
        """Features of every node in a candidate pair or a hot signature."""
        if not sets_made:
            wanted = (pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node")))
                      .unionByName(hot.select("node")).distinct().join(classes, "node"))
            # rows repeating id and text bring the same set again
            same = [F.col("least").eqNullSafe(F.col("doc_id")), F.col("text_hash") == F.col("row_hash")]
            times = (rows.select("doc_id", F.col("text_hash").alias("row_hash"), F.col("node").alias("row_node"))
                     .groupBy("doc_id", "row_hash", "row_node").agg(F.count("*").alias("times")).where("times > 1"))
            wanted = wanted.join(times, [*same, F.col("node") == F.col("row_node")], "left").select(
                "node", "least", F.col("text_hash").alias("row_hash"), F.col("times").isNotNull().alias("again"))
            wanted = stage.write(wanted, "wanted")
            texts = join_small(source.where("text IS NOT NULL"), wanted, [same[1], same[0]])
            made = stage.write(texts.select("node", "again", "text").mapInArrow(tidy(_feature_rows), "node long, again boolean, f binary"), "made")
            once = made.where("NOT again").select("node", "f")
            twice = made.where("again").groupBy("node").agg(F.max("f").alias("f"))
            sets_made.append(stage.write(once.unionByName(twice), "sets"))
            stage.release("made", "wanted")
        return sets_made[0]

    def parities() -> DataFrame:
        """The parities of the sets of hot rows."""
        if not bits:
            few = sets().join(hot.select("node").distinct(), "node", "left_semi")
            bits.append(stage.write(few.mapInArrow(tidy(_parities), "node long, bits array<long>"), "bits"))
        return bits[0]

    def against_members(open_rows: DataFrame, members: DataFrame, first: int, count: int) -> DataFrame:
        """Pairs of open rows with members first + 1 .. first + count (by node)
        of their signature, as far as sizes, components and parities allow a link."""
        rank = F.row_number().over(Window.partitionBy("sig").orderBy("node"))
        chosen = members.withColumn("r", rank).where(F.col("r") <= first + count).where(F.col("r") > first)
        chosen = join_small(chosen, open_rows.select("sig").distinct(), "sig", "left_semi").join(parities(), "node")
        chosen = stage.write(chosen.select("sig", F.col("node").alias("other"), F.col("n").alias("m"),
                                           F.col("comp").alias("other_comp"), F.col("bits").alias("other_bits")), f"members{first}")
        differ = " + ".join(f"bit_count(bits[{i}] ^ other_bits[{i}])" for i in range(PARITIES))
        return (open_rows.join(parities(), "node").join(chosen, "sig")
                .where("node <> other AND comp <> other_comp AND 100 * least(n, m) >= 80 * greatest(n, m)")
                .where(f"9 * ({differ}) <= n + m")       # sets this similar differ in (n + m) / 9 features at most
                .select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct())

    def verified(some: DataFrame, name: str) -> DataFrame:
        ends = some.select(F.col("x").alias("node")).unionByName(some.select(F.col("y").alias("node"))).distinct()
        # few nodes go to the sets; for many the sets are dealt to the pairs as they are
        held = sets().join(F.broadcast(ends), "node", "left_semi") if payload_bytes(ends) <= DEFAULT_BROADCAST_BYTES else sets()
        fx, fy = (held.select(F.col("node").alias(c), F.col("f").alias(f"f{c}")) for c in ("x", "y"))
        return stage.write(some.select("x", "y").join(fx, "x").join(fy, "y").select("x", "y", "fx", "fy")
                           .mapInArrow(tidy(_linked), "x long, y long, linked boolean"), name)

    def with_comp(df: DataFrame, comp: DataFrame, col: str, out: str) -> DataFrame:
        return (df.join(comp.select(F.col("node").alias(col), F.col("root").alias(out)), col, "left")
                .withColumn(out, F.coalesce(out, col)))

    comp = _link_up(stage, pairs, hot, verified, with_comp, against_members)
    named = (classes.join(comp, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stage.write(named.join(least, "root").select("node", "component_id"), "labels")
    out = rows.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    stage.release("pairs", "hot", "classes", *(["sets"] if sets_made else []))
    return out


def _link_up(stage: Stage, pairs: DataFrame, hot: DataFrame, verified, with_comp, against_members) -> DataFrame:
    """(node, root) of the links among the candidates."""
    if pairs.isEmpty() and hot.isEmpty():
        return stage.spark.createDataFrame([], "node long, root long")
    best = (pairs.select(F.col("x").alias("u"), "near", "x", "y").unionByName(pairs.select(F.col("y").alias("u"), "near", "x", "y"))
            .groupBy("u").agg(F.max(F.struct("near", "x", "y")).alias("m")).select("m.x", "m.y").distinct())
    tested = verified(best, "first")
    links = tested.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    comp = components(links, stage, "cc1")

    def apart(some: DataFrame) -> DataFrame:
        return with_comp(with_comp(some, comp, "x", "cx"), comp, "y", "cy").where("cx != cy")

    def merge(more: DataFrame, name: str) -> DataFrame:
        """Components after further links between known components."""
        ends = with_comp(with_comp(more.where("linked").select("x", "y"), comp, "x", "a"), comp, "y", "b").select("a", "b")
        top = stage.write(components(ends, stage, name), f"{name}-top")
        old = comp.join(top.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left") \
            .select("node", F.coalesce("new", "root").alias("root"))
        fresh = top.join(comp.select("node"), "node", "left_anti")
        return stage.write(old.unionByName(fresh), f"{name}-all")

    rest = stage.write(apart(pairs.join(tested.select("x", "y"), ["x", "y"], "left_anti")).select("x", "y"), "rest")
    more = verified(rest, "second").where("linked")
    if not more.isEmpty():
        comp = merge(more, "cc2")
    if hot.isEmpty():
        return comp
    # each set against some members of its most frequent hot signature
    one = hot.groupBy("node").agg(F.max(F.struct("freq", "sig", "n")).alias("m")).select("node", "m.sig", "m.n")
    one = stage.write(with_comp(one, comp, "node", "comp"), "one")
    more = verified(stage.write(against_members(one, one, 0, PIVOTS), "one-more"), "one-tested").where("linked")
    if not more.isEmpty():
        comp = merge(more, "cc3")
    stage.release("one", "one-more", "one-tested")
    # The largest component of a signature is known by one of its sets: components only merge, so a set outside it
    # now was outside before, and of two sets in different components one is outside: it meets the other in its turn.
    hot = hot.drop("freq")
    named = stage.write(with_comp(hot, comp, "node", "comp"), "named")
    parts = named.groupBy("sig", "comp").agg(F.count("*").alias("size"), F.min("node").alias("rep"))
    largest = parts.groupBy("sig").agg(F.max(F.struct("size", "rep")).alias("m"), F.count("*").alias("k")).where("k > 1")
    largest = stage.write(largest.select("sig", F.col("m.rep").alias("rep")), "largest")
    first, count = 0, PIVOTS
    while True:
        size = named.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > first).select("sig")
        top = with_comp(largest.join(size, "sig", "left_semi"), comp, "rep", "top").select("sig", "top")
        outside = stage.write(join_small(named, top, "sig").where("comp <> top").drop("top"), f"open{first}")
        if outside.isEmpty():
            return comp
        more = stage.write(against_members(outside, named, first, count), f"more{first}")
        more = verified(more, f"tested{first}").where("linked")
        if not more.isEmpty():
            comp = merge(more, f"cc4-{first}")
        stage.release(f"open{first}", f"more{first}", f"tested{first}", f"members{first}")
        first, count = first + count, 4 * count
        named = stage.write(with_comp(hot, comp, "node", "comp"), f"named{first}")
