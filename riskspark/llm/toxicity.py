"""Convolutional text classifier for toxicity, trained in numpy.

A word is the sum of three hashed embeddings (the word and two prefixes, so
that inflected forms share weight).  Filters of several widths slide over
the words of the whole text, each keeps its maximum, and a logistic unit
reads the maxima.  Thresholds are calibrated by language: a hashed-word
model learned on the same rows guesses a text's language from the text
alone, and the score is shifted on the logit scale so that the language's
own threshold falls on ``CUT``.

Every labelled row that is not held out is learned from, with its whole
text: three rows in four, by a hash of the id, fit the weights, the fourth
sets the thresholds.  The rows are dealt into shards that tasks stream in a
fixed order, some texts at a time.  Word counts by label and by language are
summed over all shards.  In an epoch each shard goes through its rows from
the common weights; then weights are averaged over the shards, embeddings
over those that moved them.  The driver sees weights and counts, no rows:
their size depends on the number of buckets and languages.  Thresholds come
from the counts of all scores of the fourth part, in cells of 1/256 of a logit.

Defined cases: a null, empty or white-space-only text has no words, its
maxima are 0 and its score is that of the bias, below ``CUT``; null labels
and labels of missing documents are not learned from; several labels of one
document count as toxic if one says so; rows that repeat an id are learned
from each; if one part has no row of a label, all rows fit and all set the
thresholds; without a positive and a negative row to learn from every score
is 0; repeated rows score alike; further columns are untouched.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.arrowtext import text_slices, tidy, words
from riskspark.plans.strategy import join_small

CUT = 0.3
WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 12
BUCKETS = 1 << 16
PREFIXES = (5, 7)       # bytes
EPOCHS = (2, 6)         # at least and at most; between them so many that STEPS rows are seen
STEPS = 36_000
BATCH = 16              # rows of a gradient step
SHARD_ROWS = 8192
MOST_SHARDS = 64        # what is summed for an epoch grows with the shards
BLOCK = 1 << 13         # buckets of a row of counts or weights
CELLS = 256             # of a logit, for thresholds
SLICE_BYTES = 1 << 19   # texts hashed and scored at once


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4.  A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash buckets of every word (word, prefixes) and the offsets of the texts."""
    h, bounds, pre = words(data, offsets, PREFIXES)
    return [(x % np.uint64(BUCKETS)).astype(np.int32) for x in (h, *pre)], bounds


class Model:
    """Weights plus language model and thresholds; small and picklable."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = [rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) for _ in range(1 + len(PREFIXES))]
        self.conv = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-2.0)
        self.langs: list[str] = []
        self.lang_table = np.zeros((BUCKETS, 0), np.float32)
        self.threshold = np.zeros(0)     # by language, on the logit scale
        self.common = 0.0
        self.trained = False

    # -- forward ---------------------------------------------------------
    def maxima(self, idx: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
        """Rectified filter maxima of each text (texts x filters)."""
        n = len(bounds) - 1
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        x = sum(e[i] for e, i in zip(self.emb, idx))
        if len(x) == 0:
            return pooled
        size = np.diff(bounds)
        for k, (w, weights, b) in enumerate(zip(WIDTHS, self.conv, self.bias)):
            if len(x) < w:
                continue
            y = x[:len(x) - w + 1] @ weights[0]
            for j in range(1, w):
                y += x[j:len(x) - w + 1 + j] @ weights[j]
            rows = np.flatnonzero(size >= w)
            if len(rows) == 0:
                continue
            # a text of s words has s - w + 1 windows, starting at its first word
            cuts = np.stack([bounds[rows], bounds[rows + 1] - w + 1], 1).ravel()
            y = np.concatenate([y, y[-1:]])      # a closing index for the last text
            pooled[rows, k * FILTERS:(k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, cuts)[::2] + b, 0)
        return pooled

    def logits(self, idx: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
        return self.maxima(idx, bounds) @ self.out + self.out_bias

    def language(self, idx: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
        """Index of the most likely language of each text; -1 without words."""
        if not self.langs or bounds[-1] == bounds[0]:
            return np.full(len(bounds) - 1, -1)
        sums = np.concatenate([np.zeros((1, len(self.langs))),
                               np.cumsum(self.lang_table[idx[0]], 0, dtype=np.float64)])
        return np.where(np.diff(bounds) > 0, np.argmax(sums[bounds[1:]] - sums[bounds[:-1]], 1), -1)

    def score(self, idx: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(bounds) - 1)
        lang = self.language(idx, bounds)
        at = np.concatenate([self.threshold, [self.common]])[lang]
        z = self.logits(idx, bounds).astype(np.float64) - at + np.log(CUT / (1 - CUT))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.where(np.diff(bounds) > 0, s, np.minimum(s, CUT / 2))

    # -- training --------------------------------------------------------
    def dense(self) -> list[np.ndarray]:
        return [*self.conv, *self.bias, self.out]

    def learn(self, state: "State", idx: list[np.ndarray], bounds: np.ndarray, y: np.ndarray, pos_weight: float,
              rate: float, rng: np.random.Generator) -> None:
        """Gradient steps over the texts, ``BATCH`` at a time."""
        dense = self.dense()
        for group in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            grads, ob = [np.zeros_like(p) for p in dense], 0.0
            touched: list[tuple[list[np.ndarray], np.ndarray]] = []
            for d in group:
                ob += self._step(idx, bounds, d, y[d], pos_weight, grads, touched, rng)
            for p, g, s in zip(dense, grads, state.square):
                g /= len(group)
                s += g * g
                p -= rate * (g / np.sqrt(s) + 1e-3 * p)
            self.out_bias -= np.float32(rate * ob / len(group))
            if not touched:
                continue
            g = np.concatenate([g for _, g in touched]) / np.float32(len(group))
            for t, square in enumerate(state.esquare):
                rows = np.concatenate([r[t] for r, _ in touched])
                np.add.at(square, rows, (g * g).mean(1))
                np.subtract.at(self.emb[t], rows, np.float32(rate) * g / np.sqrt(square[rows])[:, None])
                state.moved[t][rows] = True

    def _step(self, idx, bounds, d, label, pos_weight, grads, touched, rng) -> float:
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        rows = [i[lo:hi] for i in idx]
        x = sum(e[i] for e, i in zip(self.emb, rows))
        tops, z, kept = [], float(self.out_bias), []
        for k, (w, weights, b) in enumerate(zip(WIDTHS, self.conv, self.bias)):
            if hi - lo < w:
                tops.append(None)
                continue
            n = hi - lo - w + 1
            a = sum(x[j:j + n] @ weights[j] for j in range(w))
            top = a.argmax(0)
            v = a[top, np.arange(FILTERS)] + b
            keep = (rng.random(FILTERS) > 0.2) * (v > 0)
            tops.append((top, v * keep, keep))
            z += float((v * keep) @ self.out[k * FILTERS:(k + 1) * FILTERS])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = (p - label) * (pos_weight if label else 1.0)
        for k, (w, item) in enumerate(zip(WIDTHS, tops)):
            if item is None:
                continue
            top, v, keep = item
            o = slice(k * FILTERS, (k + 1) * FILTERS)
            grads[2 * len(WIDTHS)][o] += dz * v
            dv = (dz * self.out[o] * keep).astype(np.float32)
            grads[len(WIDTHS) + k] += dv
            for j in range(w):
                grads[k][j] += x[top + j].T * dv
                touched.append(([r[top + j] for r in rows], (self.conv[k][j] * dv).T))
        return dz

    def set_languages(self, counts: dict[str, np.ndarray]) -> None:
        """Word counts of each language, by bucket."""
        self.langs = sorted(counts)
        if self.langs:
            c = np.stack([counts[x] for x in self.langs], 1) + 0.1
            self.lang_table = np.log(c / c.sum(0)).astype(np.float32)

    def seed_embeddings(self, odds: list[np.ndarray], n0: int, n1: int) -> None:
        """The first embedding coordinate starts at the log odds of the bucket;
        ``odds`` are numbers of texts (label x bucket) for each embedding."""
        for e, c in zip(self.emb, odds):
            ratio = np.log(((c[1] + 0.5) / (n1 + 1)) / ((c[0] + 0.5) / (n0 + 1)))
            ratio *= np.minimum(1, (c[1] + c[0]) / 8)    # rare buckets say little
            e[:, 0] = np.clip(ratio, -1, 4) * 0.5
        for w in self.conv:
            w[:, 0, :FILTERS // 2] = np.abs(w[:, 0, :FILTERS // 2]) + 0.3 / len(w)
        for k in range(len(WIDTHS)):
            self.out[k * FILTERS:k * FILTERS + FILTERS // 2] = np.abs(self.out[k * FILTERS:k * FILTERS + FILTERS // 2])


class State:
    """What the steps adapt their rate by, and the buckets that they moved."""

    def __init__(self, model: Model):
        self.square = [np.full_like(p, 1e-3) for p in model.dense()]
        self.esquare = [np.full(BUCKETS, 1e-3, np.float32) for _ in model.emb]
        self.moved = [np.zeros(BUCKETS, bool) for _ in model.emb]


_BLOCKS = "key string, at int, part int, rows binary, vals binary"


def _texts(batches: Iterator[pa.RecordBatch], use: Callable[[np.ndarray], np.ndarray]
           ) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list]]:
    """(buckets, offsets, labels, languages) of the rows in use (told from ``fourth``), some texts at a time."""
    for batch in batches:
        batch = batch.filter(pa.array(use(batch.column(3).to_numpy(zero_copy_only=False).astype(bool))))
        for i, j, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
            yield *features(data, offsets), batch.column(2)[i:j].to_numpy().astype(np.int64), batch.column(1)[i:j].to_pylist()


def _blocks(key: str, part: int, rows: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``vals`` at the places ``rows`` (ascending) of a long array, cut into blocks."""
    cut = np.searchsorted(rows, np.arange(0, BUCKETS + 1, BLOCK))
    for at, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
        if j > i:
            yield pa.RecordBatch.from_pylist([{
                "key": key, "at": at, "part": part, "rows": (rows[i:j] - at * BLOCK).astype(np.int32).tobytes(),
                "vals": vals[i:j].astype(np.float64).tobytes()}], schema=_ARROW)


_ARROW = pa.schema([("key", pa.string()), ("at", pa.int32()), ("part", pa.int32()), ("rows", pa.binary()), ("vals", pa.binary())])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key and place -> their sums; one block is held."""
    now, total = None, np.zeros((0, 0))

    def done() -> Iterator[pa.RecordBatch]:
        rows = np.flatnonzero(total.any(1)) if now else np.zeros(0, np.int64)
        if len(rows):
            yield pa.RecordBatch.from_pylist([{"key": now[0], "at": now[1], "part": 0, "rows": rows.astype(np.int32).tobytes(),
                                               "vals": total[rows].astype(np.float32 if now[0].startswith("emb") else np.float64).tobytes()}],
                                             schema=_ARROW)

    for batch in batches:
        for r in batch.to_pylist():
            rows = np.frombuffer(r["rows"], np.int32)
            vals = np.frombuffer(r["vals"], np.float64).reshape(len(rows), -1)
            if (r["key"], r["at"]) != now:
                yield from done()
                now, total = (r["key"], r["at"]), np.zeros((BLOCK, vals.shape[1]))
            total[rows] += vals
    yield from done()


def _summed(blocks: DataFrame) -> dict[str, np.ndarray]:
    """The sums of all tasks' blocks by key; float sums in the order of the parts, so that reruns agree."""
    found = (blocks.repartition("key", "at").sortWithinPartitions("key", "at", "part")
             .mapInArrow(tidy(_add_up), _BLOCKS).toArrow())
    out: dict[str, np.ndarray] = {}
    for r in found.to_pylist():
        rows = np.frombuffer(r["rows"], np.int32) + r["at"] * BLOCK
        vals = np.frombuffer(r["vals"], np.float32 if r["key"].startswith("emb") else np.float64).reshape(len(rows), -1)
        out.setdefault(r["key"], np.zeros((BUCKETS, vals.shape[1]), vals.dtype))[rows] = vals
    return out


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _counted(fourth: bool | None) -> Callable:
    """Per task: rows by label and, of the rows in use (``fourth`` None: all), texts by bucket and label, words by bucket and language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = np.zeros((1 + len(PREFIXES), BUCKETS, 2))
        n, langs = np.zeros(2), {}
        for idx, bounds, y, lang in _texts(batches, lambda x: np.ones(len(x), bool) if fourth is None else x == fourth):
            n += np.bincount(y, minlength=2)
            text = np.repeat(np.arange(len(y)), np.diff(bounds))
            for c, i in zip(odds, idx):
                once = np.unique(text * BUCKETS + i)
                np.add.at(c, (once % BUCKETS, y[once // BUCKETS]), 1)
            codes = {x: k for k, x in enumerate(dict.fromkeys(x for x in lang if x is not None))}
            of = np.array([codes.get(x, -1) for x in lang], np.int64)[text]
            for x, k in codes.items():
                langs.setdefault(x, np.zeros(BUCKETS))
                langs[x] += np.bincount(idx[0][of == k], minlength=BUCKETS)
            if len(langs) > 32:
                yield from out_langs(langs)
        yield from _blocks("rows", _part(), np.arange(2), n)
        for t, c in enumerate(odds):
            some = np.flatnonzero(c.any(1))
            yield from _blocks(f"odds{t}", _part(), some, c[some])
        yield from out_langs(langs)

    def out_langs(langs: dict) -> Iterator[pa.RecordBatch]:
        for x in sorted(langs):
            some = np.flatnonzero(langs[x])
            yield from _blocks(f"lang{x}", _part(), some, langs[x][some])
        langs.clear()

    return tidy(run)


def _epoch(shared, fourth: bool | None, pos_weight: float, epoch: int, seed: int = 5) -> Callable:
    """Per task: how its rows move the common weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state = copy.deepcopy(shared.value)
        rng, n = np.random.default_rng([seed, epoch, _part()]), 0
        for idx, bounds, y, _ in _texts(batches, lambda x: np.ones(len(x), bool) if fourth is None else x == fourth):
            if len(y):
                model.learn(state, idx, bounds, y, pos_weight, 0.05 / (1 + epoch), rng)
                n += len(y)
        if n == 0:
            return
        flat = np.concatenate([np.ravel(p) for p in (*model.dense(), *state.square)] + [[model.out_bias, 1.0]])
        yield from _blocks("dense", _part(), np.arange(len(flat)), flat * n)
        base, before = shared.value
        for t, moved in enumerate(state.moved):
            rows = np.flatnonzero(moved)
            change = np.concatenate([model.emb[t][rows] - base.emb[t][rows],
                                     (state.esquare[t][rows] - before.esquare[t][rows])[:, None], np.ones((len(rows), 1))], 1)
            yield from _blocks(f"emb{t}", _part(), rows, change)

    return tidy(run)


def _averaged(model: Model, state: State, sums: dict[str, np.ndarray]) -> None:
    flat, at = sums["dense"].ravel(), 0
    for p in (*model.dense(), *state.square):
        p[...] = (flat[at:at + p.size]).reshape(p.shape)
        at += p.size
    rows = flat[at + 1]
    for p in (*model.dense(), *state.square):
        p /= rows
    model.out_bias = np.float32(flat[at] / rows)
    for t in range(len(model.emb)):
        if f"emb{t}" in sums:
            x = sums[f"emb{t}"]
            some = x[:, -1] > 0
            mean = x[some, :-1] / x[some, -1:]
            model.emb[t][some] += mean[:, :DIM]
            state.esquare[t][some] += mean[:, DIM]


def _scored(shared, fourth: bool | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for idx, bounds, y, _ in _texts(batches, lambda x: np.ones(len(x), bool) if fourth is None else x == fourth):
            yield pa.RecordBatch.from_arrays([pa.array(model.language(idx, bounds).astype(np.int32)),
                                              pa.array(model.logits(idx, bounds).astype(np.float64)), pa.array(y)],
                                             names=["lang", "z", "y"])

    return tidy(run)


def _thresholds(scored: DataFrame, languages: int) -> tuple[float, np.ndarray]:
    """The threshold of best F1, over all rows and by language where it has
    positives enough; between two cells it takes the middle of the gap."""
    cells = (scored.groupBy("lang", F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), "z")) * CELLS).alias("cell"))
             .agg(F.count_if(F.col("y") == 1).alias("n1"), F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
             .toPandas())

    def best(c) -> float | None:
        c = c.groupby("cell").agg({"n1": "sum", "n": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
        n1, n, low, high = (c[x].to_numpy() for x in ("n1", "n", "low", "high"))
        if n1.sum() < 5 or (n - n1).sum() < 5:
            return None
        i = int((2 * np.cumsum(n1) / (np.cumsum(n) + n1.sum())).argmax())
        return float((low[i] + high[i + 1]) / 2) if i + 1 < len(c) else float(low[i])

    found = best(cells)
    common = 0.0 if found is None else found
    return common, np.array([common if (b := best(cells[cells.lang == k])) is None else b for k in range(languages)])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on every labelled row that is not held out."""
    spark, model = docs.sparkSession, Model()
    lab = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)"))
    n = lab.count()
    if n == 0:
        return model
    some = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    mixed = F.xxhash64(F.col("doc_id"), F.lit(3))
    rows = (join_small(some, lab, "doc_id").select("text", "lang", "toxic", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(4)) == 0).alias("fourth"),
                                                   "doc_id", mixed.alias("mixed"))
            .repartition(int(np.clip(-(-n // SHARD_ROWS), 1, MOST_SHARDS)), "mixed")
            .sortWithinPartitions("mixed", "doc_id", F.xxhash64("text", "lang", "toxic"))
            .select("text", "lang", "toxic", "fourth").persist(StorageLevel.DISK_ONLY))
    try:
        return _fitted(spark, rows, model, n)
    finally:
        rows.unpersist()


def _fitted(spark, rows: DataFrame, model: Model, n: int) -> Model:
    by_part = {(r["fourth"], r["toxic"]) for r in rows.select("fourth", "toxic").distinct().collect()}
    fourth = (False, True) if {(False, 0), (False, 1)} <= by_part and any(f for f, _ in by_part) else (None, None)
    if {y for _, y in by_part} != {0, 1}:
        return model
    sums = _summed(rows.mapInArrow(_counted(fourth[0]), _BLOCKS))
    n0, n1 = sums["rows"][:2, 0]
    none = np.zeros((BUCKETS, 2))
    model.seed_embeddings([sums.get(f"odds{t}", none).T for t in range(len(model.emb))], max(1, n0), max(1, n1))
    counts = {k[4:]: v[:, 0] for k, v in sums.items() if k.startswith("lang")}
    pos_weight = float(np.clip(n0 / max(1, n1), 1, 4))
    state = State(model)
    for epoch in range(int(np.clip(-(-STEPS // n), *EPOCHS))):
        shared = spark.sparkContext.broadcast((model, state))
        _averaged(model, state, _summed(rows.mapInArrow(_epoch(shared, fourth[0], pos_weight, epoch), _BLOCKS)))
        shared.destroy()
    model.trained = True
    model.set_languages(counts)
    shared = spark.sparkContext.broadcast(model)
    model.common, model.threshold = _thresholds(rows.mapInArrow(_scored(shared, fourth[1]), "lang int, z double, y long"), len(model.langs))
    shared.destroy()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with one more column, the score; no shuffle, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema if f.name != column] + [T.StructField(column, T.DoubleType())])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text)), SLICE_BYTES):
                out[i:j] = m.score(*features(data, offsets))
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out)], names=[f.name for f in schema])

    return docs.mapInArrow(tidy(run), schema)
