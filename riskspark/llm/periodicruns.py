"""Periodic runs of words by online dyadic square catching.

A square is a stretch repeated at once.  Words are appended to a stream;
every completed block of 2^k words, at a multiple of 2^k, gets a catcher
that waits for the block to come again at a distance of 2^(k+1) - 1 to
2^(k+2) - 2 words.  The first half of every square holds such a block, so
no square is missed.  With each appended word the last 2^k words of the
stream are compared with the two catchers of that size within reach, by
hashes of the suffixes, which double from one size to the next.  Squares
caught by neighbouring blocks at one distance are merged, extended word by
word and compared exactly: they make a run.  A stretch caught again at
multiples of its period is known by then and passed over.

A catcher keeps hashes of the last 5 * 2^k positions, so its state grows
with the longest period asked for and not with the stream.  Documents are
streams of their own: between two of them stands a word that equals none.

Defined cases: null, empty and white-space-only texts have no words and no
run, and their digests are those of nothing; a text with a null id is never
edited; repeated rows get equal results; texts of any length are read
whole; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from riskspark.llm.arrowtext import mix, slices, text_bytes

MIN_EXPONENT = 4
MIN_LENGTH = 6
GROUP_BYTES = 1 << 20       # texts of one stream; a longer text is a stream alone
APPEND = 1 << 15            # words appended at once
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Catchers:
    """Runs of a stream of word numbers; ``append`` may be called with any number of words."""

    def __init__(self, max_period: int, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH):
        if min_exponent < 2:
            raise ValueError("a run holds a square: min_exponent is 2 or more")
        self.max_period, self.min_exponent, self.min_length = max_period, min_exponent, min_length
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.reach = np.zeros(0, np.int64)      # furthest end of the known runs over a word ...
        self.period = np.ones(0, np.int64)      # ... and that run's period
        self.sizes = []
        while 2 * (size := 1 << len(self.sizes)) - 1 <= max_period:
            self.sizes.append(size)
        self.hashes = [np.zeros(0, np.uint64) for _ in self.sizes]
        self.base = [0] * len(self.sizes)       # position of a size's first hash kept
        self.open = [np.zeros((3, 0), np.int64) for _ in self.sizes]
        self.runs: list[tuple[int, int, int]] = []      # start, end, period

    def _grow(self, ids: np.ndarray) -> None:
        n = self.n + len(ids)
        if n > len(self.words):
            room = max(n, 2 * len(self.words))
            for name, fill in (("words", 0), ("reach", 0), ("period", 1)):
                new = np.full(room, fill, np.int64)
                new[:self.n] = getattr(self, name)[:self.n]
                setattr(self, name, new)
        self.words[self.n:n] = ids

    def append(self, ids: np.ndarray) -> None:
        self._grow(ids)
        before, self.n = self.n, self.n + len(ids)
        for k, size in enumerate(self.sizes):
            first = max(0, before - size + 1)           # suffixes of this size that are new
            last = self.n - size + 1
            if last <= first:
                continue
            if k == 0:
                new = mix(self.words[first:last].view(np.uint64))
            else:
                half = size >> 1
                lo = first - self.base[k - 1]
                h = self.hashes[k - 1]
                new = mix(h[lo:lo + last - first] * _LEFT + h[lo + half:lo + half + last - first] * _RIGHT)
            self.hashes[k] = np.concatenate([self.hashes[k], new])
            self._catch(k, size, first, last)
        for k, size in enumerate(self.sizes):           # a size reads back 5 blocks at most, the next one half of that
            drop = self.n - 6 * size - self.base[k]
            if drop > len(self.hashes[k]) // 2:
                self.hashes[k] = self.hashes[k][drop:].copy()
                self.base[k] += drop

    def _catch(self, k: int, size: int, first: int, last: int) -> None:
        """Compare every new suffix with the two catchers within reach."""
        h, base = self.hashes[k], self.base[k]
        at = np.arange(first, last)
        near = (at - 2 * size + 1) // size * size
        found = [self.open[k]]
        for block in (near, near - size):
            ok = np.flatnonzero(block >= 0)
            ok = ok[h[at[ok] - base] == h[block[ok] - base]]
            p = at[ok] - block[ok]
            ok, p = ok[p <= self.max_period], p[p <= self.max_period]
            found.append(np.stack([p, block[ok], block[ok]]))
        period, start, end = np.concatenate(found, 1)
        if len(period) == 0:
            return
        order = np.lexsort((start, period))
        period, start, end = period[order], start[order], end[order]
        new = np.ones(len(period), bool)
        new[1:] = (period[1:] != period[:-1]) | (start[1:] != end[:-1] + size)
        heads = np.flatnonzero(new)
        period, start, end = period[heads], start[heads], end[np.append(heads[1:], len(end)) - 1]
        waits = end + 2 * size + period > self.n        # the next block may still come
        self.open[k] = np.stack([period[waits], start[waits], end[waits]])
        self._extend(size, period[~waits], start[~waits], end[~waits])

    def _extend(self, size: int, period: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Make runs of the merged squares that can be long enough."""
        least = np.maximum(self.min_length, self.min_exponent * period)
        far = end - start + 3 * size - 2 + period >= least
        period, start, end = period[far], start[far], end[far]
        known = (self.reach[start] >= end + size + period) & (period % self.period[start] == 0)
        for p, s, e in zip(*(x[~known].tolist() for x in (period, start, end))):
            if self.reach[s] >= e + size + p and p % self.period[s] == 0:       # known since
                continue
            lo, hi = max(0, s - size + 1), min(self.n, e + 2 * size - 1 + p)
            differ = np.flatnonzero(self.words[lo:hi - p] != self.words[lo + p:hi])
            cut = np.concatenate([[-1], differ, [hi - p - lo]])
            for i in np.flatnonzero(np.diff(cut) - 1 + p >= max(self.min_length, self.min_exponent * p)).tolist():
                a, b = lo + int(cut[i]) + 1, lo + int(cut[i + 1]) + p
                self.runs.append((a, b, p))
                part = self.reach[a:b] < b
                self.period[a:b][part] = p
                self.reach[a:b][part] = b

    def close(self) -> list[tuple[int, int, int]]:
        """End of the stream: (start, length, period) of every run, by start and period."""
        for k, size in enumerate(self.sizes):
            self._extend(size, *self.open[k])
            self.open[k] = np.zeros((3, 0), np.int64)
        smallest: dict[tuple[int, int], int] = {}
        for a, b, p in self.runs:       # a stretch has one smallest period
            smallest[a, b] = min(p, smallest.get((a, b), p))
        return sorted(((a, b - a, p) for (a, b), p in smallest.items()), key=lambda r: (r[0], r[2]))


def find_runs(ids: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH,
              append: int = APPEND) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence of word numbers (0 or more)."""
    c = Catchers(len(ids) // min_exponent, min_exponent, min_length)
    for i in range(0, len(ids), append):
        c.append(ids[i:i + append])
    return c.close()


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of every word, offsets of the texts, the distinct words); equal words have equal numbers."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    flat = pieces.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    words = flat.filter(pa.array(full)).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), kept[offsets], words.dictionary


def edited(doc_id: int | None, n: int) -> np.ndarray | None:
    """For an id whose crc32 ends in 0: the words that the text's words become."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _stream_runs(numbers: np.ndarray, offsets: np.ndarray, min_exponent: int, min_length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, all texts in one stream with a word of its own between them."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    stream = np.empty(len(numbers) + n, np.int64)
    text = np.repeat(np.arange(n), sizes)
    stream[np.arange(len(numbers)) + text] = numbers
    stream[offsets[1:] + np.arange(n)] = -1 - np.arange(n)
    c = Catchers(int(sizes.max(initial=0)) // min_exponent, min_exponent, min_length)
    for i in range(0, len(stream), APPEND):
        c.append(stream[i:i + APPEND])
    begins = offsets[:-1] + np.arange(n)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for start, length, period in c.close():
        d = int(np.searchsorted(begins, start, side="right")) - 1
        out[d].append((start - int(begins[d]), length, period))
    return out


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: bool = False,
         min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, with_runs: bool = False,
         with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run, and digests of all runs and
    of the text without what runs repeat; as asked also ``runs`` (start,
    length, period) and ``collapsed``, the text itself.  ``edit`` first
    makes the texts of some ids periodic.  Rows are worked on where they
    are: no shuffle, no join."""
    schema = SCHEMA + (", runs array<struct<start:long,length:long,period:long>>" if with_runs else "")
    schema += ", collapsed string" if with_text else ""
    one_run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(one_run)] * with_runs + [pa.string()] * with_text
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, byte_offsets = text_bytes(batch.column(1))
            for i, j in slices(byte_offsets, GROUP_BYTES):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(_group(part.column(0).to_pylist(), part.column(1)), types)],
                    names=names)
        pa.default_memory_pool().release_unused()

    def _group(ids: list[int | None], column: pa.Array) -> list[list]:
        numbers, offsets, known = word_numbers(column)
        if edit:
            for d, (i, lo, hi) in enumerate(zip(ids, offsets[:-1].tolist(), offsets[1:].tolist())):
                if (new := edited(i, hi - lo)) is not None:
                    numbers[lo:hi] = numbers[lo:hi][new]
        found = _stream_runs(numbers, offsets, min_exponent, min_length)
        keep = np.ones(len(numbers) + 1, bool)
        out: list[list] = [[] for _ in types]
        for d, some in enumerate(found):
            for start, length, period in some:
                keep[offsets[d] + start + period:offsets[d] + start + length] = False
            best = max(some, key=lambda r: (r[1], -r[0], -r[2])) if some else (None,) * 3
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in some)
            values = [ids[d], len(some), *best, 1000 * best[1] // best[2] if some else None,
                      hashlib.sha256(listed.encode()).hexdigest(), None]
            values += [[dict(zip(("start", "length", "period"), r)) for r in some]] * with_runs
            for c, v in zip(out, values):
                c.append(v)
        keep = keep[:-1]
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), known.take(pa.array(numbers[keep])))
        data, at = text_bytes(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
        raw = memoryview(np.ascontiguousarray(data))
        cuts = at.tolist()
        out[7] = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        if with_text:
            out[-1] = [bytes(raw[a:b]).decode("utf-8") for a, b in zip(cuts, cuts[1:])]
        return out

    names = [c.split(":")[0].split()[0] for c in SCHEMA.split(", ")] + ["runs"] * with_runs + ["collapsed"] * with_text
    return rows.mapInArrow(run, schema)
