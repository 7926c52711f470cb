"""Helpers on Arrow text columns: whole texts of a record batch as one byte
buffer, cut into words and hashed with numpy, a few megabytes at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20  # of a record batch that a task works on at once
BLOCK_BYTES = 2 << 20  # bytes hashed at once; a longer word makes its own block longer

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as the empty text."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to a block's length."""
    known = _POWERS.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    np.multiply.accumulate(p, out=p)
    if n <= BLOCK_BYTES:
        _POWERS[base] = p
    return p[:n]


def word_blocks(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()
                ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts, in order, block by block.

    Yields (starts, ends, hashes, prefix hashes) with ASCII capitals lowered
    before hashing; a prefix hash covers the first ``k`` bytes of the word.
    Words never span two texts."""
    total, at = len(data), 0
    cuts = np.zeros(total + 1, dtype=bool)
    cuts[offsets] = True
    while at < total:
        end = min(total, at + BLOCK_BYTES)
        if end < total:  # end the block at white space or at a text's end
            free = np.flatnonzero(_SPACE[data[at:end]] | cuts[at + 1:end + 1])
            while len(free) == 0 and end < total:
                new = min(total, end + BLOCK_BYTES)
                free = np.flatnonzero(_SPACE[data[end:new]] | cuts[end + 1:new + 1])[:1] + (end - at)
                end = new
            if end < total or len(free):
                end = at + int(free[-1]) + 1 if len(free) else end
        b = data[at:end]
        inside = ~_SPACE[b]
        cut = cuts[at:end]
        prev = np.zeros(len(b), dtype=bool)
        prev[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~prev | cut))
        nxt = np.zeros(len(b), dtype=bool)
        nxt[:-1] = inside[1:] & ~cut[1:]
        ends = np.flatnonzero(inside & ~nxt) + 1
        if len(starts):
            sums = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[_LOWER[b]] * powers(len(b), _BASE), out=sums[1:])
            inv = powers(len(b), _INV)[starts]
            size = (ends - starts).astype(np.uint64)
            h = mix((sums[ends] - sums[starts]) * inv + size)
            pre = []
            for k in prefixes:
                stop = np.minimum(starts + k, ends)
                pre.append(mix((sums[stop] - sums[starts]) * inv + np.uint64(k << 32)))
            yield starts + at, ends + at, h, pre
        at = end


def words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()
          ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word hashes, offsets into them per text, prefix hashes) of all texts."""
    starts, hashes, pre = [], [], [[] for _ in prefixes]
    for s, _, h, p in word_blocks(data, offsets, prefixes):
        starts.append(s)
        hashes.append(h)
        for acc, x in zip(pre, p):
            acc.append(x)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), [np.zeros(0, np.uint64) for _ in prefixes]
    bounds = np.searchsorted(np.concatenate(starts), offsets, side="left")
    return np.concatenate(hashes), bounds, [np.concatenate(x) for x in pre]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) holding at most ``limit`` units each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of at most ``limit`` bytes of text
    at once (one text at least), so that what is derived from a slice never
    grows with the batch."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def give_back() -> None:
    """Return freed memory to the system.  Spark keeps its Python workers for
    later tasks; what one of them has freed but still holds counts against
    the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task, limit: int = BATCH_BYTES) -> Task:
    """``run`` on smaller batches (``limit`` bytes, one row at least), giving memory back at the end of the task."""
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, b.num_rows // max(1, -(-b.nbytes // limit)))
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(small(batches))
        finally:
            give_back()

    return task
