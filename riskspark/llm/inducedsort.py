"""External induced suffix sorting of one shard, with common prefixes.

Suffixes are typed S or L by comparing each with the next one.  The leftmost
S suffixes are sorted first: their substrings are named in order and the
string of names is sorted by doubling.  Two inducing passes then carry
(position, common prefix) tuples through one queue per first character: a
suffix taken from its queue pushes the suffix that starts one character
earlier, and the common prefix of two pushed neighbours is one more than the
least common prefix between their sources.  Queues are read in the order
they were written and go to disk beyond ``memory`` bytes, so together they
may be far larger than memory.

Common prefixes are counted up to ``depth`` only: callers ask which
positions start a string of that length that starts elsewhere too.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

SYMBOL_BITS = 10        # character (9 bits) and type of one symbol
PER_KEY = 6             # symbols in one 64-bit key
QUEUE_BYTES = 64 << 20
BLOCK = 1 << 19         # suffixes taken from a queue at once


class Queues:
    """First-in first-out queues of (positions, common prefixes), one per
    character.  Beyond the byte budget the fullest go to files of a private
    folder, which ``close`` removes; the files serve one task attempt only."""

    def __init__(self, n: int, memory: int):
        self.parts: list[list[tuple]] = [[] for _ in range(n)]
        self.last = np.full(n, -1, np.int64)
        self.held, self.memory = 0, memory
        self.own: list[int] = [0] * n
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files: dict[int, object] = {}

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[c].append((pos, lcp))
        self.last[c] = pos[-1]
        size = pos.nbytes + lcp.nbytes
        self.held += size
        self.own[c] += size
        if self.held > self.memory:
            for k in sorted(range(len(self.own)), key=self.own.__getitem__, reverse=True)[:8]:
                self._spill(k)

    def _spill(self, c: int) -> None:
        if not self.own[c]:
            return
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-queue-")
        f = self.files.get(c)
        if f is None:
            f = self.files[c] = open(os.path.join(self.folder.name, str(c)), "w+b")
        f.seek(0, os.SEEK_END)
        for i, part in enumerate(self.parts[c]):
            if part is not None and isinstance(part[0], np.ndarray):
                at = f.tell()
                part[0].tofile(f)
                part[1].tofile(f)
                self.parts[c][i] = (at, len(part[0]), part[0].dtype)
        self.held -= self.own[c]
        self.own[c] = 0

    def part(self, c: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.parts[c][i]
        if isinstance(part[0], np.ndarray):
            return part
        at, n, dtype = part
        f = self.files[c]
        f.flush()
        f.seek(at)
        return np.fromfile(f, dtype, n), np.fromfile(f, np.uint8, n)

    def block(self, c: int, i: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """Parts i, i + step, ... in one piece of bounded size, and the part that follows it."""
        taken, n = [], 0
        while 0 <= i < len(self.parts[c]) and n < BLOCK:
            taken.append(self.part(c, i))
            n += len(taken[-1][0])
            i += step
        if len(taken) == 1:
            return *taken[0], i
        taken = taken[::step]
        return np.concatenate([x[0] for x in taken]), np.concatenate([x[1] for x in taken]), i

    def drop(self, c: int) -> None:
        self.held -= self.own[c]
        self.own[c] = 0
        self.parts[c] = []

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        if self.folder is not None:
            self.folder.cleanup()


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the text ends with the smallest symbol of all."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = -1
    nxt = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return step[nxt] > 0


class Shard:
    """A text of several pieces: symbols are bytes + 1, 0 ends each piece."""

    def __init__(self, t: np.ndarray, depth: int, memory: int = QUEUE_BYTES):
        self.t, self.depth, self.memory = t, depth, memory
        self.padded = np.concatenate([t, np.zeros(depth + 32, np.uint16)])
        self.s = _types(t)
        self.flag = np.zeros(len(t), bool)

    # -- common prefixes by comparison -----------------------------------
    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to depth."""
        out = np.full(len(a), self.depth, np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(self.padded, 16)
        live = np.arange(len(a))
        for off in range(0, self.depth, 16):
            differs = view[np.minimum(a[live] + off, len(self.t) + self.depth)] != view[np.minimum(b[live] + off, len(self.t) + self.depth)]
            any_ = differs.any(1)
            hit = live[any_]
            out[hit] = np.minimum(off + differs[any_].argmax(1), self.depth)
            live = live[~any_]
            if len(live) == 0:
                break
        return out

    def common_one(self, a: int, b: int) -> int:
        x, y = self.padded[a:a + self.depth], self.padded[b:b + self.depth]
        if a < 0 or b < 0:
            return 0
        m = min(len(x), len(y))
        d = np.flatnonzero(x[:m] != y[:m])
        return int(d[0]) if len(d) else m

    # -- leftmost S suffixes ---------------------------------------------
    def leftmost(self) -> np.ndarray:
        """Positions of the leftmost S suffixes, sorted (ties beyond depth in any order)."""
        s = self.s
        at = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        m = len(at)
        if m == 0:
            return at
        end = np.append(at[1:], len(self.t))          # each substring includes its end symbol
        size = np.minimum(end - at + 1, self.depth)
        symbol = np.zeros(len(self.t) + self.depth + PER_KEY, np.uint64)
        symbol[:len(self.t)] = self.t.astype(np.uint64) * np.uint64(2) + s + np.uint64(1)
        rank = np.zeros(m, np.int64)
        live = np.arange(m)
        off = 0
        while len(live):
            key = np.zeros(len(live), np.uint64)
            for j in range(PER_KEY):
                inside = size[live] > off + j
                key = (key << np.uint64(SYMBOL_BITS)) | np.where(inside, symbol[at[live] + off + j], np.uint64(0))
            self._refine(rank, live, key)
            off += PER_KEY
            live = live[size[live] > off]
            live = self._tied(rank, live)
        # doubling over the string of names
        h = 1
        while True:
            covered = np.append(at, len(self.t))[np.minimum(np.arange(m) + h, m)] - at
            live = self._tied(rank, np.flatnonzero((covered < self.depth) & (np.arange(m) + h <= m)))
            if len(live) == 0:
                break
            follow = np.append(rank + 1, 0)[np.minimum(live + h, m)]
            self._refine(rank, live, follow.astype(np.uint64))
            h *= 2
        return at[np.argsort(rank, kind="stable")]

    @staticmethod
    def _tied(rank: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Those of ``live`` that share their rank with another of ``live``."""
        own = rank[live]
        return live[np.bincount(own, minlength=1)[own] > 1] if len(live) else live

    @staticmethod
    def _refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> None:
        """Order the rows of each rank by key; a rank is the number of smaller rows."""
        own = rank[live]
        bits = int(key.max(initial=np.uint64(0))).bit_length()
        if int(own.max(initial=0)).bit_length() + bits <= 63:
            order = np.argsort(own.astype(np.uint64) << np.uint64(bits) | key)
        else:
            order = np.lexsort((key, own))
        r, k = own[order], key[order]
        n = np.arange(len(r))
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_sub = new_group | np.concatenate([[True], k[1:] != k[:-1]])
        group_at = np.maximum.accumulate(np.where(new_group, n, 0))
        sub_at = np.maximum.accumulate(np.where(new_sub, n, 0))
        rank[live[order]] = r + sub_at - group_at

    # -- inducing ----------------------------------------------------------
    def _induce(self, queues: Queues, pos: np.ndarray, lcp: np.ndarray, kind: bool) -> None:
        """Push the predecessors of type ``kind`` of a block of sorted suffixes."""
        prev = pos - 1
        ok = prev >= 0
        ok[ok] = self.s[prev[ok]] == kind
        at = np.flatnonzero(ok)
        if len(at) == 0:
            return
        prev = prev[at]
        c = self.t[prev]
        order = np.argsort(c, kind="stable")
        c, prev, at = c[order], prev[order], at[order]
        first = np.concatenate([[True], c[1:] != c[:-1]])
        common = np.zeros(len(c), np.uint8)
        inner = np.flatnonzero(~first)
        if len(inner):
            ends = np.empty(2 * len(inner), np.int64)
            ends[0::2], ends[1::2] = at[inner - 1] + 1, at[inner] + 1
            least = np.minimum.reduceat(np.append(lcp, 0), ends)[::2]
            common[inner] = np.minimum(least.astype(np.int64) + 1, self.depth)
        starts = np.flatnonzero(first)
        for a, z in zip(starts, np.append(starts[1:], len(c))):
            ch = int(c[a])
            if queues.last[ch] >= 0:
                common[a] = self.common_one(int(queues.last[ch]), int(prev[a]))
                if common[a] >= self.depth:
                    self.flag[queues.last[ch]] = True
            queues.push(ch, prev[a:z], common[a:z])
        equal = common >= self.depth
        self.flag[prev[equal]] = True
        self.flag[prev[np.flatnonzero(equal & ~first) - 1]] = True

    def repeated(self) -> np.ndarray:
        """For each position, whether the ``depth`` symbols from it on also start elsewhere."""
        n_chars = int(self.t.max(initial=0)) + 1
        lms = self.leftmost()
        lms_lcp = np.zeros(len(lms), np.uint8)
        if len(lms) > 1:
            for a in range(1, len(lms), 1 << 17):
                z = min(len(lms), a + (1 << 17))
                lms_lcp[a:z] = self.common(lms[a - 1:z - 1], lms[a:z])
        dtype = np.int32 if len(self.t) < 1 << 31 else np.int64
        lms = lms.astype(dtype)
        cut = np.searchsorted(self.t[lms], np.arange(n_chars + 1))
        low, high = Queues(n_chars, self.memory), Queues(n_chars, self.memory)
        try:
            # ascending: the empty suffix, then per character its L suffixes and its leftmost S suffixes
            self._induce(low, np.array([len(self.t)], dtype), np.zeros(1, np.uint8), False)
            for c in range(n_chars):
                i = 0
                while i < len(low.parts[c]):
                    pos, lcp, i = low.block(c, i)
                    self._induce(low, pos, lcp, False)
                a, z = cut[c], cut[c + 1]
                if z > a:
                    self._induce(low, lms[a:z], lms_lcp[a:z], False)
            del lms, lms_lcp
            # descending: per character its S suffixes, then its L suffixes
            for c in range(n_chars - 1, -1, -1):
                i = 0
                while i < len(high.parts[c]):
                    pos, lcp, i = high.block(c, i)
                    self._induce(high, pos, lcp, True)
                parts = range(len(low.parts[c]) - 1, -1, -1)
                if len(parts) and len(high.parts[c]):        # the greatest L suffix meets the least S suffix
                    a, b = int(low.last[c]), int(high.last[c])
                    if self.common_one(a, b) >= self.depth:
                        self.flag[[a, b]] = True
                for pos, down in self._backwards(low, c):
                    self._induce(high, pos, down, True)
                low.drop(c)
                high.drop(c)
        finally:
            low.close()
            high.close()
        return self.flag

    @staticmethod
    def _backwards(queue: Queues, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The parts of a queue from its end; each prefix is then with the element before in that order."""
        above, i = 0, len(queue.parts[c]) - 1
        while i >= 0:
            pos, lcp, i = queue.block(c, i, -1)
            down = np.empty_like(lcp)
            down[0], down[1:] = above, lcp[:0:-1]
            above = lcp[0]
            yield pos[::-1], down


def repeated_starts(pieces: list[bytes], depth: int, memory: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each piece, the offsets at which ``depth`` bytes start that also
    start at another place of the same or another piece."""
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.zeros(int(start[-1]), np.uint16)
    fill = np.ones(len(t), bool)
    fill[start[1:] - 1] = False
    t[fill] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    flag = Shard(t, depth, memory).repeated()
    return [np.flatnonzero(flag[a:a + max(0, n - depth + 1)]) for a, n in zip(start[:-1], sizes)]
