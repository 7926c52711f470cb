"""Language identification of whole, possibly mixed-language texts.

Letters are mapped to scripts by code point ranges; a word's script leaves
only the languages written in it as candidates.  Each word gets one score
per language from hashed letter trigrams, and Viterbi decoding over the
words with a fixed switching penalty labels spans.  The language holding
most letters is the text's language.

The trigram tables are learned from a bounded sample (``per_lang`` rows per
language of at most ``max_chars`` characters, by hash of the id); every row
is predicted from its whole text.

Defined cases: null, empty and letterless texts give ``und`` with score 0;
a word in a script that no learned language uses leaves all languages as
candidates; ties go to the language first in order; null languages are
not learned from; without any learned language every text is ``und``;
repeated rows are predicted alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.arrowtext import mix, slices
from riskspark.llm.toxicity import held_out

BUCKETS = 1 << 18
SWITCH = 8.0            # cost of changing the language between two words
WORD_CLIP = 12.0        # no single word outweighs more than this
PER_LANG = 500
MAX_CHARS = 20_000
SLICE_CHARS = 1 << 18
GROUP_WORDS = 1 << 20

# First and last code points of the scripts told apart (Unicode blocks).
SCRIPT_RANGES = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x323AF),
)
SCRIPTS = ["other", *dict.fromkeys(s for s, _, _ in SCRIPT_RANGES)]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is letter, lower case, script index) by code point."""
    n = 0x110000
    chars = [chr(c) for c in range(n)]
    letter = np.fromiter((unicodedata.category(c)[0] == "L" for c in chars), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        low = chars[c].lower()
        if len(low) == 1:
            lower[c] = ord(low)
    script = np.zeros(n, np.uint8)
    for name, lo, hi in SCRIPT_RANGES:
        script[lo:hi + 1] = SCRIPTS.index(name)
    return letter, lower, script


class Words:
    """The words (runs of letters) of some texts: trigram buckets by letter,
    first letter and text of every word."""

    def __init__(self, texts: list[str]):
        letter, lower, script = tables()
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        is_letter = letter[code]
        edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
        self.start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.size = end - self.start
        c = np.where(is_letter, lower[code], 0).astype(np.uint64)
        tri = np.zeros(len(c), np.uint64)
        if len(c):
            tri[1:] = c[:-1] << np.uint64(42)
            tri[:-1] |= c[1:]
            tri |= c << np.uint64(21)
        at = np.flatnonzero(is_letter)
        self.bucket = (mix(tri[at]) % np.uint64(BUCKETS)).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])      # of words, in letters
        self.script = script[code[self.start]] if len(self.start) else np.zeros(0, np.uint8)
        ends = np.cumsum(sizes)
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], ends]))  # words of each text


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, writes: np.ndarray):
        self.langs, self.logp, self.writes = langs, logp, writes

    def scores(self, w: Words) -> np.ndarray:
        """One score per word and language, the word's best being 0."""
        k = len(self.langs)
        if len(w.start) == 0:
            return np.zeros((0, k), np.float32)
        s = np.add.reduceat(self.logp[w.bucket], w.offset[:-1], axis=0)
        s = np.maximum(s - s.max(1, keepdims=True), -WORD_CLIP)
        fits = self.writes[:, w.script].T                     # words x languages
        some = fits.any(1)
        s[some] = np.where(fits[some], s[some], -4 * WORD_CLIP)
        return (s - s.max(1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; texts advance together, one word a step."""
    k = scores.shape[1]
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], bounds[:-1][order]
    best = np.zeros((len(order), k), np.float32)
    came = np.zeros((len(scores), k), np.uint8)
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for t, n in enumerate(live):
        at = first[:n] + t
        b = best[:n]
        if t:
            top = b.argmax(1)
            jump = b[np.arange(n), top] - switch
            stay = b >= jump[:, None]
            came[at] = np.where(stay, np.arange(k, dtype=np.uint8), top[:, None])
            b[:] = np.where(stay, b, jump[:, None])
        b += scores[at]
    path = np.zeros(len(scores), np.uint8)
    now = best.argmax(1).astype(np.uint8)
    for t in range(len(live) - 1, -1, -1):
        at = first[:live[t]] + t
        path[at] = now[:live[t]]
        now[:live[t]] = came[at, now[:live[t]]] if t else now[:live[t]]
    return path


def train(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> Model:
    """Trigram log probabilities by language, from at most ``per_lang`` rows of each."""
    use = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
                     & (F.length("text") <= max_chars))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id"))
    ids = use.select("doc_id", "lang", rank.alias("n")).where(F.col("n") <= per_lang).select("doc_id").distinct()
    # at most per_lang ids for each language, so the ids may be broadcast
    rows = use.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "lang"]).drop_duplicates("doc_id")
    langs = sorted(set(rows["lang"]))
    counts = np.full((BUCKETS, len(langs)), 0.05)
    used = np.zeros((len(langs), len(SCRIPTS)))
    for i, lang in enumerate(langs):
        w = Words(list(rows.loc[rows["lang"] == lang, "text"]))
        counts[:, i] += np.bincount(w.bucket, minlength=BUCKETS)
        used[i] += np.bincount(w.script, minlength=len(SCRIPTS))
    logp = np.log(counts / counts.sum(0)).astype(np.float32) if langs else counts.astype(np.float32)
    return Model(langs, logp, used >= 0.01 * used.sum(1, keepdims=True).clip(1))


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
                                  T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
             spans: bool = False) -> DataFrame:
    """``keep`` columns plus lang_pred, score (share of the letters labelled
    with it) and, as asked, the labelled spans in words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()),
                                               T.StructField("score", T.DoubleType())]
    fields += [T.StructField("spans", SPANS)] if spans else []
    n_keep = len(keep)

    def label(m: Model, texts: list[str]) -> tuple[list, list, list]:
        parts = [Words(texts[i:j]) for i, j in
                 slices(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), SLICE_CHARS)]
        size = np.concatenate([np.diff(w.bounds) for w in parts])
        scores = np.concatenate([m.scores(w) for w in parts])
        letters = np.concatenate([w.size for w in parts])
        bounds = np.concatenate([[0], np.cumsum(size)])
        path = viterbi(scores, bounds)
        by = np.zeros((len(texts), len(m.langs)))
        np.add.at(by, (np.repeat(np.arange(len(texts)), size), path), letters)
        top, total = by.argmax(1), by.sum(1)
        pred = [m.langs[k] if s else "und" for k, s in zip(top, total)]
        score = np.where(total > 0, by.max(1) / np.maximum(total, 1), 0.0)
        out = []
        if spans:
            for i, j in zip(bounds[:-1], bounds[1:]):
                cut = np.flatnonzero(np.diff(path[i:j].astype(int))) + 1
                edges = np.concatenate([[0], cut, [j - i]]) if j > i else np.zeros(1, int)
                out.append([{"first_word": int(a), "n_words": int(b - a), "lang": m.langs[path[i + a]]}
                            for a, b in zip(edges[:-1], edges[1:])])
        return pred, list(score), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(n_keep)), 0).to_numpy(zero_copy_only=False)
            for at, end in slices(np.concatenate([[0], np.cumsum(size // 4)]), GROUP_WORDS):
                part = batch.slice(at, end - at)
                texts = [t or "" for t in part.column(n_keep).to_pylist()]
                if m.langs:
                    pred, score, found = label(m, texts)
                else:
                    pred, score, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                cols = [part.column(i) for i in range(n_keep)] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    cols.append(pa.array(found, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()),
                                                                    ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(*keep, text).mapInArrow(run, T.StructType(fields))
