"""Byte-level BPE encoding and decoding through a serialised piece model.

A vocabulary of ranked byte strings becomes a BPE model of the sentencepiece
library: every byte is mapped to one printable character, every piece is
scored by its negative rank, and normalisation is the identity, so merging
by best score is merging by lowest rank.  Texts are cut by the vocabulary's
pattern; each distinct cut is encoded once while it stays in the task's store, which is
bounded in bytes, and its ids are kept as bytes.  Decoding maps ids back to byte strings.

Defined cases: a null or empty text has no tokens; other columns are kept;
repeated rows are encoded alike; a cut that is itself a vocabulary entry is
that entry's id (as the rank-file reader does); texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import threading
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskspark.llm.arrowtext import slices, text_bytes, tidy

GROUP_BYTES = 1 << 20  # texts encoded at once
STORE_BYTES = 8 << 20   # of distinct cuts kept by a task; the store is emptied beyond this
CUT_BYTES = 200         # of a cut's entry besides its characters and ids


def byte_chars() -> list[str]:
    """One printable character for each byte value, the same for every vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, by rank (ranks are 0..n-1)."""
    out: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                out[int(rank)] = base64.b64decode(piece)
    if sorted(out) != list(range(len(out))):
        raise ValueError(f"{path}: ranks are not 0..{len(out) - 1}")
    return [out[i] for i in range(len(out))]


def serialise(pieces: list[bytes]) -> bytes:
    """The model: id r is the piece of rank r, the last id the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_chars()
    model = pb.ModelProto()
    for rank, raw in enumerate(pieces):
        model.pieces.add(piece="".join(chars[b] for b in raw), score=-float(rank),
                         type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(pieces), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


def _ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder of one vocabulary and cut pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        # White space is the Unicode property of that name, as in the rank-file reader's pattern engine.
        self.cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                 .replace(r"\S", r"\P{White_Space}")).findall
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.rank = {p: i for i, p in enumerate(self.pieces)}

    def _learn(self, cuts: list[str]) -> None:
        raw = [c.encode("utf-8") for c in cuts]
        mapped, at = [], []
        for i, b in enumerate(raw):
            r = self.rank.get(b)
            if r is not None:
                self.known[cuts[i]] = r.to_bytes(4, "little")
            else:
                mapped.append(b.decode("latin-1").translate(self.chars))
                at.append(i)
        for i, ids in zip(at, self.model.encode(mapped, num_threads=1) if mapped else ()):
            self.known[cuts[i]] = _ids(ids)
        self.known_bytes += sum(CUT_BYTES + len(c) + len(b) + len(self.known[c]) for c, b in zip(cuts, raw))

    def forget(self) -> None:
        """Empty the store of cuts."""
        self.known, self.known_bytes = {}, 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers.
        The cuts not met before are encoded in one call."""
        cuts = [self.cut(t) for t in texts]
        if self.known_bytes > STORE_BYTES:
            self.forget()
        new = {c for row in cuts for c in row if c not in self.known}
        if new:
            self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, row)) for row in cuts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}
_lock = threading.Lock()


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary, built once per worker process."""
    with _lock:
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = Codec(path, pattern)
        return _codecs[path, pattern]


def tokenize(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
             with_ids: bool = True, with_text: bool = False, digests: bool = False) -> DataFrame:
    """``keep`` columns of every row plus n_tokens and, as asked, ``ids``
    (array<int>), ``decoded`` (the text its ids give back) and the digests
    ids_sha256 / decoded_sha256."""
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_text:
        fields.append(T.StructField("decoded", T.StringType()))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            _, offsets = text_bytes(batch.column(n_keep))
            for at, end in slices(offsets, GROUP_BYTES):
                part = batch.slice(at, end - at)
                ids = c.encode_all([t or "" for t in part.column(n_keep).to_pylist()])
                back = [c.decode(e) for e in ids] if with_text or digests else []
                cols = [part.column(i) for i in range(n_keep)]
                cols.append(pa.array([len(e) // 4 for e in ids], pa.int64()))
                if with_ids:
                    cols.append(pa.array([np.frombuffer(e, "<i4") for e in ids], pa.list_(pa.int32())))
                if with_text:
                    cols.append(pa.array([b.decode("utf-8") for b in back], pa.string()))
                if digests:
                    cols.append(pa.array([hashlib.sha256(e).hexdigest() for e in ids], pa.string()))
                    cols.append(pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        c.forget()      # the worker process lives on and serves other work

    return docs.select(*keep, text).mapInArrow(tidy(run), T.StructType(fields))
