"""Frame statistics -> atmosphere scores of a video.

Frames are rows (video_id, frame, width, height, pixels), pixels an array
of whole numbers or bytes, row by row; gray values, or blue, green and red
of each pixel in turn (``colour=True``).  Frame numbers may have gaps.

Frames are dealt by (video, chunk of frame numbers), so a video of very
many frames is spread over many tasks and pixels cross the network once.
In its task a chunk streams by in frame order: NumPy kernels on Arrow
batches give brightness (mean gray), blur (variance of the 4-neighbour
Laplacian, border reflected without repeating the edge) and motion (mean
absolute difference to the frame before).  A chunk yields one row of sums,
with its first and last frame; only these meet their neighbours' by a join
on (video, chunk).  As in the reproduced behaviour, the first frame only
serves as the previous frame of the second; a single-frame video scores 0.

A frame whose pixels are NULL, hold a NULL or do not fill width x height is
left out as if it were not there; between frames of different size there
is no motion; a video without a usable frame scores 0.  Spark's
``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds the frames of one
batch and should fit the frames' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import rules
from riskspark.functions import numeric as N
from riskspark.session import cut_lineage

CHUNK = 256             # frame numbers in one chunk, and chunks in one window
STEP_PIXELS = 1 << 20   # pixels worked on at once (one frame at least)
# Weights of blue, green and red in a gray pixel, in 1/32768, rounded half up.
BGR_WEIGHTS = (3735, 19235, 9798)


# -- kernels on arrays of frames (n, height, width) ---------------------------

def bgr_to_gray(bgr: np.ndarray) -> np.ndarray:
    """Gray values of pixels whose last axis is blue, green, red."""
    b, g, r = BGR_WEIGHTS
    wide = bgr.astype(np.int64)
    return (wide[..., 0] * b + wide[..., 1] * g + wide[..., 2] * r + (1 << 14)) >> 15


def _mirror(n: int, step: int) -> np.ndarray:
    """Index of each one's neighbour, mirrored at the border."""
    i = np.abs(np.arange(n) + step)
    return np.clip(np.where(i >= n, 2 * n - 2 - i, i), 0, n - 1)


def blur_of(gray: np.ndarray) -> np.ndarray:
    """Population variance of the Laplacian [0 1 0; 1 -4 1; 0 1 0] of each frame."""
    _, h, w = gray.shape
    x = gray.astype(np.float64)
    lap = x[:, _mirror(h, -1)] + x[:, _mirror(h, 1)] + x[:, :, _mirror(w, -1)] + x[:, :, _mirror(w, 1)] - 4.0 * x
    return lap.var(axis=(1, 2))


def brightness_of(gray: np.ndarray) -> np.ndarray:
    return gray.sum(axis=(1, 2)) / (gray.shape[1] * gray.shape[2])


def motion_of(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    d = np.abs(after.astype(np.int64) - before)
    return d.sum(axis=(1, 2)) / (d.shape[1] * d.shape[2])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, unusable) of a column of pixel lists or of bytes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        raw = [x or b"" for x in column.to_pylist()]
        values, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        missing = np.zeros(len(values), bool)
    else:
        flat = column.flatten()
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = flat.is_null().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    holes = np.concatenate([[0], np.cumsum(missing)])[offsets]
    return values, offsets, np.diff(holes) > 0


def _steps(batch: pa.RecordBatch, colour: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, gray frames): usable rows of equal size, in order, some at a time."""
    channels = 3 if colour else 1
    values, offsets, bad = _flat(batch.column(4))
    w, h = (pc.fill_null(batch.column(i), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    usable = np.flatnonzero((w > 0) & (h > 0) & (np.diff(offsets) == w * h * channels) & ~bad)
    i = 0
    while i < len(usable):
        r = usable[i]
        most = max(1, STEP_PIXELS // int(w[r] * h[r]))
        same = (w[usable[i:i + most]] == w[r]) & (h[usable[i:i + most]] == h[r])
        k = len(same) if same.all() else int(same.argmin())
        rows = usable[i:i + k]
        each = int(w[r] * h[r] * channels)
        if rows[-1] - rows[0] == k - 1:
            part = values[offsets[rows[0]]:offsets[rows[-1] + 1]]
        else:
            part = values[(offsets[rows][:, None] + np.arange(each)).ravel()]
        gray = bgr_to_gray(part.reshape(k, h[r], w[r], 3)) if colour else part.reshape(k, h[r], w[r]).astype(np.int64)
        yield rows, gray
        i += k


# -- tasks --------------------------------------------------------------------

def _columns(frames: DataFrame, pixels: str) -> list[Column]:
    return [F.col("video_id").cast("long").alias("video_id"), F.col("frame").cast("long").alias("frame"),
            F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col(pixels).alias("pixels")]


def frame_stats(frames: DataFrame, pixels: str = "gray", colour: bool = False) -> DataFrame:
    """(video_id, frame, brightness, blur) of every usable frame; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, gray in _steps(b, colour):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(brightness_of(gray)),
                                                  pa.array(blur_of(gray))], names=["video_id", "frame", "brightness", "blur"])

    return frames.select(*_columns(frames, pixels)).mapInArrow(run, "video_id long, frame long, brightness double, blur double")


_EDGE = "width int, height int, pixels binary"
_CHUNK = (f"video_id long, chunk long, n long, n_motion long, blur double, brightness double, motion double, "
          f"first_blur double, first_brightness double, first struct<{_EDGE}>, last struct<{_EDGE}>")
_SUMS = ["n", "n_motion", "blur", "brightness", "motion"]


class _Chunk:
    """Sums over the frames of one chunk, its first frame apart."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.sums, self.first, self.last, self.stats = key, [0, 0, 0.0, 0.0, 0.0], None, None, (None, None)

    def add(self, gray: np.ndarray) -> None:
        blur, bright = blur_of(gray), brightness_of(gray)
        if self.first is None:
            self.first, self.stats = gray[0], (float(blur[0]), float(bright[0]))
            blur, bright = blur[1:], bright[1:]
        moved = motion_of(gray[:-1], gray[1:])
        if self.last is not None and self.last.shape == gray.shape[1:]:
            moved = np.concatenate([motion_of(self.last[None], gray[:1]), moved])
        for i, x in enumerate((len(blur), len(moved), blur.sum(), bright.sum(), moved.sum())):
            self.sums[i] += x
        self.last = gray[-1]

    def row(self) -> tuple:
        edge = lambda g: None if g is None else {"width": g.shape[1], "height": g.shape[0], "pixels": g.astype("<i4").tobytes()}
        return (*self.key, *self.sums, *self.stats, edge(self.first), edge(self.last))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    edge = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
    types = [pa.int64()] * 4 + [pa.float64()] * 5 + [edge] * 2
    names = ["video_id", "chunk", *_SUMS, "first_blur", "first_brightness", "first", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _chunks(frames: DataFrame, pixels: str, colour: bool, chunk: int) -> DataFrame:
    """One row per chunk of frames; frames stream by in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Chunk | None = None
        done: list[tuple] = []
        for b in batches:
            video, part = (b.column(i).to_pylist() for i in (0, 5))
            keys = list(zip(video, part))
            starts = [r for r in range(b.num_rows) if r == 0 or keys[r] != keys[r - 1]] + [b.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if now is None or now.key != keys[lo]:
                    if now is not None:
                        done.append(now.row())
                    now = _Chunk(keys[lo])
                for _, gray in _steps(b.slice(lo, hi - lo), colour):
                    now.add(gray)
                if len(done) * (now.last.size if now.last is not None else 1) >= STEP_PIXELS:
                    yield _arrow(done)
                    done = []
            if done:
                yield _arrow(done)
                done = []
        if now is not None:
            yield _arrow([now.row()])

    dealt = frames.select(*_columns(frames, pixels), F.floor(F.col("frame") / F.lit(chunk)).cast("long").alias("chunk"))
    # of rows repeating a frame's number the order is that of a hash of their pixels
    dealt = (dealt.withColumn("tie", F.xxhash64("pixels")).repartition("video_id", "chunk")
             .sortWithinPartitions("video_id", "chunk", "frame", "tie").drop("tie"))
    return dealt.mapInArrow(run, _CHUNK)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first frame of a chunk against the last one before: sums over that one frame."""
    def image(x: dict) -> np.ndarray:
        return np.frombuffer(x["pixels"], "<i4").reshape(1, x["height"], x["width"])

    for b in batches:
        video, blur, bright, first, before = (b.column(i) for i in range(5))
        moved = []
        for x, y in zip(before, first):
            x, y = image(x.as_py()), image(y.as_py())
            moved.append(float(motion_of(x, y)[0]) if x.shape == y.shape else None)
        ones = np.ones(b.num_rows, np.int64)
        yield pa.RecordBatch.from_arrays(
            [video, pa.array(ones), pa.array([int(m is not None) for m in moved], pa.int64()), blur, bright,
             pa.array([m or 0.0 for m in moved], pa.float64())], names=["video_id", *_SUMS])


def atmosphere(blur: Column, bright: Column, motion: Column) -> dict[str, Column]:
    sad = ((F.lit(1.0) - bright / F.lit(255.0)) * F.lit(rules.ATMOS_SAD_DARK_W)
           + F.when(blur < F.lit(rules.ATMOS_BLUR_CUTOFF), F.lit(1.0)).otherwise(F.lit(0.0)) * F.lit(rules.ATMOS_SAD_BLUR_W))
    happy = F.when(bright > 0, bright / F.lit(255.0)).otherwise(F.lit(0.0))
    angry = F.when(motion > 0, motion / F.lit(rules.ATMOS_ANGRY_SCALE)).otherwise(F.lit(0.0))
    calm = F.lit(1.0) - angry
    total = happy + sad + angry + calm
    total = F.when(total <= 0, F.lit(1.0)).otherwise(total)
    return {"happy": happy / total, "sad": sad / total, "angry": angry / total, "calm": calm / total}


def previous_frames(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(video_id, frame, prev_frame) of every frame that has an earlier one in
    its video.  Within a chunk of ``chunk`` frame numbers the earlier one is a
    ``lag``; a chunk's first frame follows the last one of the chunk before,
    so no window holds more than ``chunk`` frames, or one row a chunk."""
    ids = frames.select("video_id", "frame", F.floor(F.col("frame") / F.lit(chunk)).alias("__c"))
    inside = Window.partitionBy("video_id", "__c").orderBy("frame")
    rows = ids.select("video_id", "frame", F.lag("frame").over(inside).alias("prev_frame"))
    ends = ids.groupBy("video_id", "__c").agg(F.min("frame").alias("frame"), F.max("frame").alias("__last"))
    across = ends.select("video_id", "frame", F.lag("__last").over(
        Window.partitionBy("video_id").orderBy("__c")).alias("prev_frame"))
    return rows.where("prev_frame IS NOT NULL").unionByName(across.where("prev_frame IS NOT NULL"))


def frame_features(frames: DataFrame, places: int | None = 6, pixels: str = "gray", colour: bool = False,
                   chunk: int = CHUNK) -> DataFrame:
    """(video_id, blur, brightness, motion, happy, sad, angry, calm)."""
    chunks = cut_lineage(_chunks(frames, pixels, colour, chunk))      # read three times below; the frames once
    some = chunks.where("first IS NOT NULL")
    follows = previous_frames(some.select("video_id", F.col("chunk").alias("frame")), chunk)
    here = some.select("video_id", F.col("chunk").alias("frame"), "first_blur", "first_brightness", "first")
    before = some.select("video_id", F.col("chunk").alias("prev_frame"), "last")
    pairs = here.join(follows, ["video_id", "frame"]).join(before, ["video_id", "prev_frame"])
    seams = pairs.select("video_id", "first_blur", "first_brightness", "first", "last").mapInArrow(
        _across, "video_id long, n long, n_motion long, blur double, brightness double, motion double")
    total = (chunks.select("video_id", *_SUMS).unionByName(seams)
             .groupBy("video_id").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    mean = lambda c, n: F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(F.lit(0.0)).alias(c)
    v = total.select("video_id", mean("blur", "n"), mean("brightness", "n"), mean("motion", "n_motion"))
    scores = atmosphere(F.col("blur"), F.col("brightness"), F.col("motion"))
    out = v.select("video_id", "blur", "brightness", "motion", *[e.alias(k) for k, e in scores.items()])
    if places is None:
        return out
    return out.select("video_id", *[N.round_half_away(F.col(c), places).alias(c)
                                    for c in ("blur", "brightness", "motion", "happy", "sad", "angry", "calm")])
