"""Frame statistics: atmosphere golden rows (FIXTURES.md 2.7), Laplacian vs NumPy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import frames as FR
from riskspark.sources import fixtures as FX
from tests.conftest import SF001

ATMOS = [(0.0, 0.0, 0.0, (0, .5, 0, .5)), (100.0, 127.5, 5.0, (.277778, .166667, .055556, .5)),
         (20.0, 255.0, 0.0, (.5, 0, 0, .5)), (19.99, 51.0, 75.0, (.096154, .423077, .721154, -.240385))]


def test_atmosphere_golden(spark):
    df = spark.createDataFrame([(b, br, m) for b, br, m, _ in ATMOS], "b double, br double, m double")
    s = FR.atmosphere(F.col("b"), F.col("br"), F.col("m"))
    got = df.select(*[s[k].alias(k) for k in ("happy", "sad", "angry", "calm")]).collect()
    for r, (_, _, _, want) in zip(got, ATMOS):
        assert (r.happy, r.sad, r.angry, r.calm) == pytest.approx(want, abs=1e-6)


def _by_hand(frames):
    """{video: (blur, brightness, motion)} pixel by pixel; frames are (video, number, w, h, gray list)."""
    out = {}
    for v in {f[0] for f in frames}:
        blur, bright, motion, before = [], [], [], None
        for _, _, w, h, g in sorted(f for f in frames if f[0] == v):
            if w < 1 or h < 1 or g is None or len(g) != w * h or None in g:
                continue
            if before is not None:
                mirror = lambda i, n: max(0, min(n - 1, -i if i < 0 else 2 * n - 2 - i if i >= n else i))
                px = lambda r, c: g[mirror(r, h) * w + mirror(c, w)]
                lap = [px(r - 1, c) + px(r + 1, c) + px(r, c - 1) + px(r, c + 1) - 4 * px(r, c) for r in range(h) for c in range(w)]
                m = sum(lap) / len(lap)
                blur.append(sum((x - m) ** 2 for x in lap) / len(lap))
                bright.append(sum(g) / len(g))
                if before[:2] == (w, h):
                    motion.append(sum(abs(x - y) for x, y in zip(before[2], g)) / len(g))
            before = (w, h, g)
        out[v] = tuple(sum(x) / len(x) if x else 0.0 for x in (blur, bright, motion))
    return out


SCHEMA = "video_id long, frame long, width int, height int, gray array<int>"


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_features_match_brute_force(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for v in range(12):
        w, h, n = rng.randint(1, 6), rng.randint(1, 6), rng.randint(0, 12)
        for f in sorted(rng.sample(range(40), n)):
            if rng.random() < 0.15:
                w, h = rng.randint(1, 6), rng.randint(1, 6)
            g = [rng.randrange(256) for _ in range(w * h)]
            g = None if rng.random() < 0.05 else g[:-1] if rng.random() < 0.05 else [*g[:-1], None] if rng.random() < 0.05 else g
            rows.append((v, f, w, h, g))
    rows.append((99, 0, 2, 2, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.video_id: (r.blur, r.brightness, r.motion) for r in FR.frame_features(df, places=None, chunk=chunk).collect()}
    want = _by_hand(rows)
    assert got.keys() == want.keys()
    for v in want:
        assert got[v] == pytest.approx(want[v], rel=1e-9)
    as_bytes = df.where("gray IS NULL OR NOT exists(gray, x -> x IS NULL)").rdd.map(
        lambda r: (r.video_id, r.frame, r.width, r.height, None if r.gray is None else bytes(r.gray)))
    again = spark.createDataFrame(as_bytes, SCHEMA.replace("array<int>", "binary"))
    kept = _by_hand([r for r in rows if r[4] is None or None not in r[4]])
    got = {r.video_id: (r.blur, r.brightness, r.motion) for r in FR.frame_features(again, places=None, chunk=chunk).collect()}
    for v in kept:
        assert got[v] == pytest.approx(kept[v], rel=1e-9)


def test_frame_stats_equal_the_video_of_two(spark):
    frames = FX.frames(spark, SF001)
    stats = {(r.video_id, r.frame): r for r in FR.frame_stats(frames).collect()}
    rows = [tuple(r) for r in frames.where("video_id < 3").select("video_id", "frame", "width", "height", "gray").collect()]
    for v, f, w, h, g in rows:
        blur, bright, _ = _by_hand([(v, -1, w, h, g), (v, f, w, h, g)])[v]
        assert (stats[v, f].blur, stats[v, f].brightness) == pytest.approx((blur, bright), rel=1e-9)


def test_colour_frames(spark):
    """Weights 0.114, 0.587, 0.299 in 15 bits, rounded; white stays white."""
    pixels = np.array([[[0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255], [1, 2, 3], [200, 100, 50]]])
    gray = FR.bgr_to_gray(pixels)[0].tolist()
    assert gray == [0, 255, 29, 150, 76, 2, 96]
    rng = np.random.default_rng(1)
    bgr = [rng.integers(0, 256, 3 * 12).tolist() for _ in range(6)]
    df = spark.createDataFrame([(1, i, 4, 3, x) for i, x in enumerate(bgr)], SCHEMA.replace("gray", "bgr"))
    want = _by_hand([(1, i, 4, 3, FR.bgr_to_gray(np.array(x).reshape(1, 3, 4, 3)).ravel().tolist()) for i, x in enumerate(bgr)])[1]
    r = FR.frame_features(df, places=None, pixels="bgr", colour=True).first()
    assert (r.blur, r.brightness, r.motion) == pytest.approx(want)
    for b, g, q, v in rng.integers(0, 256, (200, 4)).tolist():
        assert abs(int(FR.bgr_to_gray(np.array([b, g, q]))) - (0.114 * b + 0.587 * g + 0.299 * q)) < 0.51


def test_single_frame_video_scores_zero(spark):
    df = spark.createDataFrame([(1, 0, 2, 2, [10, 20, 30, 40])],
                               "video_id long, frame long, width int, height int, gray array<int>")
    r = FR.frame_features(df).first()
    assert (r.blur, r.brightness, r.motion) == (0.0, 0.0, 0.0)
    assert (r.happy, r.sad, r.angry, r.calm) == pytest.approx((0, .5, 0, .5))


def test_motion_uses_previous_frame(spark):
    rows = [(1, 0, 2, 1, [0, 0]), (1, 1, 2, 1, [10, 20]), (1, 2, 2, 1, [10, 0])]
    df = spark.createDataFrame(rows, "video_id long, frame long, width int, height int, gray array<int>")
    r = FR.frame_features(df, places=None).first()
    assert r.motion == pytest.approx(((10 + 20) / 2 + (0 + 20) / 2) / 2)
    assert r.brightness == pytest.approx((15 + 5) / 2)


def test_chunks_spread_a_hot_video(spark):
    """Pixels are shuffled once, by video and chunk."""
    plan = FR._chunks(FX.frames(spark, SF001), "gray", False, 256)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange", plan)) == 1
    assert re.search(r"Exchange hashpartitioning\(video_id#\d+L, chunk#\d+L", plan)


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_previous_frame_over_gaps_and_chunks(spark, chunk):
    nums = {1: [0, 2, 4, 9], 2: [5], 3: [3, 4, 5, 6, 7]}
    df = spark.createDataFrame([(v, n) for v, ns in nums.items() for n in ns], "video_id long, frame long")
    got = {tuple(r) for r in FR.previous_frames(df, chunk).collect()}
    assert got == {(v, b, a) for v, ns in nums.items() for a, b in zip(ns, ns[1:])}


def test_frames_with_gaps_are_paired(spark):
    rows = [(1, 0, 2, 1, [0, 0]), (1, 2, 2, 1, [10, 20]), (1, 4, 2, 1, [10, 0])]
    df = spark.createDataFrame(rows, "video_id long, frame long, width int, height int, gray array<int>")
    r = FR.frame_features(df, places=None).first()
    assert r.motion == pytest.approx(((10 + 20) / 2 + (0 + 20) / 2) / 2)
