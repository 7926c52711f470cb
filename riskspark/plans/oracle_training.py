"""Oracle SQL, fourth part: training data, splits, evaluation, frames."""

from __future__ import annotations

from riskspark import rules
from riskspark.plans import oracle_features as OF
from riskspark.plans import sqlfrag as Q
from riskspark.sources import fixtures as FX

d, q = Q.d, Q.q

U32 = "CAST(('0x' || substr(md5('42-' || CAST(post_id AS VARCHAR)), 1, 8)) AS BIGINT)"
LABEL = ("CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'HIGH' WHEN l.quality = 0 THEN 'MEDIUM' "
         "ELSE 'LOW' END")

PREP = OF.CORPUS + f""",
prep AS (
  SELECT c.post_id, c.text, upper({Q.strip(LABEL)}) AS label
  FROM corpus c LEFT JOIN labels l ON l.doc_id = c.post_id
  WHERE length(c.text) > {rules.MIN_TEXT_CHARS} AND upper({Q.strip(LABEL)}) IN ('HIGH', 'LOW', 'MEDIUM')
),
strat AS (
  SELECT post_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {U32}, post_id)
                                   <= ceil({d(rules.SPLIT_TEST_SHARE)} * count(*) OVER (PARTITION BY label))
                              THEN 'test' ELSE 'train' END AS split
  FROM prep
),
preds AS (
  SELECT label, {Q.argmax3('a / (a + b + c)', 'b / (a + b + c)', 'c / (a + b + c)', rules.LEVELS)} AS pred
  FROM (SELECT label, CAST(post_id % 5 AS DOUBLE) AS a, CAST(post_id % 3 + 1 AS DOUBLE) AS b,
               CAST(post_id % 4 AS DOUBLE) AS c FROM strat WHERE split = 'test')
),
cls AS (SELECT * FROM (VALUES ('HIGH'), ('LOW'), ('MEDIUM')) t(cls))"""

_V1 = f"coalesce(caption, '') || ' ' || coalesce(transcript, '')"
_PCT = ("CASE WHEN risk_yuzdesi IS NOT NULL AND NOT isnan(risk_yuzdesi) AND risk_yuzdesi >= 70 THEN 'HIGH' "
        "WHEN risk_yuzdesi IS NOT NULL AND NOT isnan(risk_yuzdesi) AND risk_yuzdesi >= 40 THEN 'MEDIUM' ELSE 'LOW' END")

FRAMES = f"""
frames AS (
  SELECT CAST(floor(vec_id / {FX.FRAMES_PER_VIDEO}) AS BIGINT) AS video_id, vec_id % {FX.FRAMES_PER_VIDEO} AS frame,
         {FX.FRAME_SIDE} AS width, {FX.FRAME_SIDE} AS height,
         list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) + {d(1.0)}) * {d(127.5)}) AS INTEGER)))) AS gray
  FROM embeddings
)"""


def _refl(i: str, n: str) -> str:
    return f"greatest(0, least({n} - 1, CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - 2 - ({i}) ELSE {i} END))"


def _px(r: str, c: str) -> str:
    return f"CAST(gray[{_refl(r, 'height')} * width + {_refl(c, 'width')} + 1] AS DOUBLE)"


def _lap() -> str:
    r, c = "(k // width)", "(k % width)"
    body = (f"{_px(f'{r} - 1', c)} + {_px(f'{r} + 1', c)} + {_px(r, f'{c} - 1')} + {_px(r, f'{c} + 1')} "
            f"- {d(4.0)} * {_px(r, c)}")
    return f"list_transform(range(0, width * height), lambda k: {body})"


def _var(vals: str) -> str:
    n = "CAST(len(vals) AS DOUBLE)"
    mean = f"(list_reduce(list_prepend({d(0.0)}, vals), lambda a, x: a + x) / {n})"
    return (f"(SELECT list_reduce(list_prepend({d(0.0)}, vals), lambda a, x: a + (x - m) * (x - m)) / {n} "
            f"FROM (SELECT {vals} AS vals) s, (SELECT {mean} AS m FROM (SELECT {vals} AS vals)) mm)")


BRIGHT = "CAST(list_sum(gray) AS DOUBLE) / CAST(len(gray) AS DOUBLE)"

STATS = FRAMES + f""",
lapf AS (SELECT video_id, frame, width, height, gray, {_lap()} AS lap FROM frames),
fstats AS (
  SELECT video_id, frame, gray, {BRIGHT} AS brightness,
         list_reduce(list_prepend({d(0.0)}, lap), lambda a, x: a + (x - mu) * (x - mu)) / CAST(len(lap) AS DOUBLE) AS blur
  FROM (SELECT *, list_reduce(list_prepend({d(0.0)}, lap), lambda a, x: a + x) / CAST(len(lap) AS DOUBLE) AS mu FROM lapf)
)"""


# 0.114 blue + 0.587 green + 0.299 red in 15 bits, of the pixel (x, 255 - x, (7 x + 3 k) % 256)
GRAY_FRAMES = """
gray_frames AS (
  SELECT video_id, frame, width, height, list_transform(gray, lambda x, i:
           (3735 * x + 19235 * (255 - x) + 9798 * ((7 * x + 3 * (i - 1)) % 256) + 16384) // 32768) AS gray
  FROM frames
),
"""


def training_queries() -> dict[str, str]:
    r6 = lambda x: f"round({x}, 6)"
    features = f""",
pairs AS (
  SELECT f.video_id, f.blur, f.brightness,
         CAST(list_sum(list_transform(range(1, len(f.gray) + 1), lambda i: abs(f.gray[i] - p.gray[i]))) AS DOUBLE)
           / CAST(len(f.gray) AS DOUBLE) AS motion
  FROM fstats f JOIN fstats p ON p.video_id = f.video_id AND p.frame = f.frame - 1
  WHERE f.frame >= 1
),
pv AS (SELECT video_id, avg(blur) AS blur, avg(brightness) AS brightness, avg(motion) AS motion FROM pairs GROUP BY video_id),
v AS (
  SELECT a.video_id, coalesce(pv.blur, {d(0.0)}) AS blur, coalesce(pv.brightness, {d(0.0)}) AS bright,
         coalesce(pv.motion, {d(0.0)}) AS motion
  FROM (SELECT DISTINCT video_id FROM frames) a LEFT JOIN pv ON pv.video_id = a.video_id
),
s AS (
  SELECT video_id, blur, bright, motion,
         ({d(1.0)} - bright / {d(255.0)}) * {d(rules.ATMOS_SAD_DARK_W)} + (CASE WHEN blur < {d(rules.ATMOS_BLUR_CUTOFF)} THEN {d(1.0)} ELSE {d(0.0)} END) * {d(rules.ATMOS_SAD_BLUR_W)} AS sad,
         CASE WHEN bright > 0 THEN bright / {d(255.0)} ELSE {d(0.0)} END AS happy,
         CASE WHEN motion > 0 THEN motion / {d(rules.ATMOS_ANGRY_SCALE)} ELSE {d(0.0)} END AS angry
  FROM v
),
t AS (SELECT *, {d(1.0)} - angry AS calm FROM s),
tt AS (SELECT *, CASE WHEN happy + sad + angry + calm <= 0 THEN {d(1.0)} ELSE happy + sad + angry + calm END AS total FROM t)
SELECT video_id, {r6('blur')} AS blur, {r6('bright')} AS brightness, {r6('motion')} AS motion,
       {r6('happy / total')} AS happy, {r6('sad / total')} AS sad, {r6('angry / total')} AS angry,
       {r6('calm / total')} AS calm FROM tt"""
    per = """
per AS (
  SELECT c.cls, CAST((SELECT count(*) FROM preds WHERE label = c.cls) AS DOUBLE) AS sup,
         CAST((SELECT count(*) FROM preds WHERE pred = c.cls) AS DOUBLE) AS prd,
         CAST((SELECT count(*) FROM preds WHERE label = c.cls AND pred = c.cls) AS DOUBLE) AS tp
  FROM cls c
),
m AS (
  SELECT cls, sup, tp,
         CASE WHEN prd > 0 THEN tp / prd ELSE 0.0 END AS precision,
         CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS recall,
         CASE WHEN sup + prd > 0 THEN 2.0 * tp / (sup + prd) ELSE 0.0 END AS f1
  FROM per
)"""
    return {
        "train_prep": "WITH " + PREP + "\nSELECT post_id, text, label FROM prep",
        "train_prep_v1": "WITH " + OF.O.RAW_POSTS + f"\nSELECT post_id, {_V1} AS full_text, {_PCT} AS risk_label FROM posts",
        "split_plain": "WITH " + OF.O.RAW_POSTS + f"\nSELECT post_id, {_PCT} AS risk_label, "
        f"CASE WHEN CAST({U32} AS DOUBLE) < {d(rules.SPLIT_TEST_SHARE)} * {d(4294967296.0)} THEN 'test' ELSE 'train' END AS split "
        "FROM posts",
        "split_stratified": "WITH " + PREP + "\nSELECT post_id, label, split FROM strat",
        "confusion": "WITH " + PREP + """
SELECT c.cls AS label, count_if(p.pred = 'HIGH') AS pred_HIGH, count_if(p.pred = 'LOW') AS pred_LOW,
       count_if(p.pred = 'MEDIUM') AS pred_MEDIUM
FROM cls c LEFT JOIN preds p ON p.label = c.cls GROUP BY c.cls""",
        "class_report": "WITH " + PREP + "," + per + f"""
SELECT cls AS class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
       CAST(sup AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('CASE WHEN sum(sup) > 0 THEN sum(tp) / sum(sup) ELSE 0.0 END')},
       CAST(sum(sup) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {r6('sum(precision) / 3.0')}, {r6('sum(recall) / 3.0')}, {r6('sum(f1) / 3.0')},
       CAST(sum(sup) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {r6('CASE WHEN sum(sup) > 0 THEN sum(precision * sup) / sum(sup) ELSE 0.0 END')},
       {r6('CASE WHEN sum(sup) > 0 THEN sum(recall * sup) / sum(sup) ELSE 0.0 END')},
       {r6('CASE WHEN sum(sup) > 0 THEN sum(f1 * sup) / sum(sup) ELSE 0.0 END')}, CAST(sum(sup) AS BIGINT) FROM m""",
        "frame_blur": "WITH " + STATS + f"\nSELECT video_id, frame, {r6('brightness')} AS brightness, {r6('blur')} AS blur FROM fstats",
        "frame_features": "WITH " + STATS + features,
        "colour_features": "WITH " + STATS.replace("AS lap FROM frames)", "AS lap FROM gray_frames)").replace("lapf AS", GRAY_FRAMES + "lapf AS", 1) + features,
    }
