"""Pixel queries: morphology, colour, resizing and quality metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelweave.functions import color as C
from voxelweave.operators import camera as K
from voxelweave.operators import image as I  # noqa: E741
from voxelweave.plans.registry import query
from voxelweave.sources import views as V

_ALPHA = f"{V.PIXELS}, a AS (SELECT frame_id, x, y, CASE WHEN v >= 0.5 THEN 255 ELSE 0 END AS alpha FROM pixels)"
_ROW = "(PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_COLUMN = "(PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_OPEN = _ALPHA + f""", e1 AS (SELECT *, min(alpha) OVER {_ROW} AS m, count(*) OVER {_ROW} AS n FROM a), e AS (SELECT frame_id, x, y, CASE WHEN sum(n) OVER {_COLUMN} = 9 THEN min(m) OVER {_COLUMN} ELSE 0 END AS alpha FROM e1)"""


def _mask(spark, d):
    return V.pixels(spark, d).select("frame_id", "x", "y", F.when(F.col("v") >= 0.5, 255).otherwise(0).alias("alpha"))


@query("alpha_threshold", f"WITH {_ALPHA} SELECT frame_id, CAST(sum(alpha) AS BIGINT) AS alpha FROM a GROUP BY 1")
def alpha_threshold(spark, d):
    return _mask(spark, d).groupBy("frame_id").agg(F.sum("alpha").alias("alpha"))


@query("alpha_erode", f"WITH {_OPEN} SELECT frame_id, x, y, CAST(alpha AS INTEGER) AS alpha FROM e")
def alpha_erode(spark, d):
    return I.erode(_mask(spark, d), "alpha")


@query("alpha_dilate", f"WITH {_ALPHA} SELECT frame_id, x, y, CAST(max(m) OVER {_COLUMN} AS INTEGER) AS alpha FROM (SELECT *, max(alpha) OVER {_ROW} AS m FROM a)")
def alpha_dilate(spark, d):
    return I.dilate(_mask(spark, d), "alpha")


@query("alpha_open", f"WITH {_OPEN} SELECT frame_id, x, y, CAST(max(m) OVER {_COLUMN} AS INTEGER) AS alpha FROM (SELECT *, max(alpha) OVER {_ROW} AS m FROM e)")
def alpha_open(spark, d):
    return I.opening(_mask(spark, d), "alpha")


@query("alpha_ema", f"WITH {V.PIXELS}, p AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY x, y) - 1 AS n FROM pixels WINDOW w AS (PARTITION BY x, y ORDER BY frame_id)) SELECT x, y, round(sum(v * CASE WHEN k = 0 THEN pow(0.6, n) ELSE 0.4 * pow(0.6, n - k) END), 6) AS v FROM p GROUP BY 1, 2")
def alpha_ema(spark, d):
    return I.ema_frames(V.pixels(spark, d), "v", 0.4).select("x", "y", F.round("v", 6).alias("v"))


@query("srgb_encode", f"WITH {V.PIXELS} SELECT frame_id, x, y, CAST(floor(CASE WHEN v <= 0.0031308 THEN 12.92*v ELSE 1.055*pow(v, 1/2.4)-0.055 END*255+0.5) AS INTEGER) AS s FROM pixels")
def srgb_encode(spark, d):
    return V.pixels(spark, d).select("frame_id", "x", "y", C.linear_to_srgb8(F.col("v")).alias("s"))


@query("tone_map", f"WITH {V.PIXELS} SELECT frame_id, x, y, CAST(floor(least(1,greatest(0,(v*4)/(1+v*4)))*255+0.5) AS INTEGER) AS s FROM pixels")
def tone_map(spark, d):
    return V.pixels(spark, d).select("frame_id", "x", "y", C.unit_to_u8(C.reinhard(F.col("v") * 4)).alias("s"))


@query("atlas_dilate", f"WITH {V.PIXELS}, t AS (SELECT frame_id, x, y, CASE WHEN (x+y) % 3 <> 0 THEN v END AS v FROM pixels), r AS (SELECT *, sum(v) OVER {_ROW} AS s, count(v) OVER {_ROW} AS n FROM t) SELECT frame_id, x, y, round(coalesce(v, sum(s) OVER {_COLUMN} / sum(n) OVER {_COLUMN}), 6) AS v FROM r")
def atlas_dilate(spark, d):
    t = V.pixels(spark, d).select("frame_id", "x", "y", F.when((F.col("x") + F.col("y")) % 3 != 0, F.col("v")).alias("v"))
    return I.fill_gutter(t).select("frame_id", "x", "y", F.round("v", 6).alias("v"))


@query("masked_images", f"WITH {V.DEPTH} SELECT frame_id, camera_index, x, y, round(grey * alpha / 255, 6) AS grey FROM depth")
def masked_images(spark, d):
    z = V.depth(spark, d)
    images, masks = z.select("frame_id", "camera_index", "x", "y", "grey"), z.select("frame_id", "camera_index", "x", "y", (F.col("alpha") / 255).alias("mask"))
    return I.masked(images, masks, "grey").withColumn("grey", F.round("grey", 6))


_TWO = f"{V.PIXELS}, m AS (SELECT a.frame_id, avg((a.v-b.w)*(a.v-b.w)) AS mse FROM pixels a JOIN (SELECT frame_id, x, y, round(v, 1) AS w FROM pixels) b USING (frame_id, x, y) GROUP BY 1), s AS (SELECT frame_id, CASE WHEN mse < 1e-10 THEN 100 ELSE -10*log10(mse) END AS psnr FROM m)"


def _degraded(spark, d):
    return V.pixels(spark, d).select("frame_id", "x", "y", F.round("v", 1).alias("v"))


@query("psnr_by_frame", f"WITH {_TWO} SELECT frame_id, round(psnr, 5) AS psnr FROM s")
def psnr_by_frame(spark, d):
    return I.psnr_by_frame(V.pixels(spark, d), _degraded(spark, d)).select("frame_id", F.round("psnr", 5).alias("psnr"))


@query("eval_summary", f"WITH {_TWO} SELECT count(*) AS n, round(avg(round(psnr,4)),5) AS mean, round(stddev_pop(round(psnr,4)),5) AS std, min(round(psnr,4)) AS least, max(round(psnr,4)) AS most FROM s")
def eval_summary(spark, d):
    s = I.summary(I.psnr_by_frame(V.pixels(spark, d), _degraded(spark, d)), "psnr")
    return s.select("n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "least", "most")


def _ssim_sql() -> str:
    """Separable Gaussian windows as sums of eleven shifted rows, then of eleven shifted columns; outside the image counts as zero."""
    g = [math.exp(-((i - 5) ** 2) / (2 * 1.5**2)) for i in range(11)]
    g = [x / sum(g) for x in g]
    blur = lambda c, w: " + ".join(f"coalesce({f'lag({c}, {5 - i})' if i < 5 else f'lead({c}, {i - 5})'} OVER {w}, 0) * {x!r}::DOUBLE" if i != 5 else f"{c} * {x!r}::DOUBLE" for i, x in enumerate(g))
    names = ("a", "b", "aa", "bb", "ab")
    rows = ", ".join(f"{blur(n, 'r')} AS {n}" for n in names)
    cols = ", ".join(f"{blur(n, 'c')} AS {n}" for n in names)
    return f"""WITH {V.PIXELS}, p AS (SELECT frame_id, x, y, v AS a, round(v, 1) AS b, v*v AS aa, round(v, 1)*round(v, 1) AS bb, v*round(v, 1) AS ab FROM pixels),
h AS (SELECT frame_id, x, y, {rows} FROM p WINDOW r AS (PARTITION BY frame_id, y ORDER BY x)), w AS (SELECT frame_id, {cols} FROM h WINDOW c AS (PARTITION BY frame_id, x ORDER BY y))
SELECT frame_id, round(avg((2*a*b + 0.0001::DOUBLE)*(2*(ab - a*b) + 0.0009::DOUBLE)/((a*a + b*b + 0.0001::DOUBLE)*(aa - a*a + bb - b*b + 0.0009::DOUBLE))), 6) AS ssim FROM w GROUP BY 1"""


@query("ssim_by_frame", _ssim_sql())
def ssim_by_frame(spark, d):
    return I.ssim_by_frame(V.pixels(spark, d), _degraded(spark, d)).withColumn("ssim", F.round("ssim", 6))


@query("quality_gate", f"WITH {_TWO} SELECT count(*) AS frames, count(*) FILTER (psnr < 31) AS poor, round(min(psnr), 5) AS least, CASE WHEN avg(psnr) < 31 THEN 'warning' ELSE 'ok' END AS verdict FROM s")
def quality_gate(spark, d):
    return I.gate(I.psnr_by_frame(V.pixels(spark, d), _degraded(spark, d)), "psnr", 31.0).withColumn("least", F.round("least", 5))


@query(
    "bilinear_resize",
    f"""WITH {V.PIXELS}, t AS (SELECT frame_id, tx, ty, greatest(0, least(47, (tx+0.5::DOUBLE)*2.0-0.5)) AS fx, greatest(0, least(31, (ty+0.5::DOUBLE)*2.0-0.5)) AS fy FROM frames, range(24) b(tx), range(16) c(ty)),
u AS (SELECT *, CAST(floor(fx) AS BIGINT) AS x0, CAST(floor(fy) AS BIGINT) AS y0, fx-floor(fx) AS ax, fy-floor(fy) AS ay FROM t),
f AS (SELECT frame_id, tx, ty, least(47, x0 + i) AS x, least(31, y0 + j) AS y, CASE WHEN i = 1 THEN ax ELSE 1-ax END * CASE WHEN j = 1 THEN ay ELSE 1-ay END AS w FROM u, range(2) a(i), range(2) b(j))
SELECT frame_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, round(sum(w*v), 6) AS v FROM f JOIN pixels USING (frame_id, x, y) GROUP BY 1, 2, 3""",
)
def bilinear_resize(spark, d):
    return I.resize(V.pixels(spark, d), 48, 32, 24, 16).select("frame_id", "tx", "ty", F.round("v", 6).alias("v"))


def _split_sql() -> str:
    """The usual cyclic checksum of "42:key", a byte at a time over its table, which is built by rule."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)  # noqa: PLW2901
        table.append(i)
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"""WITH s AS (SELECT c_custkey, '42:' || c_custkey AS s FROM customer), h AS (SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(s[i]) AS BIGINT) for i in range(1, len(s) + 1)]), lambda c, b: {step}), 4294967295::BIGINT) AS h FROM s)
SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY h, c_custkey) <= greatest(1, floor(count(*) OVER () * 0.8)) THEN 'train' ELSE 'val' END AS split FROM h"""


@query("train_val_split", _split_sql())
def train_val_split(spark, d):
    return K.split(V.table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.8, 42)


@query("warmup_cosine", "SELECT c_custkey AS step, round(CASE WHEN c_custkey < 10 THEN 0.001*(c_custkey+1)/10 ELSE 0.5*0.001*(1+cos(3.141592653589793*(c_custkey-10)/(n-10))) END, 9) AS lr FROM customer, (SELECT count(*) AS n FROM customer)")
def warmup_cosine(spark, d):
    steps = V.table(spark, d, "customer").select(F.col("c_custkey").alias("step"))
    lr = C.warmup_cosine(F.col("step"), F.col("n"), 0.001, 10)
    return steps.crossJoin(F.broadcast(steps.agg(F.count("*").alias("n")))).select("step", F.round(lr, 9).alias("lr"))


@query("reconnect_delay", "SELECT o_orderkey, CAST(least(1000 * pow(2, o_orderkey % 12), 16000) AS BIGINT) AS delay_ms FROM orders")
def reconnect_delay(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.backoff_ms(F.col("o_orderkey") % 12).alias("delay_ms"))
