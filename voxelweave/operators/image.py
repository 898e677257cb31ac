"""Image filters over pixel rows, and quality metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import color as C


def _square(pixels: DataFrame, at: list[str], over: dict[str, tuple], radius: int, *own: str) -> DataFrame:
    """at and the columns own of every pixel, with aggregates (name: function, column) over the square of pixels around it that exist. Rows
    first meet those above and below, then what they met is taken along x; min, max, sum of sums and sum of counts are the same either way."""
    steps = F.array(*[F.lit(j).cast("long") for j in range(-radius, radius + 1)])
    m = pixels.withColumn("_j", F.explode(steps)).withColumns({"_here": F.col("_j") == 0, "y": F.col("y") + F.col("_j")})
    mine = [F.max(F.when(F.col("_here"), F.col(c))).alias(c) for c in own]
    column = m.groupBy(*at).agg(F.max("_here").alias("_here"), *mine, *[f(c).alias(n) for n, (f, c) in over.items()])
    row = Window.partitionBy(*[c for c in at if c != "x"]).orderBy("x").rangeBetween(-radius, radius)
    again = lambda f: F.sum if f is F.count else f
    return column.withColumns({n: again(f)(n).over(row) for n, (f, _) in over.items()}).where("_here").select(*at, *own, *over)


def erode(pixels: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Smallest value around each pixel; outside the frame counts as 0."""
    at = ["frame_id", "x", "y"]
    one = pixels.select(*at, value, F.lit(1).alias("_1"))
    near = _square(one, at, {"_m": (F.min, value), "_n": (F.count, "_1")}, radius)
    return near.select(*at, F.when(F.col("_n") == (2 * radius + 1) ** 2, F.col("_m")).otherwise(F.lit(0).cast(pixels.schema[value].dataType)).alias(value))


def dilate(pixels: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Largest value around each pixel; outside the frame is ignored."""
    at = ["frame_id", "x", "y"]
    return _square(pixels.select(*at, value), at, {"_m": (F.max, value)}, radius).select(*at, F.col("_m").alias(value))


def opening(pixels: DataFrame, value: str, radius: int = 1) -> DataFrame:
    return dilate(erode(pixels, value, radius), value, radius)


def fill_gutter(atlas: DataFrame) -> DataFrame:
    """Empty texels (v null) take the mean of their filled neighbours in the same frame; without frame_id all are one frame."""
    at = [c for c in ("frame_id", "x", "y") if c in atlas.columns]
    near = _square(atlas.select(*at, "v"), at, {"_s": (F.sum, "v"), "_n": (F.count, "v")}, 1, "v")
    return near.select(*at, F.coalesce("v", F.try_divide("_s", "_n")).alias("v"))


def ema_frames(pixels: DataFrame, value: str, alpha: float, block: int = 256) -> DataFrame:
    """Each pixel's exponential mean over its frames, from the first one. Frames are folded in blocks, and a block's fold is linear in the mean
    before it (keep of it, and add), so that a pixel's frames never stand in one array; blocks are folded in their order."""
    v = F.col(value).cast("double")
    held = pixels.groupBy("x", "y", F.expr(f"frame_id div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame_id", v.alias("v")))).alias("vs"))
    step = lambda s, x: s * (1 - alpha) + x["v"] * alpha
    first = F.aggregate(F.slice("vs", 2, 1 << 30), F.col("vs")[0]["v"], step)
    parts = held.select("x", "y", F.struct("block", F.pow(F.lit(1.0 - alpha), F.size("vs")).alias("keep"), F.aggregate("vs", F.lit(0.0), step).alias("add"), first.alias("first")).alias("p"))
    folded = parts.groupBy("x", "y").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return folded.select("x", "y", F.aggregate(F.slice("ps", 2, 1 << 30), F.col("ps")[0]["first"], lambda s, p: s * p["keep"] + p["add"]).alias(value))


def psnr_by_frame(pixels: DataFrame, other: DataFrame) -> DataFrame:
    """Peak signal-to-noise ratio of two sets of frames with values in [0, 1]."""
    b = other.select("frame_id", "x", "y", F.col("v").alias("w"))
    d = F.col("v") - F.col("w")
    return pixels.join(b, ["frame_id", "x", "y"]).groupBy("frame_id").agg(F.avg(d * d).alias("mse")).select("frame_id", C.psnr(F.col("mse")).alias("psnr"))


def resize(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Bilinear, by pixel centres, clamped at the borders."""
    sx, sy = width / to_width, height / to_height
    # joins with ranges, whose sizes they multiply: what explode() makes of the few distinct frames looks small enough to be broadcast
    numbers = pixels.sparkSession.range(to_width * to_height).select((F.col("id") % to_width).cast("int").alias("tx"), F.expr(f"cast(id div {to_width} AS int)").alias("ty"))
    targets = pixels.select("frame_id").distinct().crossJoin(F.broadcast(numbers))
    fx = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), (F.col("tx") + 0.5) * sx - 0.5))
    fy = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), (F.col("ty") + 0.5) * sy - 0.5))
    t = targets.withColumns({"fx": fx, "fy": fy}).withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")}).withColumns({"ax": F.col("fx") - F.col("x0"), "ay": F.col("fy") - F.col("y0")})
    near = F.array(*[F.struct(F.least(F.lit(width - 1).cast("long"), F.col("x0") + i).alias("x"), F.least(F.lit(height - 1).cast("long"), F.col("y0") + j).alias("y"), ((F.col("ax") if i else 1 - F.col("ax")) * (F.col("ay") if j else 1 - F.col("ay"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    four = t.select("frame_id", "tx", "ty", F.inline(near))
    return four.join(pixels, ["frame_id", "x", "y"]).groupBy("frame_id", "tx", "ty").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def ssim_of(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5) -> float:
    """Mean structural similarity of two grey images, zero-padded Gaussian windows."""
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    g /= g.sum()

    def blur(x):
        x = np.apply_along_axis(lambda r: np.convolve(r, g, "same"), 0, x)
        return np.apply_along_axis(lambda r: np.convolve(r, g, "same"), 1, x)

    ma, mb = blur(a), blur(b)
    va, vb, ab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * ma * mb + c1) * (2 * ab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def ssim_by_frame(pixels: DataFrame, other: DataFrame) -> DataFrame:
    """A frame is one image, so a group is bounded by the camera's resolution."""
    both = pixels.join(other.select("frame_id", "x", "y", F.col("v").alias("w")), ["frame_id", "x", "y"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        shape = (p["y"].nunique(), p["x"].nunique())
        return pd.DataFrame({"frame_id": [p["frame_id"].iloc[0]], "ssim": [ssim_of(p["v"].to_numpy().reshape(shape), p["w"].to_numpy().reshape(shape))]})

    return both.groupBy("frame_id").applyInPandas(run, "frame_id long, ssim double")


def summary(scores: DataFrame, value: str) -> DataFrame:
    v = F.round(value, 4)
    return scores.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def masked(images: DataFrame, masks: DataFrame, value: str) -> DataFrame:
    """Pixels times the mask of the same frame, camera and place; pixels without a mask stay."""
    key = ["frame_id", "camera_index", "x", "y"]
    return images.join(masks, key, "left").select(*key, (F.col(value) * F.coalesce("mask", F.lit(1.0))).alias(value))


def gate(scores: DataFrame, value: str, least: float = 20.0) -> DataFrame:
    """How many frames fall below a score, the worst one, and a warning if their mean does."""
    verdict = F.when(F.avg(value) < least, "warning").otherwise("ok")
    return scores.agg(F.count("*").alias("frames"), F.count_if(F.col(value) < least).alias("poor"), F.min(value).alias("least"), verdict.alias("verdict"))


def flow(pixels: DataFrame, reach: int = 2, block: int = 8) -> DataFrame:
    """(frame_id, bx, by, dx, dy, error): the shift within reach that best explains each block of a frame from the frame before it, by mean
    absolute difference; ties go to the shorter shift, then by dx and dy. Shifts that leave the image count by what is left in it."""
    shifts = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    now = pixels.select("frame_id", "x", "y", F.col("v").alias("now"), F.explode(shifts).alias("s"))
    now = now.select("frame_id", "now", "s.dx", "s.dy", F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"), (F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"))
    before = pixels.select((F.col("frame_id") + 1).alias("frame_id"), "x", "y", "v")
    cost = now.join(before, ["frame_id", "x", "y"]).groupBy("frame_id", "bx", "by", "dx", "dy").agg(F.round(F.avg(F.abs(F.col("now") - F.col("v"))), 9).alias("error"))
    size = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    best = cost.groupBy("frame_id", "bx", "by").agg(F.min(F.struct("error", size.alias("size"), "dx", "dy")).alias("b"))
    return best.select("frame_id", "bx", "by", "b.dx", "b.dy", "b.error")
