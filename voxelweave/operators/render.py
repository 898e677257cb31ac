"""Splat projection and compositing, for small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import color as C
from voxelweave.functions import geometry as G


def project_splats(splats: DataFrame, fx: float, fy: float, cx: float, cy: float, near: float = 0.1) -> DataFrame:
    """Screen place, 2-D covariance with the usual regulariser, its axes at three deviations, and colour of each splat in front."""
    cov = G.covariance(tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")), G.vec(names=("sx", "sy", "sz")))
    xx, xy, xz, yy, yz, zz = cov
    x, y, z = F.col("px"), F.col("py"), F.col("pz")
    j = ((fx / z, F.lit(0.0), -fx * x / (z * z)), (F.lit(0.0), fy / z, -fy * y / (z * z)))
    m = ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))
    form = lambda a, b: sum((j[a][i] * m[i][k] * j[b][k] for i in range(3) for k in range(3)), F.lit(0.0))
    rows = splats.where(z > near).withColumns({"u": x / z * fx + cx, "v": y / z * fy + cy, "a": form(0, 0) + 0.3, "b": form(0, 1), "c": form(1, 1) + 0.3})
    mid, off = (F.col("a") + F.col("c")) / 2, F.sqrt(F.greatest(F.lit(0.0), ((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") * F.col("b")))
    return rows.withColumns({"major": 3 * F.sqrt(mid + off), "minor": 3 * F.sqrt(F.greatest(F.lit(0.0), mid - off)), **{n: C.sh_dc_color(F.col("sh")[i]) for i, n in enumerate(("red", "green", "blue"))}})


def composite(projected: DataFrame, width: int, height: int) -> DataFrame:
    """Colour and coverage of each touched pixel: splats over one another, nearest first, folded in the engine. A splat reaches the
    pixels of its own box only."""
    r = F.col("major")
    span = lambda c, top: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - r)).cast("int"), F.greatest(F.lit(0), F.least(F.lit(top - 1), F.ceil(F.col(c) + r))).cast("int"))
    p = projected.withColumn("x", F.explode(span("u", width))).withColumn("y", F.explode(span("v", height)))
    dx, dy = F.col("x") + 0.5 - F.col("u"), F.col("y") + 0.5 - F.col("v")
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    d = (F.col("c") * dx * dx - 2 * F.col("b") * dx * dy + F.col("a") * dy * dy) / det / 9
    p = p.withColumn("alpha", C.falloff(d, F.col("opacity"))).where("alpha IS NOT NULL")
    held = p.groupBy("frame_id", "x", "y").agg(F.array_sort(F.collect_list(F.struct("pz", "splat_id", "alpha", "red", "green", "blue"))).alias("s"))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("r", "g", "b")], F.lit(1.0).alias("t"))
    fold = F.aggregate("s", zero, lambda o, s: F.struct(*[(o[k] + o["t"] * s["alpha"] * s[n]).alias(k) for k, n in (("r", "red"), ("g", "green"), ("b", "blue"))], (o["t"] * (1 - s["alpha"])).alias("t")))
    return held.select("frame_id", "x", "y", fold.alias("o")).select("frame_id", "x", "y", "o.r", "o.g", "o.b", (1 - F.col("o.t")).alias("coverage"))


def view_blend(samples: DataFrame) -> DataFrame:
    """View-dependent texture: weighted colour over cameras with a weight of 0.01 and more and a place inside their image.
    samples: key, n_dot_c, c_dot_v, tex_u, tex_v, col."""
    w = C.view_weight(F.col("n_dot_c"), F.col("c_dot_v"))
    rows = samples.withColumn("w", w).where((F.col("w") >= 0.01) & F.col("tex_u").between(0, 1) & F.col("tex_v").between(0, 1))
    return rows.groupBy("key").agg((F.sum(F.col("w") * F.col("col")) / F.sum("w")).alias("col"), F.count("*").alias("views"))
