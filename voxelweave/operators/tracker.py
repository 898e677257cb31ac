"""Temporal tracking of splats: each step is a lazy plan over the stored splats and a new frame; the caller materialises between steps.

State: splat_id, px, py, pz, sx, sy, sz, qw, qx, qy, qz, opacity, sh, age (frames matched, or minus the frames missed).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import spatial as S

ATTRIBUTES = ("px", "py", "pz", "sx", "sy", "sz", "qw", "qx", "qy", "qz", "opacity")


@dataclass(frozen=True)
class TrackerConfig:
    """Defaults are the reference settings: fixed values."""

    decay: float = 0.85
    match_distance: float = 0.02
    color_weight: float = 0.3
    ramp_in: int = 3
    ramp_out: int = 3
    min_opacity: float = 0.01
    budget: int = 500_000


def start(frame: DataFrame) -> DataFrame:
    return frame.select("splat_id", *ATTRIBUTES, "sh", F.lit(1).alias("age"))


def step(state: DataFrame, frame: DataFrame, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """The state after a frame: matched splats blend with the cheapest new one and age, others fade, the dead go, unmatched new ones
    come in, and the most opaque stay within the budget."""
    new = frame.select("splat_id", *ATTRIBUTES, "sh")
    found = S.match(new.select("splat_id", "px", "py", "pz", "sh"), state.select("splat_id", "px", "py", "pz", "sh"), cfg.match_distance, cfg.match_distance, cfg.color_weight)
    best = found.where("old_id IS NOT NULL").groupBy("old_id").agg(F.min(F.struct("cost", "splat_id")).alias("m")).select("old_id", F.col("m.splat_id").alias("new_id"))
    n = new.select(F.col("splat_id").alias("new_id"), *[F.col(c).alias(f"n_{c}") for c in (*ATTRIBUTES, "sh")])
    rows = state.join(best.join(n, "new_id"), F.col("splat_id") == F.col("old_id"), "left")
    hit = F.col("old_id").isNotNull()
    mix = {c: F.when(hit, F.col(c) * cfg.decay + F.col(f"n_{c}") * (1 - cfg.decay)).otherwise(F.col(c)) for c in ATTRIBUTES}
    slow = cfg.decay * 0.5 + 0.5
    mix["sh"] = F.when(hit, F.zip_with("sh", "n_sh", lambda a, b: a * slow + b * (1 - slow))).otherwise(F.col("sh"))
    age = F.when(hit, F.greatest(F.lit(1), F.col("age") + 1)).otherwise(F.when(F.col("age") > 0, -1).otherwise(F.col("age") - 1))
    rows = rows.select("splat_id", *[x.alias(c) for c, x in mix.items()], age.cast("int").alias("age"))
    norm = F.sqrt(sum((F.col(q) * F.col(q) for q in ("qw", "qx", "qy", "qz")), F.lit(0.0)))
    rows = rows.withColumns({q: F.when(norm > 1e-6, F.col(q) / norm).otherwise(F.col(q)) for q in ("qw", "qx", "qy", "qz")})
    ramp = F.when((F.col("age") > 0) & (F.col("age") <= cfg.ramp_in), F.col("age") / cfg.ramp_in).when(F.col("age") < 0, F.greatest(F.lit(0.0), 1 + F.col("age") / cfg.ramp_out)).otherwise(1.0)
    alive = rows.withColumn("opacity", F.col("opacity") * ramp).where(F.col("opacity") >= cfg.min_opacity)
    added = new.join(found.where("old_id IS NULL").select("splat_id"), "splat_id").select("splat_id", *ATTRIBUTES, "sh", F.lit(1).alias("age"))
    return alive.unionByName(added).orderBy(F.desc("opacity"), "splat_id").limit(cfg.budget)


def track(frames: list[DataFrame], materialise, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Runs the frames in order; materialise cuts the lineage after each (a checkpoint or a written table)."""
    state = start(frames[0])
    for f in frames[1:]:
        state = materialise(step(state, f, cfg))
    return state
