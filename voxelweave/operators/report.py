"""Summaries of runs: checkpoints, losses by epoch, harness and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept_checkpoints(checkpoints: DataFrame, last: int) -> DataFrame:
    """The newest so many checkpoints of each run, and its best one (smallest loss, ties to the earlier). checkpoints: run, step, loss."""
    newest = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))
    best = F.row_number().over(Window.partitionBy("run").orderBy(F.asc_nulls_last("loss"), "step"))
    return checkpoints.withColumns({"_newest": newest, "_best": best}).where((F.col("_newest") <= last) | (F.col("_best") == 1)).drop("_newest", "_best")


def epoch_losses(steps: DataFrame) -> DataFrame:
    """Mean loss and steps of each epoch of a run. steps: run, epoch, loss."""
    return steps.groupBy("run", "epoch").agg(F.avg("loss").alias("loss"), F.count("*").alias("steps"))


def harness_summary(frames: DataFrame) -> DataFrame:
    """Frames, their mean splats and time, and the rate that this gives. frames: splats, ms."""
    mean = F.avg("ms")
    return frames.agg(F.count("*").alias("frames"), F.avg("splats").alias("mean_splats"), mean.alias("mean_ms"), F.when(mean > 0, 1000 / mean).alias("fps"))


def evaluation(scores: DataFrame, values: list[str]) -> DataFrame:
    """One JSON row: mean, deviation, least and most of each score, and the scores of every frame in order. scores: frame_id and values."""
    parts = []
    for v in values:
        parts.append(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).alias(v))
    rows = F.array_sort(F.collect_list(F.struct("frame_id", *values))).alias("frames")
    return scores.agg(F.struct(*parts).alias("summary"), rows).select(F.to_json(F.struct("summary", "frames")).alias("json"))


def error_map(pixels: DataFrame, other: DataFrame, gain: float = 5.0) -> DataFrame:
    """Absolute difference of two sets of frames, multiplied and cut at 1."""
    b = other.select("frame_id", "x", "y", F.col("v").alias("w"))
    return pixels.join(b, ["frame_id", "x", "y"]).select("frame_id", "x", "y", F.least(F.lit(1.0), gain * F.abs(F.col("v") - F.col("w"))).alias("v"))
