"""Camera rigs: angles, weights, pairing, routing and view selection.

Tables of cameras hold many rigs (rig, camera_index, x, y, z): a rig is as large as its hardware, so cameras meet and are ordered within
their rig, and rigs are spread over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import geometry as G


def directions(cameras: DataFrame) -> DataFrame:
    """Unit direction from each camera to the origin."""
    d = G.normalize(G.scale(G.vec(), -1.0))
    return cameras.withColumns(dict(zip(("dx", "dy", "dz"), d, strict=True)))


def angles(cameras: DataFrame) -> DataFrame:
    """Angle of every ordered pair of different cameras of a rig."""
    a = directions(cameras).select("rig", F.col("camera_index").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("dx", "dy", "dz")])
    b = directions(cameras).select("rig", F.col("camera_index").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("dx", "dy", "dz")])
    n = ("dx", "dy", "dz")
    return a.join(b, "rig").where(F.col("a") != F.col("b")).select("rig", "a", "b", G.angular_distance(G.vec("a_", n), G.vec("b_", n)).alias("angle"))


def isolation_weights(cameras: DataFrame) -> DataFrame:
    """Smallest angle to another camera, scaled to sum to one in each rig; uniform if all are zero."""
    least = angles(cameras).groupBy("rig", "a").agg(F.min("angle").alias("least"))
    own = Window.partitionBy("rig")
    total = F.sum("least").over(own)
    w = F.when(total > 1e-12, F.col("least") / total).otherwise(1 / F.count("*").over(own))
    return least.select("rig", F.col("a").alias("camera_index"), w.alias("weight"))


def valid_counts(cameras: DataFrame) -> DataFrame:
    """Cameras and valid cameras of each rig."""
    return cameras.groupBy("rig").agg(F.count("*").alias("cameras"), F.count_if("valid").alias("valid"))


def adjacent_pairs(cameras: DataFrame) -> DataFrame:
    """Sorted cameras of a rig two by two; an odd last one has no pair."""
    at = F.row_number().over(Window.partitionBy("rig").orderBy("camera_index")) - 1
    p = cameras.select("rig", "camera_index", at.alias("nth")).groupBy("rig", F.floor(F.col("nth") / 2).alias("pair"))
    return p.agg(F.min("camera_index").alias("left"), F.max("camera_index").alias("right"), F.count("*").alias("n")).where("n = 2").drop("n")


def baseline_pairs(cameras: DataFrame, least: float, most: float) -> DataFrame:
    """Pairs of a rig whose distance lies in a range, with their angle."""
    a, b = (cameras.select("rig", *[F.col(c).alias(f"{s}_{c}") for c in ("camera_index", "x", "y", "z")]) for s in "ab")
    d = G.length(G.sub(G.vec("a_"), G.vec("b_")))
    near = a.join(b, "rig").where((F.col("a_camera_index") < F.col("b_camera_index")) & d.between(least, most)).select("rig", F.col("a_camera_index").alias("a"), F.col("b_camera_index").alias("b"), d.alias("baseline"))
    return near.join(angles(cameras), ["rig", "a", "b"])


def route(cameras: DataFrame, workers: int, mode: str) -> DataFrame:
    """(rig, camera_index, worker): contiguous arcs, round robin, or every camera to every worker."""
    if mode == "redundant":
        return cameras.select("rig", "camera_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(workers - 1).cast("long"))).alias("worker"))
    w = Window.partitionBy("rig").orderBy("camera_index")
    worker = F.ntile(workers).over(w) - 1 if mode == "geographic" else (F.row_number().over(w) - 1) % workers
    return cameras.select("rig", "camera_index", worker.cast("long").alias("worker"))


def source_views(cameras: DataFrame, k: int) -> DataFrame:
    """(rig, target, source, nth): for each camera as a target k others of its rig: the nearest one, then each time the one whose direction
    from the origin is farthest in angle from those chosen. Ties go to the earlier camera. A rig with k others or fewer gives them all in
    their order. A rig is a group: tens of cameras."""
    import numpy as np

    def run(rig: pd.DataFrame) -> pd.DataFrame:
        rig = rig.sort_values("camera_index")
        ids, p = rig["camera_index"].to_numpy(), rig[["x", "y", "z"]].to_numpy(float)
        d = p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-8)
        angle = np.round(np.arccos(np.clip(d @ d.T, -1, 1)), 9)
        far = np.round(np.linalg.norm(p[:, None] - p[None], axis=2), 9)
        rows = []
        for t in range(len(ids)):
            others = [i for i in range(len(ids)) if i != t]
            if len(others) > k:
                picked = [min(others, key=lambda i: far[t, i])][:k]  # noqa: B023
                while len(picked) < k:
                    picked.append(max((i for i in others if i not in picked), key=lambda i: angle[i, picked].min()))  # noqa: B023
                others = picked
            rows += [(ids[t], ids[i], n) for n, i in enumerate(others)]
        out = pd.DataFrame(rows, columns=["target", "source", "nth"]).astype("int64")
        out.insert(0, "rig", rig["rig"].iloc[0])
        return out

    return cameras.select("rig", "camera_index", "x", "y", "z").groupBy("rig").applyInPandas(run, "rig long, target long, source long, nth long")


def training_samples(frames: DataFrame, sources: DataFrame, every: int = 1) -> DataFrame:
    """(rig, frame_id, target, sources): every frame with each so-many-th of its rig's cameras as a target and that one's source views that
    the frame has too. frames: rig, frame_id, camera_index of the images that there are; sources: source_views()."""
    at = F.row_number().over(Window.partitionBy("rig", "frame_id").orderBy("camera_index")) - 1
    targets = frames.select("rig", "frame_id", F.col("camera_index").alias("target"), at.alias("nth")).where(F.col("nth") % every == 0).drop("nth")
    there = frames.select("rig", "frame_id", F.col("camera_index").alias("source"))
    pairs = targets.join(sources, ["rig", "target"]).join(there, ["rig", "frame_id", "source"])
    held = pairs.groupBy("rig", "frame_id", "target").agg(F.array_sort(F.collect_list(F.struct("nth", "source"))).alias("s"))
    return held.select("rig", "frame_id", "target", F.transform("s", lambda x: x["source"]).alias("sources"))


def select_spread(cameras: DataFrame, k: int, viewer: tuple[float, float, float] | None = None) -> DataFrame:
    """(rig, camera_index, nth): up to k valid cameras of each rig, each the farthest in angle from those before it; the first is the
    nearest to the viewer's direction, or the first valid one. Ties go to the earlier camera. cameras: rig, camera_index, x, y, z and
    optionally valid."""
    import numpy as np

    def run(rig: pd.DataFrame) -> pd.DataFrame:
        name = rig["rig"].iloc[0]
        rig = rig[rig["valid"]].sort_values("camera_index").reset_index(drop=True)
        if rig.empty or k <= 0:
            return pd.DataFrame({"rig": pd.Series(dtype="int64"), "camera_index": pd.Series(dtype="int64"), "nth": pd.Series(dtype="int64")})
        d = -rig[["x", "y", "z"]].to_numpy(float)
        d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
        angle = np.arccos(np.clip(d @ d.T, -1, 1))
        seed = 0
        if viewer is not None:
            v = -np.asarray(viewer, float)
            seed = int(np.argmin(np.round(np.arccos(np.clip(d @ (v / max(np.linalg.norm(v), 1e-12)), -1, 1)), 9)))
        picked, least = [seed], angle[seed].copy()
        while len(picked) < min(k, len(rig)):
            least[picked] = -1
            nxt = int(np.argmax(np.round(least, 9)))
            picked.append(nxt)
            least = np.minimum(least, angle[nxt])
        return pd.DataFrame({"rig": name, "camera_index": rig["camera_index"].to_numpy()[picked], "nth": range(len(picked))})

    rig = cameras if "valid" in cameras.columns else cameras.withColumn("valid", F.lit(True))
    return rig.select("rig", "camera_index", "x", "y", "z", "valid").groupBy("rig").applyInPandas(run, "rig long, camera_index long, nth long")


def split(ids: DataFrame, key: str, train: float, seed: int) -> DataFrame:
    """Train or validation by a hash of the id, at least one row to train."""
    from voxelweave.operators.sync import numbered

    place = F.crc32(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    n = F.broadcast(ids.agg(F.count("*").alias("_all")))  # one row
    rows = numbered(ids.select(key, place.alias("_hash")), ["_hash", key], "_nth").crossJoin(n)
    return rows.select(key, F.when(F.col("_nth") < F.greatest(F.lit(1), F.floor(F.col("_all") * train)), "train").otherwise("val").alias("split"))


def split_counts(samples: DataFrame) -> DataFrame:
    """Samples, frames, targets and share of each split. samples: split, frame_id, target."""
    s = samples.groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct("frame_id").alias("frames"), F.count_distinct("target").alias("targets"))
    return s.withColumn("share", F.col("samples") / F.sum("samples").over(Window.partitionBy(F.lit(0))))
