"""Centroid clustering by sort-means, in whole numbers.

Every round the centroids' distances to each other are sorted, for each centroid all others by their distance from it. A vector begins at
the centroid of its previous assignment, at distance d, and tries the others in that order; a centroid farther than 2 d from the first one
cannot be nearer than d (triangle inequality), so the scan stops strictly beyond 2 d: at equality a centroid with a smaller number may
still tie. Squares are compared, so nothing is rounded.

Components are taken as floor(scale * x) and the means as floor(sum / count) of exact sums, so the result does not depend on how rows are
dealt. A round is one pass of Arrow batches that writes each vector with its assignment, and one that adds up sums: a batch gives at most k
rows, so a cluster that holds most vectors moves no more than others. Only the k centroids are on the driver, and are sent to the tasks. The
table of a round is deleted when the next is written; a lost executor repeats its tasks from the table before.

Cases: vectors that are null, of another length, or hold a null or non-finite component take no part, nor do those with a component beyond
2**26 after scaling, whose squared distances a long can't hold; fewer vectors than k give as many centroids; repeated rows are vectors each;
equal start hashes (repeated ids) go by components; a null id is hashed as an empty number; centroids may be equal, the smaller number takes
all; an empty centroid stays where it is; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import discard, materialize

#: Largest size of a scaled component: differences, squares times 4 and their sum over 64 components stay within a long.
LARGEST = 1 << 26


def whole_vectors(rows: DataFrame, scale: int, width: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the vectors that take part; v holds floor(scale * x) of each component x."""
    x = F.col(vector)
    fit = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) <= LARGEST))  # neither NaN nor an infinity passes
    kept = rows.where(x.isNotNull() & (F.size(x) == width)).where(F.coalesce(fit, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest centroid and squared distance, scanning from centroid start, and how many distances were worked out."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    best, dist, worked = start.copy(), np.zeros(len(x), np.int64), len(x)
    for c in np.unique(start).tolist():
        mine = np.nonzero(start == c)[0]
        first = ((x[mine] - centroids[c]) ** 2).sum(1)
        order = np.argsort(-first, kind="stable")  # the farthest scan longest: who still scans is always a leading part
        mine, first = mine[order], first[order]
        near, at = first.copy(), np.full(len(mine), c)
        for j in np.argsort(between[c], kind="stable").tolist():
            if j == c:
                continue
            n = int(np.searchsorted(-4 * first, -between[c, j], side="right"))
            if not n:
                break
            worked += n
            d = ((x[mine[:n]] - centroids[j]) ** 2).sum(1)
            better = (d < near[:n]) | ((d == near[:n]) & (j < at[:n]))
            near[:n][better], at[:n][better] = d[better], j
        best[mine], dist[mine] = at, near
    return best, dist, worked


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance) from (vec_id, v, cluster); the cluster before is where each scan begins."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, dist, _ = nearest(_matrix(batch.column(1), centroids.shape[1]), batch.column(2).to_numpy().astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(dist)], names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor of the mean of its vectors; empty ones stay."""
    import pyarrow as pa

    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            x = _matrix(batch.column(0), width)
            held = np.unique(cluster)
            sums = [x[cluster == c].sum(0) for c in held]
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(np.bincount(cluster, minlength=k)[held]), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = assigned.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for row in total.collect():  # at most k rows
        out[row["cluster"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(width)]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The k vectors of smallest hash of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, width)


def sort_means(rows: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every vector that takes part."""
    at = whole_vectors(rows, scale, width, vector, key)
    centroids = first_centroids(at, k, seed, width)
    at = at.withColumn("cluster", F.lit(0))
    if len(centroids):
        for r in range(rounds + 1):
            before, at = at, materialize(assign(at, centroids), "assigned")
            if r:
                discard(before)
            if r < rounds:
                centroids = moved(at, centroids)
    else:
        at = at.withColumn("distance", F.lit(0).cast("long"))
    own = at.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
    found = {r["cluster"]: r["cluster_inertia"] for r in own.collect()}  # at most k rows
    named = [(c, found.get(c), sum(found.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v) for c, v in enumerate(centroids.tolist())]
    clusters = at.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return at.drop("v").join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
