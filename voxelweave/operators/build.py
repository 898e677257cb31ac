"""From depth maps to textured-ready mesh files in one go: volume, surface, simplification, atlas, seams, normals, one GLB for each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import geometry as G
from voxelweave.operators import atlas as A
from voxelweave.operators import simplify as S
from voxelweave.operators import volume as Z
from voxelweave.sources import writers
from voxelweave.sources.scratch import cut


def counted_up(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with vertex ids from 0 in each mesh, in the order of the old ones: ranges of the order are written, counted and
    numbered on their own, so one large mesh is not one task."""
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(vertices.repartitionByRange(parts, "mesh_id", "vid").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("mesh_id", "_part").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("mesh_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    at = F.row_number().over(Window.partitionBy("mesh_id", "_part").orderBy("vid"))
    named = cut(dealt.withColumn("_at", at).join(counts.withColumn("_before", before), ["mesh_id", "_part"]).withColumn("_new", F.col("_at") + F.col("_before") - 1).drop("_part", "_at", "_before", "_k"), "numbered")
    out = faces
    for k in range(3):
        out = out.join(named.select("mesh_id", F.col("vid").alias(f"i{k}"), F.col("_new").alias(f"n{k}")), ["mesh_id", f"i{k}"])
    return named.drop("vid").withColumnRenamed("_new", "vid"), out.select("mesh_id", "fid", *[F.col(f"n{k}").alias(f"i{k}") for k in range(3)])


def with_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices with unit normals: sums of the area-weighted normals of the faces around each; upwards where there is none."""
    n = G.cross(G.sub(G.vec("b"), G.vec("a")), G.sub(G.vec("c"), G.vec("a")))
    each = S.cornered(faces, vertices).select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *[c.alias(f"n{k}") for k, c in zip("xyz", n, strict=True)])
    sums = each.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"]).withColumn("_size", G.length(G.vec("n")))
    unit = [F.when(F.col("_size") > 0, F.col(f"n{k}") / F.col("_size")).otherwise(float(k == "y")).alias(f"n{k}") for k in "xyz"]
    return vertices.join(sums.select("mesh_id", "vid", *unit), ["mesh_id", "vid"])


def depth_to_files(depth: DataFrame, rig: DataFrame, folder: str, voxel: float, truncation: float, near: float, far: float, color: str | None = None, target: int = 25_000, least: int = 5_000, target_error: float = 0.01, resolution: int = 2048, gutter: int = 4, rounds: int = 400) -> DataFrame:
    """Writes mesh_<frame>.glb for each frame that has a surface. Gives (mesh_id, output_faces, output_vertices, result_error, charts, utilization,
    gutter) of each."""
    volume = cut(Z.fold(depth, rig, voxel, truncation, near, far, color=color), "volume")
    vertices, faces = (cut(t, n) for t, n in zip(Z.mesh(volume, voxel), ("vertices", "triangles"), strict=True))
    vertices, faces, simpler = S.simplify(vertices, faces, target, least, target_error, rounds=rounds)
    corners, atlas = A.unwrap(faces, vertices, resolution, gutter)
    corners = cut(corners, "corners")
    normal = with_normals(vertices, faces)
    vertices, faces = counted_up(*A.split_seams(corners, normal))
    if color:
        vertices = vertices.withColumns({c: F.round("color").cast("int") for c in "rgb"})
    writers.write_payloads(writers.mesh_payloads(faces, vertices), folder, "mesh_%06d.glb", "mesh_id")
    return simpler.join(atlas, "mesh_id").select("mesh_id", "output_faces", "output_vertices", "result_error", "charts", "utilization", "gutter")
