"""Depth to meshes through bricks, and flow between frames, over images that vectors hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import flow as W
from voxelweave.operators import volume as Z
from voxelweave.plans.registry import query
from voxelweave.sources import views as V
from voxelweave.sources.scratch import cut

#: Metres of a voxel and of the truncation.
VOXEL, BAND = 0.05, 0.1


def depth_of_vectors(spark, d):
    """(depth, rig): 64 vectors in a row are a depth map of 64 x 64 pixels, which two cameras side by side have."""
    e = V.table(spark, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) = 64")
    px = e.select(F.expr("vec_id div 64").alias("frame_id"), F.expr("vec_id % 64").alias("y"), F.posexplode("embedding").alias("x", "e"))
    two = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    depth = px.select("frame_id", two.alias("camera_index"), F.col("x").cast("long").alias("x"), "y", (1.5 + 0.05 * F.col("e").cast("double")).alias("depth"))
    c = e.select(F.expr("vec_id div 64").alias("frame_id")).distinct().withColumn("camera_index", two)
    cos, sin, o, one = F.cos(F.col("camera_index") * 0.02), F.sin(F.col("camera_index") * 0.02), F.lit(0.0), F.lit(1.0)
    turn = F.array(F.array(cos, o, sin), F.array(o, one, o), F.array(-sin, o, cos))
    shift = F.array(F.col("camera_index") * -0.1, o, F.col("camera_index") * 0.01)
    lens = [F.lit(v).alias(k) for k, v in (("fx", 64.0), ("fy", 64.0), ("cx", 32.0), ("cy", 32.0), ("width", 64), ("height", 64))]
    return depth, c.select("frame_id", "camera_index", *lens, turn.alias("rotation"), shift.alias("translation"))


_VOLUME = """dp AS MATERIALIZED (SELECT vec_id // 64 AS frame_id, c, x, vec_id % 64 AS y, 1.5::DOUBLE + 0.05::DOUBLE * CAST(embedding[x+1] AS DOUBLE) AS depth FROM embeddings, range(64) a(x), range(2) b(c) WHERE len(embedding) = 64),
rg AS (SELECT c, cos(c*0.02::DOUBLE) AS co, sin(c*0.02::DOUBLE) AS si, c*-0.1::DOUBLE AS tx, c*0.01::DOUBLE AS tz FROM range(2) t(c)),
ra AS (SELECT frame_id, depth, 0.15::DOUBLE + 0.71::DOUBLE*depth/64 AS reach, co*((x-32)/64.0::DOUBLE) - si AS rx, (y-32)/64.0::DOUBLE AS ry, si*((x-32)/64.0::DOUBLE) + co AS rz, -(co*tx - si*tz) AS ex, -(si*tx + co*tz) AS ez FROM dp JOIN rg USING (c)),
sa AS (SELECT frame_id, reach, ex + rx*z AS x, ry*z AS y, ez + rz*z AS z FROM (SELECT *, depth + (-0.15::DOUBLE + i*0.15::DOUBLE) AS z FROM ra, range(3) t(i))),
bx AS (SELECT DISTINCT frame_id, CAST(floor((x-reach)/0.4::DOUBLE) AS BIGINT) AS x0, CAST(floor((x+reach)/0.4::DOUBLE) AS BIGINT) AS x1, CAST(floor((y-reach)/0.4::DOUBLE) AS BIGINT) AS y0, CAST(floor((y+reach)/0.4::DOUBLE) AS BIGINT) AS y1, CAST(floor((z-reach)/0.4::DOUBLE) AS BIGINT) AS z0, CAST(floor((z+reach)/0.4::DOUBLE) AS BIGINT) AS z1 FROM sa),
br AS MATERIALIZED (SELECT DISTINCT frame_id, bx, by_, bz FROM (SELECT frame_id, bx, by_, unnest(range(z0, z1+1)) AS bz FROM (SELECT *, unnest(range(y0, y1+1)) AS by_ FROM (SELECT *, unnest(range(x0, x1+1)) AS bx FROM bx)))),
vo AS (SELECT frame_id, 8*bx+i AS vx, 8*by_+j AS vy, 8*bz+k AS vz FROM br, range(8) a(i), range(8) b(j), range(8) c(k)),
pl AS (SELECT frame_id, vx, vy, vz, (vx+0.5::DOUBLE)*0.05 AS wx, (vy+0.5::DOUBLE)*0.05 AS wy, (vz+0.5::DOUBLE)*0.05 AS wz FROM vo),
ca AS (SELECT frame_id, vx, vy, vz, c, co*wx + si*wz + tx AS qx, wy AS qy, co*wz - si*wx + tz AS qz FROM pl, rg),
pr AS (SELECT *, CAST(round_even(qx/qz*64+32, 0) AS BIGINT) AS px, CAST(round_even(qy/qz*64+32, 0) AS BIGINT) AS py FROM ca WHERE qz > 0),
vol AS MATERIALIZED (SELECT pr.frame_id, vx, vy, vz, avg(least(1, (depth - qz)/0.1::DOUBLE)) AS sdf, CAST(count(*) AS DOUBLE) AS weight FROM pr JOIN dp ON dp.frame_id = pr.frame_id AND dp.c = pr.c AND dp.x = px AND dp.y = py WHERE depth - qz >= -0.1 AND depth BETWEEN 0.5 AND 3 GROUP BY 1, 2, 3, 4)"""


@query("brick_volume", f"WITH {_VOLUME} SELECT frame_id, vx, vy, vz, round(sdf, 6) AS sdf, weight FROM vol")
def brick_volume(spark, d):
    v = Z.fold(*depth_of_vectors(spark, d), VOXEL, BAND, 0.5, 3.0)
    return v.select("frame_id", "vx", "vy", "vz", F.round("sdf", 6).alias("sdf"), "weight")


_NUMBER = "((CAST(a.vx AS BIGINT) + 524288) * 1048576 + (a.vy + 524288)) * 1048576 + (a.vz + 524288)"


@query(
    "depth_to_mesh",
    f"""WITH {_VOLUME}, cu AS MATERIALIZED (SELECT frame_id, vx-i AS x, vy-j AS y, vz-k AS z FROM vol, range(2) a(i), range(2) b(j), range(2) c(k) GROUP BY 1, 2, 3, 4 HAVING count(*) = 8),
ax AS (SELECT * FROM (VALUES (0,1,0,0),(1,0,1,0),(2,0,0,1)) t(axis,i,j,k)),
ed AS (SELECT DISTINCT frame_id, x + p*(1-i) AS vx, y + q*(1-j) AS vy, z + r*(1-k) AS vz, axis, i, j, k FROM cu, ax, range(2) a(p), range(2) b(q), range(2) c(r)),
cr AS (SELECT a.frame_id, a.vx, a.vy, a.vz, ed.axis, ed.i, ed.j, ed.k, least(1, greatest(0, -a.sdf/(b.sdf-a.sdf))) AS t FROM ed JOIN vol a ON a.frame_id = ed.frame_id AND a.vx = ed.vx AND a.vy = ed.vy AND a.vz = ed.vz JOIN vol b ON b.frame_id = ed.frame_id AND b.vx = ed.vx+i AND b.vy = ed.vy+j AND b.vz = ed.vz+k WHERE (a.sdf < 0) <> (b.sdf < 0))
SELECT frame_id AS mesh_id, CAST(({_NUMBER}) * 3 + axis AS BIGINT) AS vid, round((vx+i*t+0.5)*0.05, 6) AS x, round((vy+j*t+0.5)*0.05, 6) AS y, round((vz+k*t+0.5)*0.05, 6) AS z FROM cr a""",
)
def depth_to_mesh(spark, d):
    """The vertices of the mesh that depth maps give; its faces name them."""
    volume = cut(Z.fold(*depth_of_vectors(spark, d), VOXEL, BAND, 0.5, 3.0), "volume")  # read three times
    vertices, _ = Z.mesh(volume, VOXEL)
    return vertices.select("mesh_id", "vid", *[F.round(c, 6).alias(c) for c in "xyz"])


def moving_textures(spark, d, side: int = 48):
    """Two images for each vector: waves with its components in their heights, and the same 0.64 and 0.48 pixels on."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    kx, ky, phase = rng.uniform(-0.9, 0.9, 16), rng.uniform(-0.9, 0.9, 16), rng.uniform(0, 6.28, 16)
    y, x = np.meshgrid(np.arange(side), np.arange(side), indexing="ij")
    waves = [np.cos(kx[:, None] * (x.reshape(-1) - 0.64 * k) + ky[:, None] * (y.reshape(-1) - 0.48 * k) + phase[:, None]) for k in (0, 1)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                heights = 1.5 + own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)[:, :16]
                for k, w in enumerate(waves):
                    grey = (0.5 + heights @ w / 40).astype(np.float32)
                    n = len(grey)
                    whole = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(n, k, np.int64)), whole(side), whole(side), pa.FixedSizeListArray.from_arrays(pa.array(grey.reshape(-1)), side * side).cast(pa.list_(pa.float32()))], names=["sequence", "frame_id", "width", "height", "grey"])

    e = V.table(spark, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) = 64")
    return e.select(F.col("vec_id").cast("long").alias("sequence"), "embedding").mapInArrow(run, "sequence long, frame_id long, width int, height int, grey array<float>")


@query("flow_steadiness", "SELECT vec_id AS sequence, 0.8::DOUBLE AS mean_flow_magnitude, 0.8::DOUBLE AS max_flow_magnitude, 0.0::DOUBLE AS std_flow_magnitude FROM embeddings WHERE len(embedding) = 64")
def flow_steadiness(spark, d):
    """The shift between the two images, found again."""
    s = W.steadiness(moving_textures(spark, d))
    return s.select("sequence", *[F.round(f"{k}_flow_magnitude", 1).alias(f"{k}_flow_magnitude") for k in ("mean", "max", "std")])
