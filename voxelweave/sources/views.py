"""Capture-shaped views over the driver tables: splats, arrivals, packets, cameras, depth maps, grids, meshes and pixels.

Each is a lazy DataFrame; only the columns that a query asks for are read from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.sources.scratch import left_as_dealt

#: Frames that a task can hold and sort.
TOGETHER = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per splat with the 59 attributes; scalar columns for what is joined or summed, an array for the colour bands."""
    e = lambda i: F.col("embedding")[i].cast("double")
    norm = F.sqrt(sum((e(i) * e(i) for i in range(6, 10)), F.lit(0.0)))
    quat = [F.when(norm > 0, e(i) / norm).otherwise(1.0 if i == 6 else 0.0).alias(n) for i, n in zip(range(6, 10), ("qw", "qx", "qy", "qz"), strict=True)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("splat_id"),
        F.col("label").cast("long").alias("frame_id"),
        (F.col("vec_id") % 4).alias("worker_id"),
        *[e(i).alias(n) for i, n in enumerate(("px", "py", "pz"))],
        *[F.exp(e(i)).alias(n) for i, n in zip(range(3, 6), ("sx", "sy", "sz"), strict=True)],
        *quat,
        ((e(10) + 1) / 2).alias("opacity"),
        F.transform(F.slice("embedding", 12, 48), lambda x: x.cast("double")).alias("sh"),
    )


def splats_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats from orders, for scale."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("splat_id"),
        (c % 64).alias("frame_id"),
        (k % 4).alias("worker_id"),
        (F.col("o_totalprice") / 500000).alias("px"),
        ((k % 97) / 97.0).alias("py"),
        ((c % 89) / 89.0).alias("pz"),
        (((k % 100) + 1) / 100.0).alias("opacity"),
    )


def stable_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats whose ids stand for the same splat in each frame: their place in it, less those that a frame misses."""
    at = F.row_number().over(Window.partitionBy("frame_id").orderBy("splat_id")).cast("long")
    return splats(spark, sf_dir).withColumn("splat_id", at).where("(splat_id + frame_id) % 9 <> 0")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results as they arrive at the aggregator: an hour of the events is a second and a frame, a user is one of four workers."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("frame_id"),
        (F.col("user_id") % 4).alias("worker_id"),
        ts.alias("arrival_ts"),
        F.expr("unix_micros(cast(ts as timestamp)) div 3600000").alias("timestamp_ms"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
        "event_type",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals as stream packets: views are video, signups keyframes, clicks and purchases deltas; errors are no packets."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'video' WHEN 'signup' THEN 'keyframe' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'delta' END")
    return arrivals(spark, sf_dir).where("event_type <> 'error'").withColumn("type", kind).drop("event_type")


def frames(spark: SparkSession, sf_dir: str, together: int | None = None) -> DataFrame:
    """A captured frame for each supplier: what rigs, depth maps, volumes, meshes and images below are repeated by. Frames are dealt over a
    fixed number of partitions, as the few bytes that name them would all go to one task, and what is keyed by frame needs no exchange, be it
    joined or summed. together: so many frames to a partition at most, on average; for what tasks sort, so that it fits their memory."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if together is not None:
        parts = max(parts, -(-rows.count() // together))  # counted from the files' footers
    return left_as_dealt(rows).repartition(parts, "frame_id")


def _repeated(rows: DataFrame, n: int, out: str = "i") -> DataFrame:
    """Each row n times. A join with n numbers, as the planner takes what explode() makes for as small as what it came from, and would
    collect it on the driver to broadcast it."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(n).select(F.col("id").alias(out))))


def cameras(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """For each frame a rig: a ring of cameras that look at the origin, of its own radius, some above the plane, some not valid."""
    a = F.col("camera_index") * (2 * 3.141592653589793 / n)
    r = 3.0 + (F.col("rig") % 5) * 0.1
    c = _repeated(frames(spark, sf_dir).withColumnRenamed("frame_id", "rig"), n, "camera_index")
    return c.select("rig", "camera_index", (F.cos(a) * r).alias("x"), ((3 * F.col("camera_index") + F.col("rig")) % 4 * 0.1).alias("y"), (F.sin(a) * r).alias("z"), ((F.col("rig") + F.col("camera_index")) % 7 != 0).alias("valid"))


def depth(spark: SparkSession, sf_dir: str, views: int = 3, width: int = 32, height: int = 24, together: int | None = None) -> DataFrame:
    """Depth maps, masks and grey values, one row per pixel."""
    px = _repeated(frames(spark, sf_dir, together), views * width * height).select("frame_id", F.expr(f"i div {width * height}").alias("camera_index"), F.expr(f"i % {width}").alias("x"), F.expr(f"(i div {width}) % {height}").alias("y"))
    return px.select("frame_id", "camera_index", "x", "y", F.expr("1.5D + 0.01D * ((7 * x + 13 * y + 3 * camera_index + frame_id) % 11)").alias("depth"), F.expr("CASE WHEN (x + y + frame_id) % 7 <> 0 THEN 255 ELSE 0 END").alias("alpha"), F.expr("((x + 2 * y + camera_index) % 10) / 10.0D").alias("grey"))


def depth_rig(spark: SparkSession, sf_dir: str, together: int | None = None) -> DataFrame:
    """Three cameras of each frame side by side, turned a little about the y axis: intrinsics, rotation and shift from world to camera."""
    c = _repeated(frames(spark, sf_dir, together), 3, "camera_index")
    cos, sin = F.cos(F.col("camera_index") * 0.02), F.sin(F.col("camera_index") * 0.02)
    o, e = F.lit(0.0), F.lit(1.0)
    turn = F.array(F.array(cos, o, sin), F.array(o, e, o), F.array(-sin, o, cos))
    shift = F.array(F.col("camera_index") * -0.1, o, F.col("camera_index") * 0.01)
    return c.select("frame_id", "camera_index", *[F.lit(v).alias(k) for k, v in (("fx", 30.0), ("fy", 30.0), ("cx", 16.0), ("cy", 12.0))], turn.alias("rotation"), shift.alias("translation"))


def voxels(spark: SparkSession, sf_dir: str, n: int = 12, together: int | None = None) -> DataFrame:
    """Centres of an n x n x n volume for each frame."""
    i = F.col("i")
    return _repeated(frames(spark, sf_dir, together), n**3).select("frame_id", (F.col("frame_id") * n**3 + i).alias("voxel_id"), ((i % n + 0.5) * 0.05 - 0.3).alias("wx"), ((F.expr(f"i div {n}") % n + 0.5) * 0.05 - 0.3).alias("wy"), ((F.expr(f"i div {n * n}") + 0.5) * 0.05 + 1.3).alias("wz"))


def sdf_grid(spark: SparkSession, sf_dir: str, n: int = 12) -> DataFrame:
    """Signed distance to a sphere, of each frame's own radius, at the centres of an n x n x n brick; bricks lie apart along x. Voxels also
    hold how often they were seen, and a colour."""
    v = _repeated(frames(spark, sf_dir), n**3).select("frame_id", F.expr(f"i % {n}").alias("lx"), F.expr(f"(i div {n}) % {n}").alias("vy"), F.expr(f"i div {n * n}").alias("vz"))
    c = [(F.col(k) + 0.5) / n - 0.5 for k in ("lx", "vy", "vz")]
    sdf = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) - (0.35 - (F.col("frame_id") % 7) * 0.02)
    return v.select((F.col("frame_id") * 2 * n + F.col("lx")).alias("vx"), "vy", "vz", sdf.alias("sdf"), ((F.col("lx") + F.col("vy") + F.col("vz")) % 5).cast("double").alias("weight"))


def height_field(spark: SparkSession, sf_dir: str, n: int = 24) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of an n x n height field for each frame, 1000 apart along x, with two triangles to a cell."""
    v = _repeated(frames(spark, sf_dir, TOGETHER), n * n).select("frame_id", (F.col("frame_id") * n * n + F.col("i")).alias("vid"), F.expr(f"i div {n}").alias("row"), F.expr(f"i % {n}").alias("j"))
    vertices = v.select("frame_id", "vid", (F.col("row") + 1000 * F.col("frame_id")).cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.expr("(31 * row + 17 * j + frame_id) % 10") / 100.0).alias("z"))
    cells = v.where(f"row < {n - 1} AND j < {n - 1}")
    two = F.array(F.struct((2 * F.col("vid")).alias("fid"), F.col("vid").alias("i0"), (F.col("vid") + n).alias("i1"), (F.col("vid") + 1).alias("i2")), F.struct((2 * F.col("vid") + 1).alias("fid"), (F.col("vid") + 1).alias("i0"), (F.col("vid") + n).alias("i1"), (F.col("vid") + n + 1).alias("i2")))
    return vertices, cells.select("frame_id", F.inline(two))


def relief(spark: SparkSession, sf_dir: str, side: int = 8) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a mesh for each vector, its components as heights over a side x side grid. Vectors of another length are no
    mesh; a null component has height 0."""
    rows = table(spark, sf_dir, "embeddings").where(f"embedding IS NOT NULL AND size(embedding) = {side * side}").select(F.col("vec_id").alias("mesh_id"), F.posexplode("embedding").alias("i", "h"))
    v = rows.select("mesh_id", F.col("i").cast("long").alias("vid"), F.expr(f"cast(i div {side} as double)").alias("x"), F.expr(f"cast(i % {side} as double)").alias("y"), (F.coalesce(F.col("h").cast("double"), F.lit(0.0)) * 4).alias("z"))
    low = F.col("vid") < side * (side - 1)
    cells = v.where(low & (F.col("vid") % side < side - 1)).select("mesh_id", "vid")
    two = F.array(F.struct((2 * F.col("vid")).alias("fid"), F.col("vid").alias("i0"), (F.col("vid") + side).alias("i1"), (F.col("vid") + 1).alias("i2")), F.struct((2 * F.col("vid") + 1).alias("fid"), (F.col("vid") + 1).alias("i0"), (F.col("vid") + side).alias("i1"), (F.col("vid") + side + 1).alias("i2")))
    return v, cells.select("mesh_id", F.inline(two))


def eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewpoint low over each frame's height field."""
    return frames(spark, sf_dir, TOGETHER).select("frame_id", (1000 * F.col("frame_id") + 11.3).alias("ex"), (11.7 + F.col("frame_id") % 3).alias("ey"), F.lit(0.4).alias("ez"))


def overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cameras above each frame's height field."""
    c = _repeated(frames(spark, sf_dir, TOGETHER), 4, "camera_index")
    return c.select("frame_id", "camera_index", (1000 * F.col("frame_id") + 4.3 + 5 * F.col("camera_index")).alias("x"), (18.1 - 4 * F.col("camera_index")).alias("y"), (2.7 + F.col("camera_index")).alias("z"))


def pixels(spark: SparkSession, sf_dir: str, width: int = 48, height: int = 32) -> DataFrame:
    """Grey frames with values in [0, 1], one row per pixel."""
    px = _repeated(frames(spark, sf_dir), width * height).select("frame_id", F.expr(f"i % {width}").alias("x"), F.expr(f"i div {width}").alias("y"))
    return px.withColumn("v", F.expr("((x * 31 + y * 17 + frame_id * 7) % 101) / 100.0D"))


def segments(spark: SparkSession, sf_dir: str, span: int = 30) -> DataFrame:
    """A stream's segments: as many frames as there are customers, so many to a segment."""
    key = F.expr(f"c_custkey div {span}")
    return table(spark, sf_dir, "customer").groupBy(key.alias("segment")).agg(F.min("c_custkey").alias("start_frame"), F.max("c_custkey").alias("end_frame")).withColumn("url", F.format_string("seg_%05d", "segment"))


# The same views for the independent engine.
SPLATS = """e0 AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
e1 AS (SELECT *, sqrt(e[7]*e[7]+e[8]*e[8]+e[9]*e[9]+e[10]*e[10]) AS nq FROM e0),
splats AS (SELECT vec_id AS splat_id, CAST(label AS BIGINT) AS frame_id, vec_id % 4 AS worker_id, e[1] AS px, e[2] AS py, e[3] AS pz,
 exp(e[4]) AS sx, exp(e[5]) AS sy, exp(e[6]) AS sz, e[7]/nq AS qw, e[8]/nq AS qx, e[9]/nq AS qy, e[10]/nq AS qz,
 (e[11]+1)/2 AS opacity, e[12:59] AS sh FROM e1)"""
SPLATS_BIG = """splats AS (SELECT o_orderkey AS splat_id, o_custkey % 64 AS frame_id, o_orderkey % 4 AS worker_id, o_totalprice/500000 AS px,
 (o_orderkey % 97)/97.0::DOUBLE AS py, (o_custkey % 89)/89.0::DOUBLE AS pz, ((o_orderkey % 100)+1)/100.0::DOUBLE AS opacity FROM orders)"""
STABLE = SPLATS.replace("splats AS (", "splats0 AS (") + """,
splats AS (SELECT * EXCLUDE (place) REPLACE (place AS splat_id) FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY splat_id) AS place FROM splats0) WHERE (place + frame_id) % 9 <> 0)"""
ARRIVALS = """arrivals AS (SELECT event_id, epoch_us(ts) // 3600000000 AS frame_id, user_id % 4 AS worker_id, epoch_us(ts) // 3600000 AS timestamp_ms,
 CAST(round(value * 100) AS BIGINT) AS bytes, event_type FROM events)"""
PACKETS = ARRIVALS + """, packets AS (SELECT event_id, frame_id, worker_id, timestamp_ms, bytes,
 CASE event_type WHEN 'view' THEN 'video' WHEN 'signup' THEN 'keyframe' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'delta' END AS type
 FROM arrivals WHERE event_type <> 'error')"""
FRAMES = "frames AS (SELECT s_suppkey AS frame_id FROM supplier)"
CAMERAS = f"""{FRAMES}, cameras AS (SELECT frame_id AS rig, i AS camera_index, cos(i * (2 * 3.141592653589793 / 8)) * (3.0::DOUBLE + (frame_id % 5) * 0.1::DOUBLE) AS x, (3 * i + frame_id) % 4 * 0.1::DOUBLE AS y,
 sin(i * (2 * 3.141592653589793 / 8)) * (3.0::DOUBLE + (frame_id % 5) * 0.1::DOUBLE) AS z, (frame_id + i) % 7 <> 0 AS valid FROM frames, range(8) t(i))"""
DEPTH = f"""{FRAMES}, depth AS MATERIALIZED (SELECT frame_id, c AS camera_index, x, y, 1.5::DOUBLE + 0.01::DOUBLE * ((7*x + 13*y + 3*c + frame_id) % 11) AS depth,
 CASE WHEN (x + y + frame_id) % 7 <> 0 THEN 255 ELSE 0 END AS alpha, ((x + 2*y + c) % 10)/10.0::DOUBLE AS grey FROM frames, range(3) a(c), range(32) b(x), range(24) d(y)),
rig AS (SELECT c, cos(c * 0.02::DOUBLE) AS co, sin(c * 0.02::DOUBLE) AS si, c * -0.1::DOUBLE AS tx, c * 0.01::DOUBLE AS tz FROM range(3) r(c))"""
VOXELS = """voxels AS (SELECT frame_id, frame_id * 1728 + i AS voxel_id, (i % 12 + 0.5::DOUBLE)*0.05-0.3 AS wx, ((i // 12) % 12 + 0.5::DOUBLE)*0.05-0.3 AS wy, (i // 144 + 0.5::DOUBLE)*0.05+1.3 AS wz FROM frames, range(1728) t(i))"""
SDF = f"""{FRAMES}, sdf_grid AS MATERIALIZED (SELECT frame_id * 24 + x AS vx, y AS vy, z AS vz, sqrt(((x+0.5::DOUBLE)/12-0.5)*((x+0.5::DOUBLE)/12-0.5)+((y+0.5::DOUBLE)/12-0.5)*((y+0.5::DOUBLE)/12-0.5)+((z+0.5::DOUBLE)/12-0.5)*((z+0.5::DOUBLE)/12-0.5))
 - (0.35::DOUBLE - (frame_id % 7) * 0.02::DOUBLE) AS sdf, CAST((x + y + z) % 5 AS DOUBLE) AS weight FROM frames, range(12) a(x), range(12) b(y), range(12) c(z))"""
MESH = f"""{FRAMES}, vertices AS MATERIALIZED (SELECT frame_id, frame_id*576+i*24+j AS vid, CAST(i + 1000*frame_id AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, ((31*i+17*j+frame_id) % 10)/100.0::DOUBLE AS z FROM frames, range(24) a(i), range(24) b(j)),
faces AS MATERIALIZED (SELECT 2*(o+i*24+j) AS fid, o+i*24+j AS i0, o+i*24+j+24 AS i1, o+i*24+j+1 AS i2 FROM (SELECT frame_id*576 AS o FROM frames), range(23) a(i), range(23) b(j)
 UNION ALL SELECT 2*(o+i*24+j)+1, o+i*24+j+1, o+i*24+j+24, o+i*24+j+25 FROM (SELECT frame_id*576 AS o FROM frames), range(23) a(i), range(23) b(j))"""
RELIEF = """rv AS MATERIALIZED (SELECT vec_id AS mesh_id, i AS vid, CAST(i // 8 AS DOUBLE) AS x, CAST(i % 8 AS DOUBLE) AS y, coalesce(CAST(embedding[i + 1] AS DOUBLE), 0) * 4 AS z FROM embeddings, range(64) t(i) WHERE len(embedding) = 64),
rf AS MATERIALIZED (SELECT mesh_id, 2*vid AS fid, vid AS i0, vid + 8 AS i1, vid + 1 AS i2 FROM rv WHERE vid < 56 AND vid % 8 < 7 UNION ALL SELECT mesh_id, 2*vid + 1, vid + 1, vid + 8, vid + 9 FROM rv WHERE vid < 56 AND vid % 8 < 7)"""
PIXELS = f"""{FRAMES}, pixels AS MATERIALIZED (SELECT frame_id, x, y, ((x*31 + y*17 + frame_id*7) % 101)/100.0::DOUBLE AS v FROM frames, range(48) b(x), range(32) c(y))"""
SEGMENTS = "segments AS (SELECT c_custkey // 30 AS segment, min(c_custkey) AS start_frame, max(c_custkey) AS end_frame FROM customer GROUP BY 1)"
