"""Small functions and selections: names, times, codes, losses, sampling and health."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import color as C
from voxelweave.functions import lens as L
from voxelweave.plans.registry import query
from voxelweave.sources import views as V


@query("frame_range_step", f"WITH {V.ARRIVALS}, r AS (SELECT min(frame_id) AS lo FROM arrivals) SELECT frame_id, count(*) AS arrivals FROM arrivals, r WHERE frame_id BETWEEN lo + 10 AND lo + 100 AND (frame_id - lo - 10) % 3 = 0 GROUP BY 1")
def frame_range_step(spark, d):
    a = V.arrivals(spark, d)
    lo = F.col("lo") + 10
    rows = a.crossJoin(F.broadcast(a.agg(F.min("frame_id").alias("lo"))))  # one row
    return rows.where(F.col("frame_id").between(lo, lo + 90) & ((F.col("frame_id") - lo) % 3 == 0)).groupBy("frame_id").agg(F.count("*").alias("arrivals"))


@query("ring_of_four", f"WITH {V.ARRIVALS} SELECT worker_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY timestamp_ms DESC, event_id DESC) AS k FROM arrivals) WHERE k <= 4")
def ring_of_four(spark, d):
    w = Window.partitionBy("worker_id").orderBy(F.desc("timestamp_ms"), F.desc("event_id"))
    return V.arrivals(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 4").select("worker_id", "event_id")


@query("nth_targets", f"WITH {V.CAMERAS} SELECT rig, camera_index FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY camera_index) - 1 AS k FROM cameras) WHERE k % 3 = 0 AND k < 6")
def nth_targets(spark, d):
    k = F.row_number().over(Window.partitionBy("rig").orderBy("camera_index")) - 1
    return V.cameras(spark, d).select("rig", "camera_index", k.alias("k")).where("k % 3 = 0 AND k < 6").select("rig", "camera_index")


@query("sample_k", "SELECT p_partkey FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey LIMIT 25")
def sample_k(spark, d):
    key = F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), F.lit("42")).cast("binary"))
    return V.table(spark, d, "part").orderBy(key, "p_partkey").limit(25).select("p_partkey")


@query("file_names", "SELECT s_suppkey, CAST(regexp_extract('cam_' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '.png', 'cam_(\\d+)', 1) AS INTEGER) AS camera_index, 'sequence_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS folder FROM supplier")
def file_names(spark, d):
    name = F.concat(F.lit("cam_"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit(".png"))
    return V.table(spark, d, "supplier").select("s_suppkey", F.regexp_extract(name, r"cam_(\d+)", 1).cast("int").alias("camera_index"), F.format_string("sequence_%06d", "s_suppkey").alias("folder"))


@query("intrinsics_scale", f"WITH {V.CAMERAS} SELECT rig, camera_index, round(1000.0::DOUBLE * 512 / (1920 - camera_index), 6) AS fx, round((960.0::DOUBLE - camera_index / 2.0::DOUBLE - rig % 3) * 512 / (1920 - camera_index), 6) AS cx FROM cameras")
def intrinsics_scale(spark, d):
    i = F.col("camera_index")
    k = V.cameras(spark, d).select("rig", "camera_index", F.lit(1000.0).alias("fx"), F.lit(1000.0).alias("fy"), (960.0 - i / 2).alias("cx"), F.lit(540.0).alias("cy"), (1920 - i).alias("width"), F.lit(1080).alias("height"))
    out = L.scaled_intrinsics(k, 512, 512, left=F.col("rig") % 3)
    return out.select("rig", "camera_index", F.round("fx", 6).alias("fx"), F.round("cx", 6).alias("cx"))


@query("undistorted", f"WITH {V.DEPTH}, n AS (SELECT frame_id, camera_index, x, y, (x-16.0::DOUBLE)/30 AS u, (y-12.0::DOUBLE)/30 AS v FROM depth), r AS (SELECT *, u*u+v*v AS q FROM n) SELECT frame_id, camera_index, x, y, round(30*(u*(1-0.1::DOUBLE*q+0.01::DOUBLE*q*q-0.001::DOUBLE*q*q*q) + 2*0.002::DOUBLE*u*v + 0.001::DOUBLE*(q+2*u*u)) + 16, 6) AS sx, round(30*(v*(1-0.1::DOUBLE*q+0.01::DOUBLE*q*q-0.001::DOUBLE*q*q*q) + 0.002::DOUBLE*(q+2*v*v) + 2*0.001::DOUBLE*u*v) + 12, 6) AS sy FROM r")
def undistorted(spark, d):
    lens = F.array(*[F.lit(k) for k in (-0.1, 0.01, 0.002, 0.001, -0.001)])
    p = L.distorted_places(V.depth(spark, d).select("frame_id", "camera_index", "x", "y"), 30.0, 30.0, 16.0, 12.0, lens)
    return p.select("frame_id", "camera_index", "x", "y", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("losses", f"WITH {V.SPLATS} SELECT frame_id, round(avg(abs(opacity - least(1, greatest(0, opacity)) )), 6) AS l1, round(avg(-(o*ln(o) + (1-o)*ln(1-o))), 6) AS entropy, round(avg(greatest(0, greatest(sx, sy, sz) - 1.1)), 6) AS scale_over FROM (SELECT *, least(1-1e-6, greatest(1e-6, opacity)) AS o FROM splats) GROUP BY 1")
def losses(spark, d):
    o = C.clamp(F.col("opacity"), 1e-6, 1 - 1e-6)
    return V.splats(spark, d).groupBy("frame_id").agg(
        F.round(F.avg(F.abs(F.col("opacity") - C.clamp(F.col("opacity")))), 6).alias("l1"),
        F.round(F.avg(-(o * F.log(o) + (1 - o) * F.log(1 - o))), 6).alias("entropy"),
        F.round(F.avg(F.greatest(F.lit(0.0), F.greatest("sx", "sy", "sz") - 1.1)), 6).alias("scale_over"),
    )


@query("time_codes", f"WITH {V.ARRIVALS} SELECT event_id, (timestamp_ms * 1000000) // 1000000 & 4294967295 AS ms, timestamp_ms * 30 // 1000 AS frame_at_30 FROM arrivals")
def time_codes(spark, d):
    return V.arrivals(spark, d).select("event_id", F.expr("(timestamp_ms * 1000000) div 1000000").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ms"), F.expr("timestamp_ms * 30 div 1000").alias("frame_at_30"))


@query("hex_codec", "SELECT n_nationkey, lower(hex(encode(n_name))) AS code, n_name AS back FROM nation")
def hex_codec(spark, d):
    code = F.lower(F.hex(F.col("n_name").cast("binary")))
    return V.table(spark, d, "nation").select("n_nationkey", code.alias("code"), F.unhex(code).cast("string").alias("back"))


@query("worker_health", f"WITH {V.ARRIVALS} SELECT worker_id, max(timestamp_ms) AS seen_ms, max(timestamp_ms) >= (SELECT max(timestamp_ms) FROM arrivals) - 5000 AS healthy FROM arrivals GROUP BY 1")
def worker_health(spark, d):
    a = V.arrivals(spark, d).groupBy("worker_id").agg(F.max("timestamp_ms").alias("seen_ms"))
    now = a.agg(F.max("seen_ms").alias("now"))
    return a.crossJoin(F.broadcast(now)).select("worker_id", "seen_ms", (F.col("seen_ms") >= F.col("now") - 5000).alias("healthy"))


_SAMPLES = "s AS (SELECT o_orderkey, o_custkey AS key, (o_orderkey % 10)/10.0::DOUBLE AS n, (o_orderkey % 7)/3.0::DOUBLE - 1 AS c, (o_orderkey % 13)/10.0::DOUBLE AS u, (o_orderkey % 11)/10.0::DOUBLE AS v, (o_orderkey % 17)/17.0::DOUBLE AS col FROM orders), w AS (SELECT *, n*greatest(c,0)*pow(least(1, greatest(0, n/0.26)), 2)*(3-2*least(1, greatest(0, n/0.26))) AS w FROM s)"


def _samples(spark, d):
    """Texture samples from orders: key, facing and viewing cosines, place in the image, colour."""
    i = F.col("o_orderkey")
    return V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), ((i % 10) / 10.0).alias("n_dot_c"), ((i % 7) / 3.0 - 1).alias("c_dot_v"), ((i % 13) / 10.0).alias("tex_u"), ((i % 11) / 10.0).alias("tex_v"), ((i % 17) / 17.0).alias("col"))


@query("view_weights", f"WITH {_SAMPLES} SELECT o_orderkey, round(w, 6) AS w FROM w")
def view_weights(spark, d):
    return _samples(spark, d).select("o_orderkey", F.round(C.view_weight(F.col("n_dot_c"), F.col("c_dot_v")), 6).alias("w"))


@query("view_dependent_blend", f"WITH {_SAMPLES} SELECT key, round(sum(w*col)/sum(w), 6) AS col, count(*) AS views FROM w WHERE w >= 0.01 AND u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 GROUP BY 1")
def view_dependent_blend(spark, d):
    from voxelweave.operators import render as R

    return R.view_blend(_samples(spark, d)).select("key", F.round("col", 6).alias("col"), "views")


@query("segment_lookup", f"WITH {V.SEGMENTS} SELECT o_orderkey, segment FROM orders JOIN segments ON o_custkey BETWEEN start_frame AND end_frame")
def segment_lookup(spark, d):
    from voxelweave.sources import readers

    wanted = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("frame"))
    return readers.segment_of(V.segments(spark, d), wanted).select("o_orderkey", "segment")


@query("color_correction", f"WITH {V.PIXELS} SELECT frame_id, x, y, round(0.9::DOUBLE*v + 0.1::DOUBLE*v*v, 6) AS r, round(0.05::DOUBLE*v + 0.95::DOUBLE*(1-v), 6) AS b FROM pixels")
def color_correction(spark, d):
    v = F.col("v")
    rgb = C.correct((v, v * v, 1 - v), [[0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [0.05, 0.0, 0.95]])
    return V.pixels(spark, d).select("frame_id", "x", "y", F.round(rgb[0], 6).alias("r"), F.round(rgb[2], 6).alias("b"))


@query("kept_checkpoints", "SELECT c_nationkey AS run, c_custkey AS step FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS b FROM customer) WHERE k <= 3 OR b = 1")
def kept_checkpoints(spark, d):
    from voxelweave.operators import report as P

    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("step"), F.col("c_acctbal").alias("loss"))
    return P.kept_checkpoints(c, 3).select("run", "step")


@query("epoch_losses", "SELECT c_nationkey AS run, c_custkey // 30 AS epoch, round(avg(c_acctbal), 6) AS loss, count(*) AS steps FROM customer GROUP BY 1, 2")
def epoch_losses(spark, d):
    from voxelweave.operators import report as P

    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), F.expr("c_custkey div 30").alias("epoch"), F.col("c_acctbal").cast("double").alias("loss"))
    return P.epoch_losses(c).withColumn("loss", F.round("loss", 6))


@query("harness_summary", f"WITH {V.ARRIVALS}, f AS (SELECT frame_id, count(*) AS splats, max(timestamp_ms) - min(timestamp_ms) AS ms FROM arrivals GROUP BY 1) SELECT count(*) AS frames, round(avg(splats), 4) AS mean_splats, round(avg(ms), 4) AS mean_ms, round(1000 / avg(ms), 4) AS fps FROM f")
def harness_summary(spark, d):
    from voxelweave.operators import report as P

    f = V.arrivals(spark, d).groupBy("frame_id").agg(F.count("*").alias("splats"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("ms"))
    return P.harness_summary(f).select("frames", *[F.round(c, 4).alias(c) for c in ("mean_splats", "mean_ms", "fps")])
