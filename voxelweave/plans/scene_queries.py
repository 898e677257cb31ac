"""Camera, depth, volume and mesh queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.functions import color as C
from voxelweave.functions import geometry as G
from voxelweave.operators import camera as K
from voxelweave.operators import fusion as U
from voxelweave.operators import mesh as M
from voxelweave.plans.registry import query
from voxelweave.sources import views as V

r6 = lambda c: F.round(c, 6)


_DIR = f"{V.CAMERAS}, d AS (SELECT rig, camera_index, -x/sqrt(x*x+y*y+z*z) AS dx, -y/sqrt(x*x+y*y+z*z) AS dy, -z/sqrt(x*x+y*y+z*z) AS dz, x, y, z, valid FROM cameras), g AS (SELECT a.rig, a.camera_index AS a, b.camera_index AS b, acos(greatest(-1, least(1, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz))) AS angle FROM d a JOIN d b ON a.rig = b.rig AND a.camera_index <> b.camera_index)"


@query("camera_angles", f"WITH {_DIR} SELECT rig, a, b, round(angle, 6) AS angle FROM g")
def camera_angles(spark, d):
    return K.angles(V.cameras(spark, d)).select("rig", "a", "b", r6("angle").alias("angle"))


@query("isolation_weights", f"WITH {_DIR}, m AS (SELECT rig, a, min(angle) AS w FROM g GROUP BY 1, 2) SELECT rig, a AS camera_index, round(w / sum(w) OVER (PARTITION BY rig), 6) AS weight FROM m")
def isolation_weights(spark, d):
    return K.isolation_weights(V.cameras(spark, d)).select("rig", "camera_index", r6("weight").alias("weight"))


@query("valid_cameras", f"WITH {V.CAMERAS} SELECT rig, count(*) AS cameras, count(*) FILTER (valid) AS valid FROM cameras GROUP BY 1")
def valid_cameras(spark, d):
    return K.valid_counts(V.cameras(spark, d))


@query("stereo_pairs_adjacent", f"WITH {V.CAMERAS} SELECT rig, camera_index // 2 AS pair, min(camera_index) AS \"left\", max(camera_index) AS \"right\" FROM cameras GROUP BY 1, 2")
def stereo_pairs_adjacent(spark, d):
    return K.adjacent_pairs(V.cameras(spark, d))


@query("stereo_pairs_baseline", f"WITH {_DIR}, p AS (SELECT a.rig, a.camera_index AS a, b.camera_index AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS baseline FROM d a JOIN d b ON a.rig = b.rig AND a.camera_index < b.camera_index) SELECT rig, a, b, round(baseline, 6) AS baseline, round(angle, 6) AS angle FROM p JOIN g USING (rig, a, b) WHERE baseline BETWEEN 2 AND 4.5")
def stereo_pairs_baseline(spark, d):
    p = K.baseline_pairs(V.cameras(spark, d), 2.0, 4.5)
    return p.select("rig", "a", "b", r6("baseline").alias("baseline"), r6("angle").alias("angle"))


@query("route_interleaved", f"WITH {V.CAMERAS} SELECT rig, camera_index, camera_index % 3 AS worker FROM cameras")
def route_interleaved(spark, d):
    return K.route(V.cameras(spark, d), 3, "interleaved")


@query("route_geographic", f"WITH {V.CAMERAS} SELECT rig, camera_index, ntile(3) OVER (PARTITION BY rig ORDER BY camera_index) - 1 AS worker FROM cameras")
def route_geographic(spark, d):
    return K.route(V.cameras(spark, d), 3, "geographic")


@query("route_redundant", f"WITH {V.CAMERAS} SELECT rig, camera_index, w AS worker FROM cameras, range(3) t(w)")
def route_redundant(spark, d):
    return K.route(V.cameras(spark, d), 3, "redundant")


def _spread_sql(k: int) -> str:
    """The greedy rule, a step at a time: the seed is nearest to the viewer's direction, each next camera has the largest least angle."""
    out = f"{_DIR}, v AS (SELECT * FROM d WHERE valid), p0 AS (SELECT rig, camera_index, 0::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY round(acos(greatest(-1, least(1, -dx))), 9), camera_index) AS r FROM v) WHERE r = 1)"
    for n in range(1, k):
        out += f""", m{n} AS (SELECT v.rig, v.camera_index, min(g.angle) AS least FROM v JOIN g ON g.rig = v.rig AND g.a = v.camera_index JOIN p{n - 1} p ON p.rig = v.rig AND p.camera_index = g.b
 WHERE NOT EXISTS (SELECT 1 FROM p{n - 1} q WHERE q.rig = v.rig AND q.camera_index = v.camera_index) GROUP BY 1, 2),
p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT rig, camera_index, {n}::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY round(least, 9) DESC, camera_index) AS r FROM m{n}) WHERE r = 1)"""
    return f"WITH {out} SELECT rig, camera_index, nth FROM p{k - 1}"


@query("fps_select_k", _spread_sql(4))
def fps_select_k(spark, d):
    return K.select_spread(V.cameras(spark, d), 4, viewer=(3.0, 0.0, 0.0))


def _views_sql(k: int) -> str:
    """For each target its nearest camera, then a step at a time the one with the largest least angle to those chosen. Rigs have 8 cameras."""
    out = f"""{V.CAMERAS}, n AS (SELECT *, sqrt(x*x+y*y+z*z) + 1e-8 AS r FROM cameras), g AS MATERIALIZED (SELECT a.rig, a.camera_index AS a, b.camera_index AS b, round(acos(greatest(-1, least(1, a.x/a.r*b.x/b.r + a.y/a.r*b.y/b.r + a.z/a.r*b.z/b.r))), 9) AS angle, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS far FROM n a JOIN n b ON a.rig = b.rig AND a.camera_index <> b.camera_index),
w0 AS (SELECT rig, a AS target, b AS source, 0::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY rig, a ORDER BY far, b) AS k FROM g) WHERE k = 1)"""
    for n in range(1, k):
        out += f""", l{n} AS (SELECT w.rig, w.target, c.camera_index AS source, min(g.angle) AS least FROM w{n - 1} w JOIN cameras c ON c.rig = w.rig AND c.camera_index <> w.target JOIN g ON g.rig = w.rig AND g.a = c.camera_index AND g.b = w.source
 WHERE NOT EXISTS (SELECT 1 FROM w{n - 1} q WHERE q.rig = w.rig AND q.target = w.target AND q.source = c.camera_index) GROUP BY 1, 2, 3),
w{n} AS MATERIALIZED (SELECT * FROM w{n - 1} UNION ALL SELECT rig, target, source, {n}::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY rig, target ORDER BY least DESC, source) AS k FROM l{n}) WHERE k = 1)"""
    return f"{out}, s AS (SELECT * FROM w{k - 1})"


_NEAR = _views_sql(3)


@query("source_views", f"WITH {_NEAR} SELECT * FROM s WHERE nth < 3")
def source_views(spark, d):
    return K.source_views(V.cameras(spark, d), 3)


_SAMPLES = _NEAR + """, f AS (SELECT rig, n AS frame_id, camera_index FROM cameras, range(5) t(n) WHERE (rig + n + camera_index) % 6 <> 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rig, frame_id ORDER BY camera_index) - 1 AS k FROM f) WHERE k % 2 = 0),
o AS (SELECT t.rig, t.frame_id, t.camera_index AS target, s.nth, s.source FROM t JOIN s ON s.rig = t.rig AND s.target = t.camera_index AND s.nth < 3 JOIN f ON f.rig = t.rig AND f.frame_id = t.frame_id AND f.camera_index = s.source)"""


def _training(spark, d):
    """Five frames of each rig, of which some cameras are missing."""
    f = V.cameras(spark, d).select("rig", "camera_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("frame_id")).where("(rig + frame_id + camera_index) % 6 <> 0")
    return K.training_samples(f, K.source_views(V.cameras(spark, d), 3), every=2)


@query("training_samples", f"WITH {_SAMPLES} SELECT rig, frame_id, target, string_agg(source::VARCHAR, ',' ORDER BY nth) AS sources FROM o GROUP BY 1, 2, 3")
def training_samples(spark, d):
    return _training(spark, d).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@query("split_stats", f"WITH {_SAMPLES}, u AS (SELECT DISTINCT frame_id, target, CASE WHEN frame_id < 4 THEN 'train' ELSE 'val' END AS split, rig FROM o), c AS (SELECT split, count(*) AS samples, count(DISTINCT frame_id) AS frames, count(DISTINCT target) AS targets FROM u GROUP BY 1) SELECT *, round(samples / sum(samples) OVER (), 6) AS share FROM c")
def split_stats(spark, d):
    s = _training(spark, d).withColumn("split", F.when(F.col("frame_id") < 4, "train").otherwise("val"))
    return K.split_counts(s).withColumn("share", r6("share"))


@query("set_common_cameras", f"WITH {V.CAMERAS} SELECT DISTINCT worker_id AS camera_index FROM (SELECT user_id % 4 AS worker_id FROM events) WHERE worker_id IN (SELECT camera_index FROM cameras)")
def set_common_cameras(spark, d):
    return V.arrivals(spark, d).select(F.col("worker_id").alias("camera_index")).intersect(V.cameras(spark, d).select("camera_index"))


@query("set_minus_target", f"WITH {V.CAMERAS} SELECT rig, camera_index FROM cameras WHERE camera_index <> 3")
def set_minus_target(spark, d):
    c = V.cameras(spark, d).select("rig", "camera_index")
    return c.exceptAll(c.where("camera_index = 3"))


_POINTS = f"""{V.DEPTH}, pts AS MATERIALIZED (SELECT frame_id, camera_index, x, y, co*(qx-tx) - si*(depth-tz) AS wx, qy AS wy, si*(qx-tx) + co*(depth-tz) AS wz
 FROM (SELECT *, (x-16.0::DOUBLE)/30*depth AS qx, (y-12.0::DOUBLE)/30*depth AS qy FROM depth JOIN rig ON c = camera_index WHERE alpha >= 128 AND depth BETWEEN 1.52 AND 1.58))"""
_SEEN = """seen AS MATERIALIZED (SELECT *, CAST(round_even(zx/zz*30+16, 0) AS BIGINT) AS px, CAST(round_even(wy/zz*30+12, 0) AS BIGINT) AS py FROM (SELECT p.*, r.c, r.co, r.si, r.tx, r.tz, r.co*wx + r.si*wz + r.tx AS zx, -r.si*wx + r.co*wz + r.tz AS zz FROM {pts} p JOIN rig r ON {on}) WHERE zz > 0)"""
_AGREE = _POINTS + ", " + _SEEN.format(pts="pts", on="p.camera_index <> r.c") + """,
agree AS (SELECT s.frame_id, s.camera_index, s.x, s.y, count(*) AS n FROM seen s JOIN depth d ON d.frame_id = s.frame_id AND d.camera_index = s.c AND d.x = s.px AND d.y = s.py WHERE d.alpha >= 128 AND abs(s.zz - d.depth) < 0.015 GROUP BY 1, 2, 3, 4),
v AS (SELECT p.*, 1 + coalesce(n, 0) AS views FROM pts p LEFT JOIN agree USING (frame_id, camera_index, x, y))"""
LENS = (30.0, 30.0, 16.0, 12.0)


@query("unproject", f"WITH {_POINTS} SELECT frame_id, camera_index, x, y, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz FROM pts")
def unproject(spark, d):
    p = U.unproject(V.depth(spark, d), V.depth_rig(spark, d), 1.52, 1.58)
    return p.select("frame_id", "camera_index", "x", "y", *[r6(c).alias(c) for c in ("wx", "wy", "wz")])


@query("camera_positions", f"WITH {V.DEPTH} SELECT frame_id, c AS camera_index, round(-(co*tx - si*tz), 9) AS x, 0.0::DOUBLE AS y, round(-(si*tx + co*tz), 9) AS z FROM frames, rig")
def camera_positions(spark, d):
    p = G.camera_position(F.col("rotation"), F.col("translation"))
    return V.depth_rig(spark, d).select("frame_id", "camera_index", *[F.round(c, 9).alias(k) if k != "y" else F.abs(F.round(c, 9)).alias(k) for c, k in zip(p, "xyz", strict=True)])


@query("consistency_count", f"WITH {_AGREE} SELECT camera_index, views, count(*) AS points FROM v GROUP BY 1, 2")
def consistency_count(spark, d):
    z = V.depth(spark, d, together=V.TOGETHER)
    return U.consistency(U.unproject(z, V.depth_rig(spark, d, together=V.TOGETHER), 1.52, 1.58), z, V.depth_rig(spark, d, together=V.TOGETHER), 0.015).groupBy("camera_index", "views").agg(F.count("*").alias("points"))


@query("fused_points", f"WITH {_AGREE} SELECT frame_id, camera_index, x, y, round(wx, 6) AS wx, views FROM v WHERE views >= 2")
def fused_points(spark, d):
    return U.fuse(V.depth(spark, d, together=V.TOGETHER), V.depth_rig(spark, d, together=V.TOGETHER), 1.52, 1.58, 0.015, 2).select("frame_id", "camera_index", "x", "y", r6("wx").alias("wx"), "views")


_NORMALS = """nb AS MATERIALIZED (SELECT *, lead(depth) OVER r AS r, lag(depth) OVER r AS l, lead(depth) OVER c AS w, lag(depth) OVER c AS u FROM depth
 WINDOW r AS (PARTITION BY frame_id, camera_index, y ORDER BY x), c AS (PARTITION BY frame_id, camera_index, x ORDER BY y)),
nv AS (SELECT frame_id, camera_index, x, y, (x-16.0::DOUBLE)/30*w-(x-16.0::DOUBLE)/30*u AS ax, (y+1-12.0::DOUBLE)/30*w-(y-1-12.0::DOUBLE)/30*u AS ay, w-u AS az, (x+1-16.0::DOUBLE)/30*r-(x-1-16.0::DOUBLE)/30*l AS bx, (y-12.0::DOUBLE)/30*r-(y-12.0::DOUBLE)/30*l AS by_, r-l AS bz FROM nb),
nc AS (SELECT frame_id, camera_index, x, y, ay*bz-az*by_ AS nx, az*bx-ax*bz AS ny, ax*by_-ay*bx AS nz FROM nv),
normals AS MATERIALIZED (SELECT frame_id, camera_index, x, y, coalesce(nx/sqrt(nx*nx+ny*ny+nz*nz), 0) AS nx, coalesce(ny/sqrt(nx*nx+ny*ny+nz*nz), 0) AS ny, coalesce(nz/sqrt(nx*nx+ny*ny+nz*nz), -1) AS nz FROM nc)"""


@query("depth_normals", f"WITH {V.DEPTH}, {_NORMALS} SELECT frame_id, camera_index, x, y, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz FROM normals")
def depth_normals(spark, d):
    n = U.depth_normals(V.depth(spark, d), *LENS)
    return n.select("frame_id", "camera_index", "x", "y", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query(
    "fused_by_angle",
    f"""WITH {_POINTS}, {_NORMALS}, pn AS MATERIALIZED (SELECT p.*, co*nx - si*nz AS nx, ny, si*nx + co*nz AS nz FROM pts p JOIN normals USING (frame_id, camera_index, x, y) JOIN rig ON c = camera_index),
{_SEEN.format(pts="pn", on="p.camera_index <> r.c")}, way AS (SELECT *, -(co*tx - si*tz) - wx AS vx, -wy AS vy, -(si*tx + co*tz) - wz AS vz FROM seen),
agree AS (SELECT s.frame_id, s.camera_index, s.x, s.y, count(*) AS n FROM way s JOIN depth d ON d.frame_id = s.frame_id AND d.camera_index = s.c AND d.x = s.px AND d.y = s.py
 WHERE d.alpha >= 128 AND abs(s.zz - d.depth) < 0.015 AND (nx*vx + ny*vy + nz*vz)/sqrt(vx*vx+vy*vy+vz*vz) >= 0.7 GROUP BY 1, 2, 3, 4)
SELECT frame_id, camera_index, x, y, 1 + n AS views FROM agree""",
)
def fused_by_angle(spark, d):
    return U.fuse(V.depth(spark, d, together=V.TOGETHER), V.depth_rig(spark, d, together=V.TOGETHER), 1.52, 1.58, 0.015, 2, least_cos=0.7, lens=LENS).select("frame_id", "camera_index", "x", "y", "views")


@query(
    "reproject_depth",
    f"""WITH {V.DEPTH}, p AS (SELECT frame_id, camera_index, CAST(round_even(((x-16.0::DOUBLE)/30*depth - 0.05)/(depth-0.02)*30+16, 0) AS BIGINT) AS px, CAST(round_even(((y-12.0::DOUBLE)/30*depth - 0)/(depth-0.02)*30+12, 0) AS BIGINT) AS py, depth - 0.02 AS z, (x*7+y*3) % 10 AS conf FROM depth),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, camera_index, px, py ORDER BY conf DESC, z) AS n FROM p WHERE px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 23 AND conf >= 3)
SELECT frame_id, camera_index, px, py, round(z, 6) AS depth, conf AS confidence FROM k WHERE n = 1""",
)
def reproject_depth(spark, d):
    c = V.depth(spark, d).withColumn("confidence", (F.col("x") * 7 + F.col("y") * 3) % 10)
    out = U.reproject(c, (0.05, 0.0, 0.02), *LENS, 32, 24, threshold=3)
    return out.select("frame_id", "camera_index", "px", "py", r6("depth").alias("depth"), "confidence")


_HIT = f"""{V.DEPTH}, {V.VOXELS}, {_SEEN.format(pts="voxels", on="true")}, h AS MATERIALIZED (SELECT s.voxel_id, s.c, least(1, (d.depth - zz)/0.1) AS t, zz / sqrt(zx*zx + wy*wy + zz*zz) AS ray, floor(d.grey * 255) AS v FROM seen s JOIN depth d ON d.frame_id = s.frame_id AND d.camera_index = s.c AND d.x = s.px AND d.y = s.py WHERE d.alpha >= 128 AND d.depth - zz >= -0.1)"""


@query("tsdf_voxels", f"WITH {_HIT} SELECT voxel_id, round(avg(t), 6) AS tsdf, CAST(count(*) AS DOUBLE) AS weight FROM h GROUP BY 1")
def tsdf_voxels(spark, d):
    return U.tsdf(V.voxels(spark, d, together=V.TOGETHER), V.depth(spark, d, together=V.TOGETHER), V.depth_rig(spark, d, together=V.TOGETHER), 0.1).select("voxel_id", r6("tsdf").alias("tsdf"), "weight")


@query("tsdf_by_angle", f"WITH {_HIT} SELECT voxel_id, round(sum(t * greatest(0.1, ray)) / sum(greatest(0.1, ray)), 6) AS tsdf, round(sum(greatest(0.1, ray)), 6) AS weight FROM h GROUP BY 1")
def tsdf_by_angle(spark, d):
    return U.tsdf(V.voxels(spark, d, together=V.TOGETHER), V.depth(spark, d, together=V.TOGETHER), V.depth_rig(spark, d, together=V.TOGETHER), 0.1, by_angle=True).select("voxel_id", r6("tsdf").alias("tsdf"), r6("weight").alias("weight"))


@query(
    "tsdf_color",
    f"""WITH {_HIT}, l AS (SELECT voxel_id, list(v ORDER BY c) AS vs FROM h GROUP BY 1), a AS (SELECT *, vs[1] AS c1 FROM l), b AS (SELECT *, CASE WHEN len(vs) > 1 THEN floor(c1 * (1 - 1/2::DOUBLE) + vs[2] * (1/2::DOUBLE)) ELSE c1 END AS c2 FROM a)
SELECT voxel_id, CASE WHEN len(vs) > 2 THEN floor(c2 * (1 - 1/3::DOUBLE) + vs[3] * (1/3::DOUBLE)) ELSE c2 END AS color FROM b""",
)
def tsdf_color(spark, d):
    z = V.depth(spark, d, together=V.TOGETHER).withColumn("value", F.floor(F.col("grey") * 255))
    return U.tsdf(V.voxels(spark, d, together=V.TOGETHER), z, V.depth_rig(spark, d, together=V.TOGETHER), 0.1, color="value").select("voxel_id", "color")


@query(
    "zero_crossings",
    f"""WITH {V.SDF}, g AS MATERIALIZED (SELECT *, (vx*1000 + vy)*1000 + vz AS key FROM sdf_grid), st AS (SELECT g.*, axis, key + step AS next FROM g, (VALUES ('x', 1000000), ('y', 1000), ('z', 1)) s(axis, step)),
c AS (SELECT a.vx, a.vy, a.vz, a.axis, a.sdf AS s0, b.sdf AS s1 FROM st a JOIN g b ON b.key = a.next)
SELECT vx, vy, vz, axis, round(least(1, greatest(0, -s0/(s1-s0))), 6) AS t FROM c WHERE (s0 < 0) <> (s1 < 0)""",
)
def zero_crossings(spark, d):
    return U.crossings(V.sdf_grid(spark, d)).withColumn("t", r6("t"))


@query(
    "surface_points",
    f"""WITH {V.SDF}, o AS (SELECT * FROM sdf_grid WHERE weight >= 1), c AS (SELECT a.vx, a.vy, a.vz, s.axis, a.sdf AS s0, b.sdf AS s1 FROM o a, (VALUES ('x',1,0,0),('y',0,1,0),('z',0,0,1)) s(axis,i,j,k), o b WHERE b.vx=a.vx+s.i AND b.vy=a.vy+s.j AND b.vz=a.vz+s.k AND abs(a.sdf) <= 0.2),
g AS (SELECT c.*, coalesce(xb.sdf - xa.sdf, 0) AS gx, coalesce(yb.sdf - ya.sdf, 0) AS gy, coalesce(zb.sdf - za.sdf, 0) AS gz FROM c LEFT JOIN sdf_grid xa ON xa.vx=c.vx-1 AND xa.vy=c.vy AND xa.vz=c.vz LEFT JOIN sdf_grid xb ON xb.vx=c.vx+1 AND xb.vy=c.vy AND xb.vz=c.vz
 LEFT JOIN sdf_grid ya ON ya.vx=c.vx AND ya.vy=c.vy-1 AND ya.vz=c.vz LEFT JOIN sdf_grid yb ON yb.vx=c.vx AND yb.vy=c.vy+1 AND yb.vz=c.vz LEFT JOIN sdf_grid za ON za.vx=c.vx AND za.vy=c.vy AND za.vz=c.vz-1 LEFT JOIN sdf_grid zb ON zb.vx=c.vx AND zb.vy=c.vy AND zb.vz=c.vz+1 WHERE (s0 < 0) <> (s1 < 0))
SELECT vx, vy, vz, axis, round(least(1, greatest(0, -s0/(s1-s0))), 6) AS t, round(gx/sqrt(gx*gx+gy*gy+gz*gz), 6) AS nx, round(gy/sqrt(gx*gx+gy*gy+gz*gz), 6) AS ny, round(gz/sqrt(gx*gx+gy*gy+gz*gz), 6) AS nz FROM g""",
)
def surface_points(spark, d):
    p = U.surface_points(V.sdf_grid(spark, d), far=0.2)
    return p.select("vx", "vy", "vz", "axis", *[r6(c).alias(c) for c in ("t", "nx", "ny", "nz")])


@query(
    "cube_case_hist",
    f"""WITH {V.SDF}, o AS (SELECT * FROM (VALUES (0,0,0,0),(1,1,0,0),(2,1,1,0),(3,0,1,0),(4,0,0,1),(5,1,0,1),(6,1,1,1),(7,0,1,1)) t(c,i,j,k)),
m AS (SELECT g.vx-i AS x, g.vy-j AS y, g.vz-k AS z, count(*) AS n, bit_or(CASE WHEN sdf < 0 THEN 1 << c ELSE 0 END) AS mask FROM sdf_grid g, o GROUP BY 1, 2, 3)
SELECT CAST(mask AS INTEGER) AS mask, count(*) AS cells FROM m WHERE n = 8 GROUP BY 1""",
)
def cube_case_hist(spark, d):
    return U.cases(V.sdf_grid(spark, d)).groupBy("mask").agg(F.count("*").alias("cells"))


@query("observed_cubes", f"WITH {V.SDF}, k AS (SELECT vx-i AS x, vy-j AS y, vz-l AS z FROM sdf_grid, range(2) a(i), range(2) b(j), range(2) c(l) WHERE weight >= 1) SELECT x AS vx, y AS vy, z AS vz FROM k GROUP BY 1, 2, 3 HAVING count(*) = 8")
def observed_cubes(spark, d):
    return U.cases(U.observed(V.sdf_grid(spark, d))).select("vx", "vy", "vz")


def _cubes_sql() -> str:
    """Marching cubes: the mask of each cell, its triangles' edges by case, and the place on each edge. Both lists come from the rule and the
    numbering that the engine has; what is checked is how they are used."""
    cases = ", ".join(f"({m}, {n}, {a}, {b}, {c})" for m, ts in U.case_table() for n, (a, b, c) in enumerate(ts))
    edges = ", ".join(f"({e}, {a + 1}, {b + 1}, {', '.join(map(str, (*U.CORNERS[a], *U.CORNERS[b])))})" for e, (a, b) in enumerate(U.EDGES))
    corners = ", ".join(f"({c}, {i}, {j}, {k})" for c, (i, j, k) in enumerate(U.CORNERS))
    place = ", ".join(f"round(vx + x{k}.ax + t{k}*(x{k}.bx - x{k}.ax), 6) AS p{k}x, round(vy + x{k}.ay + t{k}*(x{k}.by_ - x{k}.ay), 6) AS p{k}y, round(vz + x{k}.az + t{k}*(x{k}.bz - x{k}.az), 6) AS p{k}z" for k in range(3))
    along = ", ".join(f"least(1, greatest(0, -ds[x{k}.a]/(ds[x{k}.b]-ds[x{k}.a]))) AS t{k}" for k in range(3))
    return f"""WITH {V.SDF}, co(c, i, j, k) AS (VALUES {corners}), ca(mask, nth, e0, e1, e2) AS (VALUES {cases}), eg(e, a, b, ax, ay, az, bx, by_, bz) AS (VALUES {edges}),
m AS (SELECT g.vx-i AS vx, g.vy-j AS vy, g.vz-k AS vz, count(*) AS n, list(sdf ORDER BY c) AS ds, bit_or(CASE WHEN sdf < 0 THEN 1 << c ELSE 0 END) AS mask FROM sdf_grid g, co GROUP BY 1, 2, 3),
t AS (SELECT m.*, nth, e0, e1, e2 FROM m JOIN ca USING (mask) WHERE n = 8), f AS (SELECT t.*, x0, x1, x2, {along} FROM t JOIN eg x0 ON x0.e = e0 JOIN eg x1 ON x1.e = e1 JOIN eg x2 ON x2.e = e2)
SELECT vx, vy, vz, CAST(nth AS INTEGER) AS nth, {place} FROM f"""


@query("marching_cubes_tris", _cubes_sql())
def marching_cubes_tris(spark, d):
    out = U.marching_cubes(V.sdf_grid(spark, d))
    return out.select("vx", "vy", "vz", "nth", *[r6(f"p{k}{v}").alias(f"p{k}{v}") for k in range(3) for v in "xyz"])


def _mesh(spark, d):
    return V.height_field(spark, d)


_CORNERS = f"{V.MESH}, t AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN vertices a ON a.vid=i0 JOIN vertices b ON b.vid=i1 JOIN vertices c ON c.vid=i2), n AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM t)"


@query("vertex_normals", f"WITH {_CORNERS}, e AS (SELECT unnest([i0,i1,i2]) AS vid, nx, ny, nz FROM n), s AS (SELECT vid, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM e GROUP BY 1) SELECT vid, round(x/sqrt(x*x+y*y+z*z),6) AS nx, round(y/sqrt(x*x+y*y+z*z),6) AS ny, round(z/sqrt(x*x+y*y+z*z),6) AS nz FROM s")
def vertex_normals(spark, d):
    v, f = _mesh(spark, d)
    return M.vertex_normals(f, v).select("vid", *[r6(c).alias(c) for c in ("nx", "ny", "nz")])


def _damaged(f):
    """Every tenth face repeats a corner; every tenth after it has three corners in a row, so no area."""
    kind = F.col("fid") % 10
    return f.select("fid", F.when(kind == 1, F.col("i0") - 24).otherwise(F.col("i0")).alias("i0"), F.when(kind == 0, F.col("i0")).when(kind == 1, F.col("i0")).otherwise(F.col("i1")).alias("i1"), F.when(kind == 1, F.col("i0") + 24).otherwise(F.col("i2")).alias("i2")).where("i0 >= 0")


_BAD = f"{V.MESH}, bad AS MATERIALIZED (SELECT * FROM (SELECT fid, CASE WHEN fid % 10 = 1 THEN i0 - 24 ELSE i0 END AS i0, CASE WHEN fid % 10 <= 1 THEN i0 ELSE i1 END AS i1, CASE WHEN fid % 10 = 1 THEN i0 + 24 ELSE i2 END AS i2 FROM faces) WHERE i0 >= 0)"
_AREA = """bt AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM bad f JOIN vertices a ON a.vid=i0 JOIN vertices b ON b.vid=i1 JOIN vertices c ON c.vid=i2),
bn AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM bt), deg AS MATERIALIZED (SELECT fid FROM bn WHERE i0 = i1 OR i1 = i2 OR i0 = i2 OR sqrt(nx*nx+ny*ny+nz*nz) < 1e-12)"""


@query("degenerate_faces", f"WITH {_BAD}, {_AREA} SELECT fid FROM deg")
def degenerate_faces(spark, d):
    v, f = _mesh(spark, d)
    return M.degenerate(_damaged(f), v)


@query(
    "planar_unwrap",
    f"""WITH {_CORNERS}, a AS (SELECT *, CASE WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN 0 WHEN abs(ny) >= abs(nz) THEN 1 ELSE 2 END AS axis FROM n),
h AS (SELECT *, 2*axis + CASE WHEN (CASE axis WHEN 0 THEN nx WHEN 1 THEN ny ELSE nz END) < 0 THEN 1 ELSE 0 END AS chart FROM a),
k AS (SELECT fid, chart, 0 AS corner, i0 AS vid, CASE WHEN axis = 0 THEN ay ELSE ax END AS a, CASE WHEN axis = 2 THEN ay ELSE az END AS b FROM h UNION ALL SELECT fid, chart, 1, i1, CASE WHEN axis = 0 THEN by_ ELSE bx END, CASE WHEN axis = 2 THEN by_ ELSE bz END FROM h
 UNION ALL SELECT fid, chart, 2, i2, CASE WHEN axis = 0 THEN cy ELSE cx END, CASE WHEN axis = 2 THEN cy ELSE cz END FROM h), x AS (SELECT chart, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM k GROUP BY 1)
SELECT fid, CAST(corner AS INTEGER) AS corner, vid, CAST(k.chart AS INTEGER) AS chart, round((k.chart // 2 + 0.01 + 0.98::DOUBLE*(a-la)/CASE WHEN ha > la THEN ha-la ELSE 1 END)/3, 6) AS u, round((k.chart % 2 + 0.01 + 0.98::DOUBLE*(b-lb)/CASE WHEN hb > lb THEN hb-lb ELSE 1 END)/2, 6) AS v FROM k JOIN x USING (chart)""",
)
def planar_unwrap(spark, d):
    v, f = _mesh(spark, d)
    return M.unwrap(f, v).withColumns({"u": r6("u"), "v": r6("v")})


@query("face_prefix", f"WITH {V.MESH} SELECT fid, CAST(coalesce(sum(CASE WHEN fid % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM faces")
def face_prefix(spark, d):
    _, f = _mesh(spark, d)
    kept = f.select("fid", (F.col("fid") % 3 == 0).cast("int").alias("kept"))
    return M.prefix_sum(kept, "fid", "kept", "place").select("fid", F.col("place").cast("long").alias("place"))


@query("flat_round_trip", f"WITH {V.MESH} SELECT frame_id AS mesh_id, 1728::BIGINT AS positions, 3174::BIGINT AS indices, round(sum(x + 2*y + 3*z), 4) AS places FROM vertices GROUP BY 1")
def flat_round_trip(spark, d):
    v, f = _mesh(spark, d)
    flat = M.to_flat(f.select(F.expr("fid div 1152").alias("mesh_id"), "fid", *[F.expr(f"i{k} % 576").alias(f"i{k}") for k in range(3)]), v.select(F.col("frame_id").alias("mesh_id"), F.expr("vid % 576").alias("vid"), "x", "y", "z"))
    back, faces = M.from_flat(flat)
    sums = back.groupBy("mesh_id").agg((3 * F.count("*")).alias("positions"), F.round(F.sum(F.col("x") + 2 * F.col("y") + 3 * F.col("z")), 4).alias("places"))
    return sums.join(faces.groupBy("mesh_id").agg((3 * F.count("*")).alias("indices")), "mesh_id")


@query("mesh_validity", f"WITH {V.MESH}, kept AS (SELECT vid FROM vertices WHERE vid % 97 <> 5), s AS (SELECT (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM kept) AS vertices, (SELECT count(*) FROM (SELECT unnest([i0,i1,i2]) AS v FROM faces) WHERE v NOT IN (SELECT vid FROM kept)) AS dangling) SELECT *, faces > 0 AND vertices > 0 AND dangling = 0 AS valid FROM s")
def mesh_validity(spark, d):
    v, f = _mesh(spark, d)
    return M.validity(f, v.where("vid % 97 <> 5").select("vid"))


@query("vertex_compaction", f"WITH {V.MESH}, c AS (SELECT fid, 0 AS k, i0 AS vid FROM faces UNION ALL SELECT fid, 1, i1 FROM faces UNION ALL SELECT fid, 2, i2 FROM faces), m AS (SELECT vid, min(fid*3+k) AS f FROM c GROUP BY 1) SELECT vid, row_number() OVER (ORDER BY f) - 1 AS new_id FROM m")
def vertex_compaction(spark, d):
    return M.compaction(_mesh(spark, d)[1])


@query("mesh_stats", f"WITH {_CORNERS} SELECT count(*) AS faces, round(sum(sqrt(nx*nx+ny*ny+nz*nz))/2, 6) AS area FROM n")
def mesh_stats(spark, d):
    v, f = _mesh(spark, d)
    n = G.length(M._normal())
    return M.with_corners(f, v).agg(F.count("*").alias("faces"), F.round(F.sum(n) / 2, 6).alias("area"))


_CLUSTER = "cc AS (SELECT *, CAST(floor(x/3) AS BIGINT) AS gx, CAST(floor(y/3) AS BIGINT) AS gy, CAST(floor(z/3) AS BIGINT) AS gz FROM vertices), r AS MATERIALIZED (SELECT vid, min(vid) OVER (PARTITION BY gx, gy, gz) AS new_id FROM cc)"
_SIMPLE = """s0 AS MATERIALIZED (SELECT fid, new_id AS i0, i1, i2 FROM {faces} JOIN r ON vid = i0), s1 AS MATERIALIZED (SELECT fid, i0, new_id AS i1, i2 FROM s0 JOIN r ON vid = i1), s2 AS MATERIALIZED (SELECT fid, i0, i1, new_id AS i2 FROM s1 JOIN r ON vid = i2),
simple AS MATERIALIZED (SELECT * FROM s2 WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2)"""


@query(
    "mesh_pipeline",
    f"""WITH {_BAD}, {_AREA}, good AS MATERIALIZED (SELECT * FROM bad WHERE fid NOT IN (SELECT fid FROM deg)), {_CLUSTER}, {_SIMPLE.format(faces='good')},
s AS (SELECT 0 AS nth, 'input' AS stage, (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM bad) AS faces UNION ALL SELECT 1, 'clean', (SELECT count(*) FROM vertices), (SELECT count(*) FROM good)
 UNION ALL SELECT 2, 'simplify', (SELECT count(DISTINCT new_id) FROM r), (SELECT count(*) FROM simple) UNION ALL SELECT 3, 'output', (SELECT count(DISTINCT v) FROM (SELECT unnest([i0, i1, i2]) AS v FROM simple)), (SELECT count(*) FROM simple))
SELECT nth, stage, vertices, faces, faces > 0 AND vertices > 0 AS valid, round(faces / (SELECT count(*) FROM bad), 6) AS kept FROM s""",
)
def mesh_pipeline(spark, d):
    v, f = _mesh(spark, d)
    return M.pipeline(_damaged(f), v, 3.0)[2].withColumn("kept", r6("kept"))


@query("mesh_simplified_faces", f"WITH {V.MESH}, {_CLUSTER}, {_SIMPLE.format(faces='faces')} SELECT * FROM simple")
def mesh_simplified_faces(spark, d):
    v, f = _mesh(spark, d)
    return M.cluster(v, f, 3.0)[1]


_OCC = f"""{_CORNERS}, fn AS MATERIALIZED (SELECT *, i0 // 576 AS face_frame FROM n), s AS (SELECT v.frame_id, v.vid, v.x AS px, v.y AS py, v.z AS pz, 1000*v.frame_id + 11.3::DOUBLE - v.x AS dx, 11.7::DOUBLE + v.frame_id % 3 - v.y AS dy, 0.4::DOUBLE - v.z AS dz FROM vertices v),
h AS (SELECT s.*, ax, ay, az, i0, i1, i2, bx-ax AS ex, by_-ay AS ey, bz-az AS ez, cx-ax AS fx, cy-ay AS fy, cz-az AS fz FROM s JOIN fn ON face_frame = frame_id AND vid <> i0 AND vid <> i1 AND vid <> i2),
q AS (SELECT *, dy*fz-dz*fy AS hx, dz*fx-dx*fz AS hy, dx*fy-dy*fx AS hz FROM h), w AS (SELECT *, ex*hx+ey*hy+ez*hz AS det, px-ax AS sx, py-ay AS sy, pz-az AS sz FROM q),
u AS (SELECT *, (sx*hx+sy*hy+sz*hz)/det AS u, sy*ez-sz*ey AS qx, sz*ex-sx*ez AS qy, sx*ey-sy*ex AS qz FROM w WHERE abs(det) >= 1e-8),
hit AS (SELECT vid, u, (dx*qx+dy*qy+dz*qz)/det AS v, (fx*qx+fy*qy+fz*qz)/det AS t FROM u), hidden AS MATERIALIZED (SELECT DISTINCT vid FROM hit WHERE u BETWEEN 0 AND 1 AND v >= 0 AND u + v <= 1 AND t > 1e-6 AND t < 1 - 1e-6)
"""


@query("occluded_points", f"WITH {_OCC} SELECT vid FROM hidden")
def occluded_points(spark, d):
    v, f = _mesh(spark, d)
    return M.occluded(v, f, v, V.eyes(spark, d)).select("vid")


@query("visible_points", f"WITH {_OCC} SELECT vid FROM vertices WHERE vid NOT IN (SELECT vid FROM hidden)")
def visible_points(spark, d):
    v, f = _mesh(spark, d)
    return v.select("frame_id", "vid").join(M.occluded(v, f, v, V.eyes(spark, d)), ["frame_id", "vid"], "left_anti").select("vid")


@query(
    "ray_box_hits",
    f"""WITH {V.CAMERAS}, r AS (SELECT rig, camera_index, x, y, z, CASE WHEN camera_index % 3 = 0 THEN 0 ELSE -x END AS dx, -y AS dy, -z AS dz FROM cameras),
s AS (SELECT *, (abs(dx) >= 1e-12 OR abs(x) <= 0.5) AND (abs(dy) >= 1e-12 OR abs(y) <= 0.5) AND (abs(dz) >= 1e-12 OR abs(z) <= 0.5) AS inside,
 greatest(0, CASE WHEN abs(dx) >= 1e-12 THEN least((-0.5-x)/dx, (0.5-x)/dx) END, CASE WHEN abs(dy) >= 1e-12 THEN least((-0.5-y)/dy, (0.5-y)/dy) END, CASE WHEN abs(dz) >= 1e-12 THEN least((-0.5-z)/dz, (0.5-z)/dz) END) AS lo,
 least(1e300, CASE WHEN abs(dx) >= 1e-12 THEN greatest((-0.5-x)/dx, (0.5-x)/dx) END, CASE WHEN abs(dy) >= 1e-12 THEN greatest((-0.5-y)/dy, (0.5-y)/dy) END, CASE WHEN abs(dz) >= 1e-12 THEN greatest((-0.5-z)/dz, (0.5-z)/dz) END) AS hi FROM r)
SELECT rig, camera_index, inside AND lo <= hi AS hit FROM s""",
)
def ray_box_hits(spark, d):
    o = G.vec()
    way = (F.when(F.col("camera_index") % 3 == 0, 0.0).otherwise(-F.col("x")), -F.col("y"), -F.col("z"))
    half = tuple(F.lit(0.5) for _ in range(3))
    return V.cameras(spark, d).select("rig", "camera_index", G.ray_box(o, way, tuple(-h for h in half), half).alias("hit"))


_UV = f"""{V.MESH}, uv AS (SELECT vid, (x - 1000*frame_id)/23*64 AS u, y/23*64 AS v FROM vertices),
tri AS (SELECT f.fid, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, c.u AS cu, c.v AS cv FROM faces f JOIN uv a ON a.vid=i0 JOIN uv b ON b.vid=i1 JOIN uv c ON c.vid=i2),
tx AS (SELECT *, (bv-cv)*(au-cu)+(cu-bu)*(av-cv) AS den FROM (SELECT *, unnest(range(greatest(0, CAST(floor(least(av,bv,cv)) AS BIGINT)), greatest(0, least(63, CAST(ceil(greatest(av,bv,cv)) AS BIGINT))) + 1)) AS y FROM (SELECT *, unnest(range(greatest(0, CAST(floor(least(au,bu,cu)) AS BIGINT)), greatest(0, least(63, CAST(ceil(greatest(au,bu,cu)) AS BIGINT))) + 1)) AS x FROM tri))),
w AS (SELECT fid, x AS tx, y AS ty, ((bv-cv)*(x+0.5::DOUBLE-cu)+(cu-bu)*(y+0.5::DOUBLE-cv))/den AS w0, ((cv-av)*(x+0.5::DOUBLE-cu)+(au-cu)*(y+0.5::DOUBLE-cv))/den AS w1 FROM tx),
cover AS MATERIALIZED (SELECT fid // 1152 AS frame_id, fid, tx, ty, w0, w1, 1-w0-w1 AS w2 FROM w WHERE w0 >= -0.001 AND w1 >= -0.001 AND 1-w0-w1 >= -0.001)"""


def _texels(spark, d):
    v, f = _mesh(spark, d)
    return M.texels(f, v.select("frame_id", "vid", ((F.col("x") - 1000 * F.col("frame_id")) / 23).alias("u"), (F.col("y") / 23).alias("v")), 64)


@query("atlas_coverage", f"WITH {_UV} SELECT fid, count(*) AS texels, round(sum(w0) + 1e-7, 5) AS w0 FROM cover GROUP BY 1")
def atlas_coverage(spark, d):
    return _texels(spark, d).groupBy("fid").agg(F.count("*").alias("texels"), F.round(F.sum("w0") + 1e-7, 5).alias("w0"))


_BLEND = _UV + """, t1 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, tx, ty ORDER BY fid) AS k FROM cover) WHERE k = 1),
fc AS (SELECT f.fid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN vertices a ON a.vid=i0 JOIN vertices b ON b.vid=i1 JOIN vertices c ON c.vid=i2),
fn AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM fc),
tp AS (SELECT t.frame_id, fid, tx, ty, w0*ax+w1*bx+w2*cx AS px, w0*ay+w1*by_+w2*cy AS py, w0*az+w1*bz+w2*cz AS pz, nx/sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny/sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz/sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM t1 t JOIN fn USING (fid)),
tc AS (SELECT *, 1000*frame_id + 4.3::DOUBLE + 5*c - px AS dx, 18.1::DOUBLE - 4*c - py AS dy, 2.7::DOUBLE + c - pz AS dz FROM tp, range(4) r(c)),
k AS (SELECT frame_id, tx, ty, c, ((c*7+tx+ty) % 10)/10.0::DOUBLE AS col, (nx*dx+ny*dy+nz*dz)/sqrt(dx*dx+dy*dy+dz*dz) AS ndc, sqrt(dx*dx+dy*dy+dz*dz) AS dist FROM tc),
b AS MATERIALIZED (SELECT *, ndc*least(1, ndc/0.26)/(1+dist*dist) AS wt FROM k WHERE ndc >= 0.25)"""


def _blended(spark, d):
    """Each texel of its first face, with the cameras overhead that the face looks towards."""
    v, f = _mesh(spark, d)
    at = ["frame_id", "tx", "ty"]
    t = _texels(spark, d).groupBy(*at).agg(F.min(F.struct("fid", "w0", "w1", "w2")).alias("f")).select(*at, "f.*")
    seen = M.texel_views(t, f, v, V.overhead(spark, d)).withColumnRenamed("camera_index", "c")
    return seen.withColumns({"col": ((F.col("c") * 7 + F.col("tx") + F.col("ty")) % 10) / 10.0, "wt": C.texture_weight(F.col("n_dot_c"), F.col("distance"))})


@query("texel_blend_weighted", f"WITH {_BLEND} SELECT frame_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, round(sum(wt*col)/sum(wt), 6) AS col FROM b GROUP BY 1, 2, 3")
def texel_blend_weighted(spark, d):
    return _blended(spark, d).groupBy("frame_id", "tx", "ty").agg(F.round(F.sum(F.col("wt") * F.col("col")) / F.sum("wt"), 6).alias("col"))


@query("texel_blend_uniform", f"WITH {_BLEND} SELECT frame_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, round(avg(col), 6) AS col, count(*) AS views FROM b GROUP BY 1, 2, 3")
def texel_blend_uniform(spark, d):
    return _blended(spark, d).groupBy("frame_id", "tx", "ty").agg(F.round(F.avg("col"), 6).alias("col"), F.count("*").alias("views"))


@query("texel_best_view", f"WITH {_BLEND} SELECT frame_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, c FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, tx, ty ORDER BY wt DESC, c) AS n FROM b) WHERE n = 1")
def texel_best_view(spark, d):
    return _blended(spark, d).groupBy("frame_id", "tx", "ty").agg(F.max_by("c", F.struct("wt", -F.col("c"))).alias("c"))
