"""Splat queries: radius merge, matching, quantisation, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import color as C
from voxelweave.functions import geometry as G
from voxelweave.functions import quantize as Q
from voxelweave.operators import spatial as S
from voxelweave.plans.registry import query
from voxelweave.sources import views as V

R = 0.05


def r6(x):
    return F.round(x, 6)


_PAIRS = """pairs AS (SELECT a.frame_id, a.splat_id AS a, b.splat_id AS b, b.opacity AS ob,
 (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)+(a.pz-b.pz)*(a.pz-b.pz) AS d2 FROM splats a JOIN splats b
 ON a.frame_id = b.frame_id AND a.worker_id <> b.worker_id
 AND (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)+(a.pz-b.pz)*(a.pz-b.pz) < {r2})"""
_WON = """seen AS (SELECT frame_id, splat_id AS s, splat_id AS id, opacity AS op FROM splats UNION ALL SELECT frame_id, a, b, ob FROM pairs),
won AS (SELECT frame_id, s AS splat_id, id AS winner_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, s ORDER BY op DESC, id) AS k FROM seen) WHERE k = 1)"""
_R2 = repr(R * R)
_BIG = 0.2
_B2 = repr(_BIG * _BIG)


@query("dedup_pairs", f"WITH {V.SPLATS}, {_PAIRS.format(r2=_B2)} SELECT frame_id, a, b, round(d2, 9) AS d2 FROM pairs")
def dedup_pairs(spark, d):
    p = S.cross_worker_pairs(V.splats(spark, d), _BIG)
    return p.select(F.col("a_frame_id").alias("frame_id"), F.col("a_splat_id").alias("a"), F.col("b_splat_id").alias("b"), F.round("d2", 9).alias("d2"))


@query("dedup_winner", f"WITH {V.SPLATS_BIG}, {_PAIRS.format(r2=_R2)}, {_WON} SELECT * FROM won")
def dedup_winner(spark, d):
    return S.winners(V.splats_big(spark, d), R)


@query(
    "dedup_merge",
    f"""WITH {V.SPLATS}, {_PAIRS.format(r2=_B2)}, {_WON},
surv AS (SELECT frame_id, winner_id FROM won WHERE splat_id = winner_id),
m AS (SELECT s.*, w.winner_id FROM splats s JOIN won w USING (frame_id, splat_id) JOIN surv v ON v.frame_id = w.frame_id AND v.winner_id = w.winner_id)
SELECT frame_id, winner_id AS splat_id, round(sum(opacity*px)/sum(opacity),6) AS px, round(sum(opacity*py)/sum(opacity),6) AS py,
 round(sum(opacity*pz)/sum(opacity),6) AS pz, round(sum(opacity*sx)/sum(opacity),6) AS sx, round(sum(opacity*sh[1])/sum(opacity),6) AS sh0,
 round(sum(opacity*opacity)/sum(opacity),6) AS opacity, count(*) AS merged FROM m GROUP BY 1, 2 HAVING sum(opacity*opacity)/sum(opacity) >= 0.3""",
)
def dedup_merge(spark, d):
    m = S.merge(V.splats(spark, d), _BIG, min_opacity=0.3)
    return m.select("frame_id", "splat_id", *[r6(F.col(c)).alias(c) for c in ("px", "py", "pz", "sx", "sh0", "opacity")], "merged")


@query(
    "dedup_merge_big",
    f"""WITH {V.SPLATS_BIG}, {_PAIRS.format(r2=_R2)}, {_WON},
surv AS (SELECT frame_id, winner_id FROM won WHERE splat_id = winner_id),
m AS (SELECT s.*, w.winner_id FROM splats s JOIN won w USING (frame_id, splat_id) JOIN surv v ON v.frame_id = w.frame_id AND v.winner_id = w.winner_id)
SELECT frame_id, winner_id AS splat_id, round(sum(opacity*px)/sum(opacity),9) AS px, round(sum(opacity*opacity)/sum(opacity),9) AS opacity, count(*) AS merged
FROM m GROUP BY 1, 2""",
)
def dedup_merge_big(spark, d):
    m = S.merge(V.splats_big(spark, d), R)
    return m.select("frame_id", "splat_id", F.round("px", 9).alias("px"), F.round("opacity", 9).alias("opacity"), "merged")


@query(
    "merge_stats",
    f"""WITH {V.SPLATS_BIG}, {_PAIRS.format(r2=_R2)}, {_WON} SELECT frame_id, count(*) AS splats, count(*) FILTER (splat_id <> winner_id) AS duplicates,
 count(*) FILTER (splat_id = winner_id) AS survivors FROM won GROUP BY 1""",
)
def merge_stats(spark, d):
    w = S.winners(V.splats_big(spark, d), R)
    return w.groupBy("frame_id").agg(F.count("*").alias("splats"), F.count_if(F.expr("splat_id <> winner_id")).alias("duplicates"), F.count_if(F.expr("splat_id = winner_id")).alias("survivors"))


@query("cell_assign", f"WITH {V.SPLATS} SELECT splat_id, CAST(floor(px/0.1) AS BIGINT) AS cx, CAST(floor(py/0.1) AS BIGINT) AS cy, CAST(floor(pz/0.1) AS BIGINT) AS cz FROM splats")
def cell_assign(spark, d):
    return S.with_cells(V.splats(spark, d), 0.1).select("splat_id", *S.CELL)


_HASH = "xor(xor((CAST(floor(px/0.1) AS BIGINT)*73856093) & 4294967295, (CAST(floor(py/0.1) AS BIGINT)*19349663) & 4294967295), (CAST(floor(pz/0.1) AS BIGINT)*83492791) & 4294967295) & 1048575"


@query("cell_hash", f"WITH {V.SPLATS} SELECT splat_id, {_HASH} AS hash FROM splats")
def cell_hash(spark, d):
    s = S.with_cells(V.splats(spark, d), 0.1)
    return s.select("splat_id", G.cell_hash(tuple(F.col(c) for c in S.CELL)).alias("hash"))


@query(
    "cell_runs",
    f"""WITH {V.SPLATS}, h AS (SELECT frame_id, splat_id, {_HASH} AS hash FROM splats),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY hash, splat_id) AS place FROM h)
SELECT frame_id, hash, min(place) AS first, max(place) AS last FROM n GROUP BY 1, 2""",
)
def cell_runs(spark, d):
    return S.cell_runs(V.splats(spark, d), 0.1)


_MATCH = f"""{V.SPLATS}, o AS (SELECT *, frame_id + 1 AS g FROM splats), n AS (SELECT *, frame_id AS g FROM splats),
c AS (SELECT n.splat_id, o.splat_id AS old_id, sqrt((n.px-o.px)*(n.px-o.px)+(n.py-o.py)*(n.py-o.py)+(n.pz-o.pz)*(n.pz-o.pz))
 + 0.1*(abs(n.sh[1]-o.sh[1])+abs(n.sh[2]-o.sh[2])+abs(n.sh[3]-o.sh[3]))/3 AS cost FROM n JOIN o
 ON n.g = o.g AND (n.px-o.px)*(n.px-o.px)+(n.py-o.py)*(n.py-o.py)+(n.pz-o.pz)*(n.pz-o.pz) < 0.09),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY cost, old_id) AS k FROM c WHERE cost < 0.3) WHERE k = 1)"""


def _match(spark, d):
    """Every frame's splats against those of the frame before."""
    s = V.splats(spark, d).select("frame_id", "splat_id", "px", "py", "pz", "sh")
    return S.match(s, s.withColumn("frame_id", F.col("frame_id") + 1), 0.3, 0.3, 0.1, on=("frame_id",))


@query("temporal_match", f"WITH {_MATCH} SELECT n.splat_id, m.old_id, round(m.cost, 6) AS cost FROM n LEFT JOIN m USING (splat_id)")
def temporal_match(spark, d):
    return _match(spark, d).select("splat_id", "old_id", r6(F.col("cost")).alias("cost"))


@query("match_counts", f"WITH {_MATCH} SELECT count(m.old_id) AS matched, count(*) - count(m.old_id) AS added, (SELECT count(*) FROM o WHERE splat_id NOT IN (SELECT old_id FROM m)) AS unmatched_old FROM n LEFT JOIN m USING (splat_id)")
def match_counts(spark, d):
    m = _match(spark, d)
    old = V.splats(spark, d).select("splat_id").join(m.select(F.col("old_id").alias("splat_id")), "splat_id", "left_anti")
    sums = m.agg(F.count("old_id").alias("matched"), F.count_if(F.expr("old_id IS NULL")).alias("added"))
    return sums.crossJoin(old.agg(F.count("*").alias("unmatched_old")))


@query("unmatched_new", f"WITH {_MATCH} SELECT splat_id FROM n WHERE splat_id NOT IN (SELECT splat_id FROM m)")
def unmatched_new(spark, d):
    return _match(spark, d).where("old_id IS NULL").select("splat_id")


@query("ema_blend_step", f"WITH {_MATCH} SELECT m.splat_id, m.old_id, round(o.px*0.7+n.px*0.3, 6) AS px, round(o.opacity*0.7+n.opacity*0.3, 6) AS opacity FROM m JOIN n USING (splat_id) JOIN o ON o.splat_id = m.old_id")
def ema_blend_step(spark, d):
    s = V.splats(spark, d).select("frame_id", "splat_id", "px", "opacity")
    new = s.drop("frame_id")
    old = s.select(F.col("splat_id").alias("old_id"), F.col("px").alias("opx"), F.col("opacity").alias("oo"))
    m = _match(spark, d).where("old_id IS NOT NULL").select("splat_id", "old_id")
    return m.join(new, "splat_id").join(old, "old_id").select("splat_id", "old_id", r6(F.col("opx") * 0.7 + F.col("px") * 0.3).alias("px"), r6(F.col("oo") * 0.7 + F.col("opacity") * 0.3).alias("opacity"))


@query("frame_bbox", f"WITH {V.SPLATS} SELECT frame_id, min(px) AS min_px, max(px) AS max_px, min(py) AS min_py, max(py) AS max_py, min(pz) AS min_pz, max(pz) AS max_pz FROM splats GROUP BY 1")
def frame_bbox(spark, d):
    return S.bounds(V.splats(spark, d))


_BOX = f"{V.SPLATS}, b AS (SELECT frame_id, min(px) AS lo, max(px) AS hi FROM splats GROUP BY 1), q AS (SELECT splat_id, px, lo, hi, CAST(floor(least(1, greatest(0, (px-lo)/(hi-lo)))*65535+0.5) AS INTEGER) AS q FROM splats JOIN b USING (frame_id))"


def _boxed(spark, d):
    s = V.splats(spark, d)
    w = Window.partitionBy("frame_id")
    return s.withColumns({"lo": F.min("px").over(w), "hi": F.max("px").over(w)})


@query("quantize_pos16", f"WITH {_BOX} SELECT splat_id, q FROM q")
def quantize_pos16(spark, d):
    return _boxed(spark, d).select("splat_id", Q.to_u16(F.col("px"), F.col("lo"), F.col("hi")).alias("q"))


@query("dequantize_error", f"WITH {_BOX} SELECT splat_id, round(abs(lo + q/65535.0::DOUBLE*(hi-lo) - px), 7) AS err FROM q")
def dequantize_error(spark, d):
    n = Q.to_u16(F.col("px"), F.col("lo"), F.col("hi"))
    return _boxed(spark, d).select("splat_id", F.round(F.abs(Q.from_u16(n, F.col("lo"), F.col("hi")) - F.col("px")), 7).alias("err"))


@query("quantize_log_scale", f"WITH {V.SPLATS} SELECT splat_id, CAST(floor(least(1,greatest(0,(round(ln(sx),9)+10)/12))*65535+0.5) AS INTEGER) AS q FROM splats")
def quantize_log_scale(spark, d):
    return V.splats(spark, d).select("splat_id", Q.to_u16(F.round(F.log("sx"), 9), F.lit(-10.0), F.lit(2.0)).alias("q"))


@query("quantize_quat8", f"WITH {V.SPLATS} SELECT splat_id, CAST(trunc(qw*127) AS INTEGER) AS qw, CAST(trunc(qx*127) AS INTEGER) AS qx, CAST(trunc(qy*127) AS INTEGER) AS qy, CAST(trunc(qz*127) AS INTEGER) AS qz FROM splats")
def quantize_quat8(spark, d):
    return V.splats(spark, d).select("splat_id", *[Q.quat_i8(F.col(c)).alias(c) for c in ("qw", "qx", "qy", "qz")])


@query("quantize_spz", f"WITH {V.SPLATS} SELECT splat_id, CAST(round(least(1,greatest(0,opacity))*255) AS INTEGER) AS opacity, CAST(round(least(1,greatest(0,(sh[1]+5)/10))*255) AS INTEGER) AS sh0 FROM splats")
def quantize_spz(spark, d):
    s = V.splats(spark, d)
    return s.select("splat_id", Q.spz(F.col("opacity"), F.lit(0.0), F.lit(1.0), 255).alias("opacity"), Q.spz(F.col("sh")[0], F.lit(-5.0), F.lit(5.0), 255).alias("sh0"))


@query("sh_dc_color", f"WITH {V.SPLATS} SELECT splat_id, round(least(1,greatest(0,0.28209479*sh[1]+0.5)),6) AS r, round(least(1,greatest(0,0.28209479*sh[2]+0.5)),6) AS g, round(least(1,greatest(0,0.28209479*sh[3]+0.5)),6) AS b FROM splats")
def sh_dc_color(spark, d):
    return V.splats(spark, d).select("splat_id", *[r6(C.sh_dc_color(F.col("sh")[i])).alias(n) for i, n in enumerate("rgb")])


@query(
    "splat_covariance",
    f"""WITH {V.SPLATS}, m AS (SELECT splat_id, (1-2*(qy*qy+qz*qz))*sx AS a, 2*(qx*qy-qw*qz)*sy AS b, 2*(qx*qz+qw*qy)*sz AS c, 2*(qx*qy+qw*qz)*sx AS d, (1-2*(qx*qx+qz*qz))*sy AS e, 2*(qy*qz-qw*qx)*sz AS f FROM splats)
SELECT splat_id, round(a*a+b*b+c*c,6) AS xx, round(a*d+b*e+c*f,6) AS xy, round(d*d+e*e+f*f,6) AS yy FROM m""",
)
def splat_covariance(spark, d):
    v = G.covariance(tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")), G.vec(names=("sx", "sy", "sz")))
    return V.splats(spark, d).select("splat_id", r6(v[0]).alias("xx"), r6(v[1]).alias("xy"), r6(v[3]).alias("yy"))


@query("budget_topk", f"WITH {V.SPLATS_BIG} SELECT frame_id, splat_id, opacity FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY opacity DESC, splat_id) AS k FROM splats) WHERE k <= 50")
def budget_topk(spark, d):
    return S.top_opacity(V.splats_big(spark, d), 50).select("frame_id", "splat_id", "opacity")


@query("opacity_prune", f"WITH {V.SPLATS_BIG} SELECT frame_id, count(*) AS kept FROM splats WHERE opacity >= 0.25 GROUP BY 1")
def opacity_prune(spark, d):
    return V.splats_big(spark, d).where("opacity >= 0.25").groupBy("frame_id").agg(F.count("*").alias("kept"))


@query("depth_sorted_rank", f"WITH {V.SPLATS} SELECT frame_id, splat_id, row_number() OVER (PARTITION BY frame_id ORDER BY pz DESC, splat_id) AS draw FROM splats")
def depth_sorted_rank(spark, d):
    w = Window.partitionBy("frame_id").orderBy(F.desc("pz"), "splat_id")
    return V.splats(spark, d).select("frame_id", "splat_id", F.row_number().over(w).cast("long").alias("draw"))


@query(
    "delta_vs_keyframe",
    f"""WITH {V.STABLE}, n AS (SELECT *, frame_id - frame_id % 5 AS key_id FROM splats), k AS (SELECT * FROM splats WHERE frame_id % 5 = 0), m AS (SELECT DISTINCT frame_id, key_id FROM n WHERE frame_id % 5 <> 0)
SELECT n.frame_id, n.splat_id, CASE WHEN k.splat_id IS NULL THEN 'added' ELSE 'moved' END AS kind, round(n.px-k.px,6) AS dpx, round(n.py-k.py,6) AS dpy, round(n.pz-k.pz,6) AS dpz, round(n.qw-k.qw,6) AS dqw, round(n.opacity,6) AS opacity
FROM n LEFT JOIN k ON k.frame_id = n.key_id AND k.splat_id = n.splat_id WHERE n.frame_id % 5 <> 0
UNION ALL SELECT m.frame_id, k.splat_id, 'removed', NULL, NULL, NULL, NULL, NULL FROM m JOIN k ON k.frame_id = m.key_id WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.frame_id = m.frame_id AND n.splat_id = k.splat_id)""",
)
def delta_vs_keyframe(spark, d):
    rows = S.keyframe_deltas(V.stable_splats(spark, d), 5)
    return rows.select("frame_id", "splat_id", "kind", *[r6(F.col(c)).alias(c) for c in ("dpx", "dpy", "dpz", "dqw", "opacity")])


@query("keyframe_boxes", f"WITH {V.STABLE} SELECT frame_id, count(*) AS splats, round(min(px), 6) AS min_px, round(max(pz), 6) AS max_pz FROM splats GROUP BY 1")
def keyframe_boxes(spark, d):
    s = V.stable_splats(spark, d)
    return S.bounds(s).join(s.groupBy("frame_id").agg(F.count("*").alias("splats")), "frame_id").select("frame_id", "splats", r6(F.col("min_px")).alias("min_px"), r6(F.col("max_pz")).alias("max_pz"))


@query("concatenated_partials", f"WITH {V.SPLATS} SELECT worker_id, frame_id, count(*) AS splats FROM splats GROUP BY 1, 2")
def concatenated_partials(spark, d):
    s = V.splats(spark, d)
    parts = {w: s.where(F.col("worker_id") == w).drop("worker_id") for w in range(4)}
    return S.concatenated(parts).groupBy("worker_id", "frame_id").agg(F.count("*").alias("splats"))
