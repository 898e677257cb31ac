"""Codec and render queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import codec as D
from voxelweave.operators import render as R
from voxelweave.plans.registry import query
from voxelweave.sources import views as V


@query("blob_sizes", f"WITH {V.SPLATS} SELECT frame_id, count(*) AS splats, 36 + count(*) * 68 AS bytes FROM splats GROUP BY 1")
def blob_sizes(spark, d):
    return D.encode_frames(V.splats(spark, d)).select("frame_id", "splats", F.octet_length("payload").cast("long").alias("bytes"))


_RANKED = f"{V.SPLATS}, n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY splat_id) - 1 AS k FROM splats)"


def _q(x: str, top: int) -> str:
    return f"floor(least(1, greatest(0, {x}))*{top}+0.5)/{top}"


@query(
    "blob_round_trip",
    f"""WITH {_RANKED}, b AS (SELECT frame_id, CAST(min(px) - ((max(px)-min(px))*0.001 + 1e-6) AS FLOAT) AS lo, CAST(max(px) + ((max(px)-min(px))*0.001 + 1e-6) AS FLOAT) AS hi FROM splats GROUP BY 1)
SELECT frame_id, k AS splat_id, round(CAST(lo AS DOUBLE) + {_q("(px - CAST(lo AS DOUBLE)) / CAST(hi - lo AS DOUBLE)", 65535)} * (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)), 5) AS px, round({_q("opacity", 255)}, 6) AS opacity, round({_q("(sh[1]+5)/10", 255)}*10-5, 5) AS sh0 FROM n JOIN b USING (frame_id)""",
)
def blob_round_trip(spark, d):
    out = D.decode_frames(D.encode_frames(V.splats(spark, d)))
    return out.select("frame_id", "splat_id", F.round("px", 5).alias("px"), F.round("opacity", 6).alias("opacity"), F.round(F.col("sh")[0], 5).alias("sh0"))


@query(
    "spz_round_trip",
    f"""WITH {_RANKED}, b AS (SELECT frame_id, min(py) AS lo, max(py) AS hi FROM splats GROUP BY 1)
SELECT frame_id, k AS splat_id, round(round_even(least(1, greatest(0, opacity)) * 255, 0) / 255, 6) AS opacity, round(lo + round_even((py-lo)/(hi-lo)*65535, 0)/65535*(hi-lo), 4) AS py, round(sx, 4) AS sx, round(round_even((qw+1)/2*255, 0)/255*2-1, 6) AS qw, round(round_even(least(1, greatest(0, (sh[48]+5)/10))*255, 0)/255*10-5, 6) AS sh47 FROM n JOIN b USING (frame_id)""",
)
def spz_round_trip(spark, d):
    out = D.decode_frames(D.encode_frames(V.splats(spark, d), "spz"), "spz")
    return out.select("frame_id", "splat_id", F.round("opacity", 6).alias("opacity"), F.round("py", 4).alias("py"), F.round("sx", 4).alias("sx"), F.round("qw", 6).alias("qw"), F.round(F.col("sh")[47], 6).alias("sh47"))


_SEQUENCE = V.SPLATS.replace("vec_id AS splat_id, CAST(label AS BIGINT) AS frame_id", "vec_id % 32 + vec_id // 96 AS splat_id, vec_id // 32 AS frame_id")


@query(
    "sequence_keyframes",
    f"""WITH {_SEQUENCE}, i AS (SELECT frame_id, frame_id // 5 AS gop, string_agg(splat_id::VARCHAR, ',' ORDER BY splat_id) AS ids, count(*) AS splats, round(sum(round_even(least(1, greatest(0, opacity)) * 255, 0) / 255), 4) AS opacity FROM splats GROUP BY 1),
l AS (SELECT *, lag(ids) OVER (PARTITION BY gop ORDER BY frame_id) AS before FROM i), k AS (SELECT *, before IS NULL OR before <> ids AS is_keyframe FROM l)
SELECT frame_id, max(CASE WHEN is_keyframe THEN frame_id END) OVER (PARTITION BY gop ORDER BY frame_id) AS key_id, is_keyframe, CASE WHEN is_keyframe THEN splats END AS splats, CASE WHEN is_keyframe THEN opacity END AS opacity FROM k""",
)
def sequence_keyframes(spark, d):
    """Frames of 32 splats each, whose ids change every third frame, in intervals of five; keyframes are decoded again."""
    s = V.splats(spark, d)
    s = s.withColumns({"frame_id": F.expr("splat_id div 32"), "splat_id": F.expr("splat_id % 32 + splat_id div 96")})
    coded = D.encode_sequence(s, 5)
    back = D.decode_frames(coded.where("is_keyframe"), "spz").groupBy("frame_id").agg(F.count("*").alias("splats"), F.round(F.sum("opacity"), 4).alias("opacity"))
    return coded.select("frame_id", "key_id", "is_keyframe").join(back, "frame_id", "left")


_KIND = "CASE type WHEN 'keyframe' THEN 0 WHEN 'delta' THEN 1 ELSE 2 END"


@query("packet_round_trip", f"WITH {V.PACKETS} SELECT CAST({_KIND} AS INTEGER) AS kind, CAST(1 AS INTEGER) AS flags, frame_id, timestamp_ms & 4294967295 AS timestamp_ms, event_id FROM packets")
def packet_round_trip(spark, d):
    p = V.packets(spark, d).select(F.expr(_KIND).alias("kind"), F.lit(1).alias("flags"), "frame_id", "timestamp_ms", F.col("event_id").cast("string").cast("binary").alias("payload"))
    out = D.unwire(D.wire(p))
    return out.select("kind", "flags", "frame_id", "timestamp_ms", F.col("payload").cast("string").cast("long").alias("event_id"))


@query(
    "packet_streams",
    f"""WITH {V.PACKETS}, p AS (SELECT *, {_KIND} AS kind, event_id // 16 AS stream, row_number() OVER (PARTITION BY event_id // 16 ORDER BY event_id) AS n, count(*) OVER (PARTITION BY event_id // 16) AS m FROM packets)
SELECT stream, CAST(kind AS INTEGER) AS kind, frame_id, event_id, CAST(NULL AS VARCHAR) AS rest FROM p WHERE NOT (stream % 3 = 1 AND n = m) AND NOT (stream % 3 = 2 AND n > 3)
UNION ALL SELECT DISTINCT stream, NULL::INTEGER, NULL::BIGINT, NULL::BIGINT, CASE WHEN stream % 3 = 1 THEN 'cut' ELSE 'foreign' END FROM p WHERE stream % 3 = 1 OR stream % 3 = 2 AND m > 3""",
)
def packet_streams(spark, d):
    """Byte streams of up to 16 packets each through a table function in SQL: every third lacks its last byte, every third has a foreign
    header after three packets."""
    p = V.packets(spark, d).select(F.expr(_KIND).alias("kind"), F.lit(1).alias("flags"), "frame_id", "timestamp_ms", F.col("event_id").cast("string").cast("binary").alias("payload"), "event_id")
    wired = D.wire(p).select(F.expr("event_id div 16").alias("stream"), "event_id", F.hex("wire").alias("wire"))
    held = wired.groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "wire"))), lambda x: x["wire"]).alias("w"))  # 16 at most
    whole = F.array_join("w", "")
    foreign = F.concat(F.array_join(F.slice("w", 1, 3), ""), F.when(F.size("w") > 3, F.concat(F.lit("FF"), F.array_join(F.slice("w", 4, 16), ""))).otherwise(""))
    data = F.when(F.col("stream") % 3 == 1, F.expr("substring(array_join(w, ''), 1, length(array_join(w, '')) - 2)")).when(F.col("stream") % 3 == 2, foreign).otherwise(whole)
    D.register_packets(spark)
    out = spark.sql("SELECT s.stream, u.* FROM {s} s, LATERAL unpack_packets(s.data) u", s=held.select("stream", F.unhex(data).alias("data")))
    return out.select("stream", "kind", "frame_id", F.when(F.col("rest").isNull(), F.col("payload").cast("string").cast("long")).alias("event_id"), "rest")


@query(
    "splat_composite",
    f"""WITH {V.SPLATS}, g AS (SELECT frame_id, splat_id, px AS x, py AS y, pz + 3 AS z, sx*0.02 AS sx, sy*0.02 AS sy, sz*0.02 AS sz, qw, qx, qy, qz, opacity, least(1, greatest(0, 0.28209479*sh[1]+0.5)) AS red FROM splats WHERE pz + 3 > 0.1),
m AS (SELECT *, (1-2*(qy*qy+qz*qz))*sx AS a1, 2*(qx*qy-qw*qz)*sy AS a2, 2*(qx*qz+qw*qy)*sz AS a3, 2*(qx*qy+qw*qz)*sx AS b1, (1-2*(qx*qx+qz*qz))*sy AS b2, 2*(qy*qz-qw*qx)*sz AS b3, 2*(qx*qz-qw*qy)*sx AS c1, 2*(qy*qz+qw*qx)*sy AS c2, (1-2*(qx*qx+qy*qy))*sz AS c3 FROM g),
j AS (SELECT *, 40/z*a1 - 40*x/(z*z)*c1 AS u1, 40/z*a2 - 40*x/(z*z)*c2 AS u2, 40/z*a3 - 40*x/(z*z)*c3 AS u3, 40/z*b1 - 40*y/(z*z)*c1 AS v1, 40/z*b2 - 40*y/(z*z)*c2 AS v2, 40/z*b3 - 40*y/(z*z)*c3 AS v3 FROM m),
p AS (SELECT frame_id, splat_id, z, opacity, red, x/z*40+24 AS u, y/z*40+16 AS v, u1*u1+u2*u2+u3*u3+0.3 AS a, u1*v1+u2*v2+u3*v3 AS b, v1*v1+v2*v2+v3*v3+0.3 AS c FROM j),
q AS (SELECT *, 3*sqrt((a+c)/2 + sqrt(greatest(0, (a-c)*(a-c)/4 + b*b))) AS r FROM p),
t AS (SELECT *, unnest(range(greatest(0, CAST(floor(v-r) AS BIGINT)), greatest(0, least(31, CAST(ceil(v+r) AS BIGINT))) + 1)) AS y FROM (SELECT *, unnest(range(greatest(0, CAST(floor(u-r) AS BIGINT)), greatest(0, least(47, CAST(ceil(u+r) AS BIGINT))) + 1)) AS x FROM q)),
f AS (SELECT *, exp(-4.5 * (c*(x+0.5-u)*(x+0.5-u) - 2*b*(x+0.5-u)*(y+0.5-v) + a*(y+0.5-v)*(y+0.5-v))/(a*c-b*b)/9) * opacity AS alpha FROM t),
o AS (SELECT *, coalesce(product(1-alpha) OVER (PARTITION BY frame_id, x, y ORDER BY z, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS left_over FROM f WHERE alpha >= 1/255.0::DOUBLE)
SELECT frame_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(sum(left_over*alpha*red), 4) AS r, round(sum(left_over*alpha), 4) AS coverage FROM o GROUP BY 1, 2, 3""",
)
def splat_composite(spark, d):
    s = V.splats(spark, d).withColumns({"pz": F.col("pz") + 3, "sx": F.col("sx") * 0.02, "sy": F.col("sy") * 0.02, "sz": F.col("sz") * 0.02})
    return R.composite(R.project_splats(s, 40.0, 40.0, 24.0, 16.0), 48, 32).select("frame_id", "x", "y", F.round("r", 4).alias("r"), F.round("coverage", 4).alias("coverage"))
