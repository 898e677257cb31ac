"""Simplification and atlas queries over a mesh for each vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import atlas as A
from voxelweave.operators import simplify as S
from voxelweave.plans.registry import query
from voxelweave.sources import views as V


def r6(c):
    return F.round(c, 6)


_SIDES = f"""{V.RELIEF}, s AS MATERIALIZED (SELECT mesh_id, fid, i0 AS a, i1 AS b, i2 AS c FROM rf UNION ALL SELECT mesh_id, fid, i1, i2, i0 FROM rf UNION ALL SELECT mesh_id, fid, i2, i0, i1 FROM rf),
e AS MATERIALIZED (SELECT mesh_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM s GROUP BY 1, 2, 3)"""
_SUMS = ", ".join(f"sum(w * {p}) AS {k}" for k, p in zip(S.Q, ("nx*nx", "nx*ny", "nx*nz", "nx*d", "ny*ny", "ny*nz", "ny*d", "nz*nz", "nz*d", "d*d", "1"), strict=True))
#: Quadrics in the middle of each mesh's box: planes of the faces by area, and upright ones on border edges.
_QUADRICS = f"""{_SIDES}, b AS (SELECT mesh_id, (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my, (min(z)+max(z))/2 AS mz, (max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z)) AS r2 FROM rv GROUP BY 1),
l AS MATERIALIZED (SELECT mesh_id, vid, x-mx AS x, y-my AS y, z-mz AS z FROM rv JOIN b USING (mesh_id)),
t AS (SELECT f.mesh_id, fid, i0, i1, i2, p.x AS ax, p.y AS ay, p.z AS az, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) AS nx, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) AS ny, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) AS nz
 FROM rf f JOIN l p ON p.mesh_id=f.mesh_id AND p.vid=i0 JOIN l q ON q.mesh_id=f.mesh_id AND q.vid=i1 JOIN l r ON r.mesh_id=f.mesh_id AND r.vid=i2),
u AS MATERIALIZED (SELECT mesh_id, fid, i0, i1, i2, ax, ay, az, nx/k AS nx, ny/k AS ny, nz/k AS nz, k/2 AS w FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS k FROM t) WHERE k > 0),
bo AS (SELECT s.mesh_id, s.a, s.b, p.x AS px, p.y AS py, p.z AS pz, (q.y-p.y)*u.nz-(q.z-p.z)*u.ny AS nx, (q.z-p.z)*u.nx-(q.x-p.x)*u.nz AS ny, (q.x-p.x)*u.ny-(q.y-p.y)*u.nx AS nz FROM s JOIN e ON e.mesh_id=s.mesh_id AND lo=least(a,b) AND hi=greatest(a,b) AND n=1
 JOIN u ON u.mesh_id=s.mesh_id AND u.fid=s.fid JOIN l p ON p.mesh_id=s.mesh_id AND p.vid=a JOIN l q ON q.mesh_id=s.mesh_id AND q.vid=b),
bu AS (SELECT mesh_id, a, b, px, py, pz, nx/k AS nx, ny/k AS ny, nz/k AS nz, 10*k*k AS w FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS k FROM bo) WHERE k > 0),
pl AS (SELECT mesh_id, unnest([i0, i1, i2]) AS vid, nx, ny, nz, -(nx*ax+ny*ay+nz*az) AS d, w FROM u UNION ALL SELECT mesh_id, unnest([a, b]), nx, ny, nz, -(nx*px+ny*py+nz*pz), w FROM bu),
q AS MATERIALIZED (SELECT mesh_id, vid, {_SUMS} FROM pl GROUP BY 1, 2)"""


@query("vertex_quadrics", f"WITH {_QUADRICS} SELECT mesh_id, vid, {', '.join(f'round({k}, 6) AS {k}' for k in S.Q)} FROM q")
def vertex_quadrics(spark, d):
    out = S.quadrics(*V.relief(spark, d))
    return out.select("mesh_id", "vid", *[r6(k).alias(k) for k in S.Q])


_AT_B = "abs(qxx*x*x + qyy*y*y + qzz*z*z + qdd + 2*(qxy*x*y + qxz*x*z + qyz*y*z + qxd*x + qyd*y + qzd*z))/qw"
_ROUND = f"""{_QUADRICS}, wy AS MATERIALIZED (SELECT mesh_id, lo AS a, hi AS b, n FROM e UNION ALL SELECT mesh_id, hi, lo, n FROM e),
kd AS MATERIALIZED (SELECT mesh_id, a AS vid, bool_or(n = 1) AS border, bool_or(n > 2) OR count(*) FILTER (n = 1) > 2 AS locked, count(*) AS valence FROM wy GROUP BY 1, 2),
my AS (SELECT wy.mesh_id, wy.a, wy.b, wy.n, {_AT_B} AS cost, 0.0025*r2/4 AS most FROM wy JOIN kd ka ON ka.mesh_id=wy.mesh_id AND ka.vid=a JOIN kd kb ON kb.mesh_id=wy.mesh_id AND kb.vid=b JOIN q ON q.mesh_id=wy.mesh_id AND q.vid=a JOIN l ON l.mesh_id=wy.mesh_id AND l.vid=b JOIN b bx ON bx.mesh_id=wy.mesh_id
 WHERE NOT ka.locked AND (NOT ka.border OR n = 1) AND NOT (ka.valence = 3 AND kb.valence = 3)),
be AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, a ORDER BY cost, b) AS k FROM my WHERE cost <= most) WHERE k = 1),
cm AS (SELECT be.mesh_id, be.a, count(*) AS common FROM be JOIN wy x ON x.mesh_id=be.mesh_id AND x.a=be.a JOIN wy y ON y.mesh_id=be.mesh_id AND y.a=be.b AND y.b=x.b GROUP BY 1, 2),
tu AS (SELECT be.mesh_id, be.a, pa.x AS ax, pa.y AS ay, pa.z AS az, pb.x AS bx, pb.y AS by_, pb.z AS bz, pp.x AS px, pp.y AS py, pp.z AS pz, pq.x AS qx, pq.y AS qy, pq.z AS qz FROM be JOIN s ON s.mesh_id=be.mesh_id AND s.a=be.a AND s.b<>be.b AND s.c<>be.b
 JOIN l pa ON pa.mesh_id=be.mesh_id AND pa.vid=be.a JOIN l pb ON pb.mesh_id=be.mesh_id AND pb.vid=be.b JOIN l pp ON pp.mesh_id=be.mesh_id AND pp.vid=s.b JOIN l pq ON pq.mesh_id=be.mesh_id AND pq.vid=s.c),
tv AS (SELECT mesh_id, a, (py-ay)*(qz-az)-(pz-az)*(qy-ay) AS ux, (pz-az)*(qx-ax)-(px-ax)*(qz-az) AS uy, (px-ax)*(qy-ay)-(py-ay)*(qx-ax) AS uz, (py-by_)*(qz-bz)-(pz-bz)*(qy-by_) AS vx, (pz-bz)*(qx-bx)-(px-bx)*(qz-bz) AS vy, (px-bx)*(qy-by_)-(py-by_)*(qx-bx) AS vz FROM tu),
fl AS (SELECT DISTINCT mesh_id, a FROM tv WHERE ux*vx+uy*vy+uz*vz <= 0.25*sqrt(ux*ux+uy*uy+uz*uz)*sqrt(vx*vx+vy*vy+vz*vz)),
g AS MATERIALIZED (SELECT be.mesh_id, be.a, be.b, cost, (cost, be.a % 1000003 * 48271 % 65521, be.a) AS rank FROM be JOIN cm USING (mesh_id, a) LEFT JOIN fl USING (mesh_id, a) WHERE common = be.n AND fl.a IS NULL),
ri AS MATERIALIZED (SELECT DISTINCT g.mesh_id, g.a, g.rank, unnest([s.a, s.b, s.c]) AS v FROM g JOIN s ON s.mesh_id=g.mesh_id AND s.a=g.a), en AS MATERIALIZED (SELECT mesh_id, a, rank, unnest([a, b]) AS v FROM g),
no AS (SELECT en.mesh_id, en.a FROM en JOIN ri ON ri.mesh_id=en.mesh_id AND ri.v=en.v WHERE ri.rank < en.rank UNION SELECT ri.mesh_id, ri.a FROM ri JOIN en ON ri.mesh_id=en.mesh_id AND ri.v=en.v WHERE en.rank < ri.rank),
ch AS MATERIALIZED (SELECT g.* FROM g ANTI JOIN no USING (mesh_id, a)),
nf AS (SELECT rf.mesh_id, fid, coalesce(x.b, i0) AS i0, coalesce(y.b, i1) AS i1, coalesce(z.b, i2) AS i2 FROM rf LEFT JOIN ch x ON x.mesh_id=rf.mesh_id AND x.a=i0 LEFT JOIN ch y ON y.mesh_id=rf.mesh_id AND y.a=i1 LEFT JOIN ch z ON z.mesh_id=rf.mesh_id AND z.a=i2)"""


@query("quadric_round", f"WITH {_ROUND} SELECT mesh_id, fid, i0, i1, i2 FROM nf WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2")
def quadric_round(spark, d):
    """All meshes after one round of collapses, those of an error up to a twentieth of the radius."""
    return S.one_round(*V.relief(spark, d), target_error=0.05, together=True)  # 98 faces each


_WAYS = f"""{V.RELIEF}, t AS (SELECT f.*, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) AS nx, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) AS ny, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) AS nz FROM rf f JOIN rv p ON p.mesh_id=f.mesh_id AND p.vid=i0 JOIN rv q ON q.mesh_id=f.mesh_id AND q.vid=i1 JOIN rv r ON r.mesh_id=f.mesh_id AND r.vid=i2),
wa AS MATERIALIZED (SELECT mesh_id, fid, i0, i1, i2, CASE WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN CASE WHEN nx < 0 THEN 1 ELSE 0 END WHEN abs(ny) >= abs(nz) THEN CASE WHEN ny < 0 THEN 3 ELSE 2 END ELSE CASE WHEN nz < 0 THEN 5 ELSE 4 END END AS way FROM t)"""
_CHARTS = f"""{_WAYS}, ed AS (SELECT mesh_id, fid, way, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT mesh_id, fid, way, i0 AS a, i1 AS b FROM wa UNION ALL SELECT mesh_id, fid, way, i1, i2 FROM wa UNION ALL SELECT mesh_id, fid, way, i2, i0 FROM wa)),
li AS MATERIALIZED (SELECT x.mesh_id, x.fid AS a, y.fid AS b FROM ed x JOIN ed y ON x.mesh_id=y.mesh_id AND x.lo=y.lo AND x.hi=y.hi AND x.way=y.way AND x.fid<>y.fid),
re(mesh_id, fid, here) AS (SELECT mesh_id, fid, fid FROM wa UNION SELECT r.mesh_id, r.fid, l.b FROM re r JOIN li l ON l.mesh_id=r.mesh_id AND l.a=r.here)"""


@query("grown_charts", f"WITH RECURSIVE {_CHARTS} SELECT mesh_id, fid, min(here) AS chart FROM re GROUP BY 1, 2")
def grown_charts(spark, d):
    """The connected faces of one way, before any is taken out for an overlap."""
    v, f = V.relief(spark, d)
    return A._grown(A.laid_flat(f, v), A.neighbours(f), small=True)  # 98 faces each


_PACKED = """bx AS (SELECT vec_id AS mesh_id, CAST(c AS BIGINT) AS chart, abs(CAST(embedding[2*c+1] AS DOUBLE)) AS w, abs(CAST(embedding[2*c+2] AS DOUBLE)) AS h FROM embeddings, range(32) t(c) WHERE len(embedding) = 64),
si AS (SELECT mesh_id, greatest(sqrt(sum(w*h))*1.2, max(w), max(h)) * (4/2048::DOUBLE) AS pad FROM bx GROUP BY 1), p AS MATERIALIZED (SELECT bx.*, pad, w + pad AS pw, h + pad AS ph FROM bx JOIN si USING (mesh_id)),
le AS (SELECT mesh_id, greatest(sqrt(sum(pw*ph)), max(pw)) AS length FROM p GROUP BY 1),
o AS MATERIALIZED (SELECT p.*, length, coalesce(sum(pw) OVER (PARTITION BY mesh_id ORDER BY h DESC, chart ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p JOIN le USING (mesh_id)),
sh AS (SELECT *, floor(pos/length) AS shelf, pos - floor(pos/length)*length AS x FROM o), hs AS MATERIALIZED (SELECT mesh_id, shelf, max(ph) AS sh, max(x + pw) AS sx FROM sh GROUP BY 1, 2),
ys AS MATERIALIZED (SELECT *, coalesce(sum(sh) OVER (PARTITION BY mesh_id ORDER BY shelf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM hs), sz AS (SELECT mesh_id, greatest(max(y + sh), max(sx)) AS size FROM ys GROUP BY 1)"""


@query("shelf_packing", f"WITH {_PACKED} SELECT mesh_id, chart, round((x + pad/2)/size, 6) AS at_u, round((y + pad/2)/size, 6) AS at_v, round(1/size, 6) AS scale FROM sh JOIN ys USING (mesh_id, shelf) JOIN sz USING (mesh_id)")
def shelf_packing(spark, d):
    """32 boxes for each vector, of the sizes of its components."""
    e = V.table(spark, d, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("mesh_id"), "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("chart"))
    side = lambda k: F.abs(F.get("embedding", (2 * F.col("chart") + k).cast("int")).cast("double"))
    box = e.select("mesh_id", "chart", F.lit(0.0).alias("u0"), F.lit(0.0).alias("v0"), side(0).alias("w"), side(1).alias("h"))
    return A.packed(box).select("mesh_id", "chart", *[r6(c).alias(c) for c in ("at_u", "at_v", "scale")])
