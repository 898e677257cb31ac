"""Texture atlases: charts of a mesh, their places in the unit square, and vertices split along the seams.

A chart is a connected set of faces that look the same way (of six, along an axis), laid flat by dropping that axis. Two such faces side by
side never overlap, but a surface that winds around can: faces of a chart that overlap when laid flat are found by a join on cells, and the
later one of each pair leaves the chart; those that left form charts of their own, for some rounds, then single faces. So no two faces of a
chart overlap. Charts are packed on shelves: in the order of their heights they stand one after the other on a long strip, which is cut to
shelves of equal length; a prefix sum of the widths gives all places at once.

Tables hold many meshes: vertices (mesh_id, vid, x, y, z), faces (mesh_id, fid, i0, i1, i2); joins are on (mesh_id, vertex or face).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import geometry as G
from voxelweave.operators.graph import connected
from voxelweave.operators.simplify import cornered, sides
from voxelweave.sources.scratch import cut

#: Rounds in which faces that overlap form charts of their own.
PEELS = 3
#: Share of a face's size by which two faces must overlap to count.
TOUCH = 1e-9


def laid_flat(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the way that they look (0 to 5: +x, -x, +y, -y, +z, -z) and their corners on the plane across it (a_u, a_v, ..). Faces
    without an area look along x."""
    n = G.cross(G.sub(G.vec("b"), G.vec("a")), G.sub(G.vec("c"), G.vec("a")))
    f = cornered(faces, vertices).withColumns({f"n{k}": x for k, x in zip("xyz", n, strict=True)})
    size = [F.abs(F.col(f"n{k}")) for k in "xyz"]
    axis = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    f = f.withColumn("axis", axis)
    along = F.when(F.col("axis") == 0, F.col("nx")).when(F.col("axis") == 1, F.col("ny")).otherwise(F.col("nz"))
    f = f.withColumn("way", 2 * F.col("axis") + (along < 0).cast("int"))
    u = lambda s: F.when(F.col("axis") == 0, F.col(f"{s}y")).otherwise(F.col(f"{s}x"))
    v = lambda s: F.when(F.col("axis") == 2, F.col(f"{s}y")).otherwise(F.col(f"{s}z"))
    return f.select("mesh_id", "fid", "i0", "i1", "i2", "way", *[g(s).alias(f"{s}_{k}") for s in "abc" for k, g in (("u", u), ("v", v))])


def neighbours(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b): faces that share an edge, a chain for an edge of more than two."""
    s = sides(faces).select("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "fid")
    ends = s.groupBy("mesh_id", "lo", "hi").agg(F.min("fid").alias("b"), F.max("fid").alias("a"), F.count("*").alias("n"))
    two = ends.where("n > 1").select("mesh_id", "a", "b")
    more = ends.where("n > 2").join(s, ["mesh_id", "lo", "hi"]).select("mesh_id", F.col("fid").alias("a"), "b")  # an edge that many faces share: all hang on the first
    return two.unionByName(more).where("a <> b").distinct()


def _grown(flat: DataFrame, beside: DataFrame, small: bool = False) -> DataFrame:
    """(mesh_id, fid, chart): connected faces of one way; the chart is its smallest face. small: no mesh is too large for one task."""
    way = flat.select("mesh_id", "fid", "way")
    links = beside.join(way.select("mesh_id", F.col("fid").alias("a"), F.col("way").alias("wa")), ["mesh_id", "a"]).join(way.select("mesh_id", F.col("fid").alias("b"), F.col("way").alias("wb")), ["mesh_id", "b"]).where("wa = wb")
    roots = connected(links.select("mesh_id", "a", "b"), "mesh_id", together=small).withColumnRenamed("node", "fid")
    return way.join(roots, ["mesh_id", "fid"], "left").select("mesh_id", "fid", F.coalesce("root", "fid").alias("chart"))


def _crossing(p: str, q: str) -> Column:
    """Whether two triangles of the plane (columns p.a_u .. and q.a_u ..) overlap by more than a touch: no side of either separates them."""
    at = lambda t, s: (F.col(f"{t}.{s}_u"), F.col(f"{t}.{s}_v"))
    apart = F.lit(False)
    for t in (p, q):
        for i, j in (("a", "b"), ("b", "c"), ("c", "a")):
            (xu, xv), (yu, yv) = at(t, i), at(t, j)
            nu, nv = yv - xv, xu - yu
            on = [[pu * nu + pv * nv for pu, pv in (at(o, s) for s in "abc")] for o in (p, q)]
            gap = F.greatest(F.least(*on[0]) - F.greatest(*on[1]), F.least(*on[1]) - F.greatest(*on[0]))
            apart = apart | (gap >= -TOUCH * (F.abs(nu) + F.abs(nv)) * F.col(f"{t}.size"))
    return ~apart


def overlaps(charted: DataFrame) -> DataFrame:
    """(mesh_id, fid): of every two faces of a chart that overlap when laid flat the one with the larger fid. charted: mesh_id, chart, fid and
    corners. A face lies in the at most four cells of its own size, and looks for others there and in the cells of all larger sizes that its
    mesh has, so a pair meets once a cell of the larger one, however their sizes differ."""
    us, vs = ([F.col(f"{s}_{k}") for s in "abc"] for k in "uv")
    size = F.greatest(F.greatest(*us) - F.least(*us), F.greatest(*vs) - F.least(*vs))
    level = F.ceil(F.log2(F.greatest(size, F.lit(1e-12)))).cast("int")
    f = charted.withColumns({"size": size, "level": level})
    cells = lambda lo, hi, step: F.sequence(F.floor(lo / step), F.floor(hi / step))
    box = lambda step: [cells(F.least(*c), F.greatest(*c), step) for c in (us, vs)]
    own = F.pow(F.lit(2.0), F.col("level"))
    body = F.struct("fid", "size", *[f"{s}_{k}" for s in "abc" for k in "uv"])
    cu, cv = box(own)
    host = f.select("mesh_id", "chart", "level", body.alias("q"), F.explode(cu).alias("cu"), cv.alias("_v")).select("mesh_id", "chart", "level", "q", "cu", F.explode("_v").alias("cv"))
    levels = f.groupBy("mesh_id", "chart").agg(F.array_sort(F.collect_set("level")).alias("levels"))  # some tens at most
    seeks = f.join(levels, ["mesh_id", "chart"]).select("mesh_id", "chart", body.alias("p"), F.col("level").alias("_own"), F.explode("levels").alias("level"), *[f"{s}_{k}" for s in "abc" for k in "uv"]).where("level >= _own")
    cu, cv = box(F.pow(F.lit(2.0), F.col("level")))
    seeks = seeks.select("mesh_id", "chart", "level", "_own", "p", F.explode(cu).alias("cu"), cv.alias("_v")).select("mesh_id", "chart", "level", "_own", "p", "cu", F.explode("_v").alias("cv"))
    met = seeks.join(host, ["mesh_id", "chart", "level", "cu", "cv"]).where((F.col("_own") < F.col("level")) | (F.col("p.fid") < F.col("q.fid")))
    # in an aggregate, where common parts are worked out once
    later = F.greatest("p.fid", "q.fid")
    return met.groupBy("mesh_id", later.alias("fid")).agg(F.max(_crossing("p", "q")).alias("met")).where("met").select("mesh_id", "fid")


def charts(faces: DataFrame, vertices: DataFrame, peels: int = PEELS) -> DataFrame:
    """(mesh_id, fid, i0, i1, i2, chart, way, corners): each face in a chart, named by its smallest face, in which no two overlap."""
    flat = cut(laid_flat(faces, vertices), "flat")
    beside = cut(neighbours(faces), "beside")
    done, left = None, flat
    for peel in range(peels + 1):
        mine = beside if not peel else beside.join(left.select("mesh_id", F.col("fid").alias("a")), ["mesh_id", "a"], "left_semi").join(left.select("mesh_id", F.col("fid").alias("b")), ["mesh_id", "b"], "left_semi")
        grown = cut(left.join(_grown(left, mine), ["mesh_id", "fid"]), "charts")
        out = cut(overlaps(grown), "overlaps")
        stay = grown.join(out, ["mesh_id", "fid"], "left_anti")
        done = stay if done is None else done.unionByName(stay)
        if not out.limit(1).count():
            return done
        left = cut(flat.join(out, ["mesh_id", "fid"], "left_semi"), "left")
    return done.unionByName(left.withColumn("chart", F.col("fid")).select(*done.columns))


def boxes(charted: DataFrame) -> DataFrame:
    """(mesh_id, chart, u0, v0, w, h): where each chart lies on its plane."""
    edge = {f"{n}{k}": f(*[F.col(f"{s}_{k}") for s in "abc"]) for k in "uv" for n, f in (("lo", F.least), ("hi", F.greatest))}
    b = charted.withColumns(edge).groupBy("mesh_id", "chart").agg(F.min("lou").alias("u0"), F.min("lov").alias("v0"), F.max("hiu").alias("u1"), F.max("hiv").alias("v1"))
    return b.select("mesh_id", "chart", "u0", "v0", (F.col("u1") - F.col("u0")).alias("w"), (F.col("v1") - F.col("v0")).alias("h"))


def packed(box: DataFrame, resolution: int = 2048, gutter: int = 4) -> DataFrame:
    """box with the place of each chart's corner and the scale (at_u, at_v, scale) in the unit square of its mesh, and the gutter in texels
    that the packing leaves. A mesh's charts stand in the order of their heights; what is summed over a whole mesh is a row for each chart."""
    w = Window.partitionBy("mesh_id").orderBy(F.col("h").desc(), "chart")
    total = box.groupBy("mesh_id").agg(F.sum(F.col("w") * F.col("h")).alias("area"), F.max("w").alias("mw"), F.max("h").alias("mh"), F.sum("w").alias("sw"))
    # about the side of the atlas, from which the gutter in the mesh's own units follows
    side = F.greatest(F.sqrt(F.col("area")) * 1.2, F.col("mw"), F.col("mh"))
    p = box.join(total.select("mesh_id", (side * (gutter / resolution)).alias("pad")), "mesh_id").withColumns({"_w": F.col("w") + F.col("pad"), "_h": F.col("h") + F.col("pad")})
    length = p.groupBy("mesh_id").agg(F.greatest(F.sqrt(F.sum(F.col("_w") * F.col("_h"))), F.max("_w")).alias("length"))
    before = F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = p.join(length, "mesh_id").withColumn("_at", before)
    p = p.withColumn("shelf", F.when(F.col("length") > 0, F.floor(F.col("_at") / F.col("length"))).otherwise(0)).withColumn("x", F.col("_at") - F.col("shelf") * F.col("length"))
    heights = p.groupBy("mesh_id", "shelf").agg(F.max("_h").alias("sh"), F.max(F.col("x") + F.col("_w")).alias("sx"))
    below = F.coalesce(F.sum("sh").over(Window.partitionBy("mesh_id").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    heights = heights.withColumn("y", below)
    size = heights.groupBy("mesh_id").agg(F.greatest(F.max(F.col("y") + F.col("sh")), F.max("sx")).alias("size"))
    p = p.join(heights.select("mesh_id", "shelf", "y"), ["mesh_id", "shelf"]).join(size, "mesh_id")
    scale = F.when(F.col("size") > 0, 1 / F.col("size")).otherwise(1.0)
    return p.select("mesh_id", "chart", "u0", "v0", "w", "h", ((F.col("x") + F.col("pad") / 2) * scale).alias("at_u"), ((F.col("y") + F.col("pad") / 2) * scale).alias("at_v"), scale.alias("scale"), (F.col("pad") * scale * resolution).alias("gutter"))


def unwrap(faces: DataFrame, vertices: DataFrame, resolution: int = 2048, gutter: int = 4) -> tuple[DataFrame, DataFrame]:
    """(corners, metrics). corners: mesh_id, fid, corner, vid, chart, u, v of every face's corners in [0, 1]; no two faces overlap. metrics:
    mesh_id, charts, share of the atlas that faces cover, and the gutter between charts in texels."""
    c = cut(charts(faces, vertices), "charted")
    at = cut(packed(boxes(c), resolution, gutter), "packed")
    three = F.array(*[F.struct(F.lit(k).alias("corner"), F.col(f"i{k}").alias("vid"), F.col(f"{s}_u").alias("_u"), F.col(f"{s}_v").alias("_v")) for k, s in enumerate("abc")])
    rows = c.select("mesh_id", "fid", "chart", F.inline(three)).join(at, ["mesh_id", "chart"])
    place = lambda k: (F.col(f"at_{k}") + (F.col(f"_{k}") - F.col(f"{k}0")) * F.col("scale")).alias(k)
    corners = rows.select("mesh_id", "fid", "corner", "vid", "chart", place("u"), place("v"))
    area = F.abs((F.col("b_u") - F.col("a_u")) * (F.col("c_v") - F.col("a_v")) - (F.col("b_v") - F.col("a_v")) * (F.col("c_u") - F.col("a_u"))) / 2
    covered = c.join(at.select("mesh_id", "chart", "scale"), ["mesh_id", "chart"]).groupBy("mesh_id").agg(F.sum(area * F.col("scale") * F.col("scale")).alias("utilization"))
    metrics = at.groupBy("mesh_id").agg(F.count("*").alias("charts"), F.min("gutter").alias("gutter")).join(covered, "mesh_id").select("mesh_id", "charts", "utilization", "gutter")
    return corners, metrics


def split_seams(corners: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): a vertex for each chart that it is in, with u and v, all other columns copied; the first keeps its number, the others
    get new ones after the mesh's last. vertices: mesh_id, vid and whatever else; the number of charts around a vertex is small."""
    copies = corners.groupBy("mesh_id", "vid", "chart").agg(F.min("u").alias("u"), F.min("v").alias("v"))
    first = copies.groupBy("mesh_id", "vid").agg(F.min("chart").alias("_first"))
    last = vertices.groupBy("mesh_id").agg(F.max("vid").alias("_last"))
    marked = copies.join(first, ["mesh_id", "vid"])
    extra = marked.where(F.col("chart") != F.col("_first"))
    # numbers by blocks of vertices: counts of a block, then places inside it
    block = F.expr("vid div 4096")
    counts = extra.groupBy("mesh_id", block.alias("_block")).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("mesh_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = extra.withColumn("_block", block).join(counts.withColumn("_before", before), ["mesh_id", "_block"]).join(last, "mesh_id")
    nth = F.row_number().over(Window.partitionBy("mesh_id", "_block").orderBy("vid", "chart"))
    extra = extra.withColumn("new_vid", F.col("_last") + F.col("_before") + nth)
    ids = marked.where(F.col("chart") == F.col("_first")).withColumn("new_vid", F.col("vid")).select("mesh_id", "vid", "chart", "u", "v", "new_vid").unionByName(extra.select("mesh_id", "vid", "chart", "u", "v", "new_vid"))
    ids = cut(ids, "split")
    out = vertices.join(ids.drop("chart"), ["mesh_id", "vid"]).drop("vid").withColumnRenamed("new_vid", "vid")
    at = corners.select("mesh_id", "fid", "corner", "vid", "chart").join(ids.select("mesh_id", "vid", "chart", "new_vid"), ["mesh_id", "vid", "chart"])
    faces = at.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("corner") == k, F.col("new_vid"))).alias(f"i{k}") for k in range(3)])
    return out.select("mesh_id", "vid", *[c for c in out.columns if c not in ("mesh_id", "vid")]), faces
