"""Triangle meshes as vertices and faces: validity, clean-up, normals, occlusion and atlas coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import geometry as G
from voxelweave.operators.sync import by_range, numbered


def _frame(*tables: DataFrame) -> list[str]:
    """The frame as a column to join on, if all tables have it: then faces have vertices of their own frame only, and rows stay where they are."""
    return ["frame_id"] if all("frame_id" in t.columns for t in tables) else []


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the places of their three corners (a*, b*, c*)."""
    out, on = faces, _frame(faces, vertices)
    for k, s in enumerate("abc"):
        v = vertices.select(*on, F.col("vid").alias(f"i{k}"), *[F.col(c).alias(f"{s}{c}") for c in "xyz"])
        out = out.join(v, [*on, f"i{k}"])
    return out


def _normal():
    a, b, c = (G.vec(s) for s in "abc")
    return G.cross(G.sub(b, a), G.sub(c, a))


def degenerate(faces: DataFrame, vertices: DataFrame, least: float = 1e-12) -> DataFrame:
    """Faces that repeat a vertex or have no area."""
    n = G.length(_normal())
    twice = (F.col("i0") == F.col("i1")) | (F.col("i1") == F.col("i2")) | (F.col("i0") == F.col("i2"))
    return with_corners(faces, vertices).where(twice | (n < least)).select("fid")


def clean(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return faces.join(degenerate(faces, vertices), "fid", "left_anti")


def validity(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(faces, vertices, dangling corners, valid): a mesh is valid if it has both and every corner exists."""
    corners = faces.select("fid", F.explode(F.array("i0", "i1", "i2")).alias("vid"))
    dangling = corners.join(vertices.select("vid"), "vid", "left_anti").agg(F.count("*").alias("dangling"))
    sizes = faces.agg(F.count("*").alias("faces")).crossJoin(vertices.agg(F.count("*").alias("vertices"))).crossJoin(dangling)
    return sizes.withColumn("valid", (F.col("faces") > 0) & (F.col("vertices") > 0) & (F.col("dangling") == 0))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit sums of the area-weighted normals around each vertex."""
    n = _normal()
    f = with_corners(faces, vertices).select(F.explode(F.array("i0", "i1", "i2")).alias("vid"), *[x.alias(k) for x, k in zip(n, ("nx", "ny", "nz"), strict=True)])
    s = f.groupBy("vid").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "nz")])
    return s.select("vid", *[x.alias(k) for x, k in zip(G.normalize(G.vec(names=("nx", "ny", "nz"))), ("nx", "ny", "nz"), strict=True)])


def compaction(faces: DataFrame) -> DataFrame:
    """(vid, new_id): used vertices renumbered in the order of their first use, by ranges of that order."""
    corners = faces.select("fid", F.posexplode(F.array("i0", "i1", "i2")).alias("k", "vid"))
    first = corners.groupBy("vid").agg(F.min(3 * F.col("fid") + F.col("k")).alias("first"))  # a number, as rows are sorted for the least of structs
    return numbered(first, "first", "new_id").select("vid", "new_id")


def prefix_sum(rows: DataFrame, order: str | list[str], value: str, out: str) -> DataFrame:
    """Sum of the values before each row in an order over all rows: ranges of the order are summed on their own, then what is before each
    range is added."""
    order = [order] if isinstance(order, str) else order
    dealt = by_range(rows, order)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def compacted(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with new ids and without unused vertices."""
    ids = compaction(faces)
    out = faces
    for k in range(3):
        out = out.join(ids.select(F.col("vid").alias(f"i{k}"), F.col("new_id").alias(f"n{k}")), f"i{k}")
    kept = vertices.join(ids, "vid").select(F.col("new_id").alias("vid"), *[c for c in vertices.columns if c != "vid"])
    return kept, out.select("fid", *[F.col(f"n{k}").alias(f"i{k}") for k in range(3)])


def unwrap(faces: DataFrame, vertices: DataFrame, margin: float = 0.01) -> DataFrame:
    """(fid, corner, vid, chart, u, v): planar charts. A face belongs to the axis and side that its normal is nearest to; the six charts lie
    in the cells of a 3 x 2 grid, each scaled to its own bounds. Stands in for a chart search."""
    n = _normal()
    size = [F.abs(c) for c in n]
    axis = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    f = with_corners(faces, vertices).withColumn("axis", axis)
    facing = F.when(F.col("axis") == 0, n[0]).when(F.col("axis") == 1, n[1]).otherwise(n[2])
    f = f.withColumn("chart", 2 * F.col("axis") + (facing < 0).cast("int"))
    place = lambda s: (F.when(F.col("axis") == 0, F.col(f"{s}y")).otherwise(F.col(f"{s}x")), F.when(F.col("axis") == 2, F.col(f"{s}y")).otherwise(F.col(f"{s}z")))
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), F.col(f"i{k}").alias("vid"), place(s)[0].alias("a"), place(s)[1].alias("b")) for k, s in enumerate("abc")])
    c = f.select("fid", "chart", F.inline(corners))
    box = c.groupBy("chart").agg(*[g(x).alias(f"{m}{x}") for x in "ab" for m, g in (("lo", F.min), ("hi", F.max))])  # six rows at most
    c = c.join(F.broadcast(box), "chart")
    span = lambda x: F.when(F.col(f"hi{x}") > F.col(f"lo{x}"), F.col(f"hi{x}") - F.col(f"lo{x}")).otherwise(1.0)
    cell = lambda x, at, of: (at + margin + (1 - 2 * margin) * (F.col(x) - F.col(f"lo{x}")) / span(x)) / of
    return c.select("fid", "corner", "vid", "chart", cell("a", F.expr("chart div 2"), 3).alias("u"), cell("b", F.col("chart") % 2, 2).alias("v"))


def pipeline(faces: DataFrame, vertices: DataFrame, size: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, metrics): a mesh validated, cleaned, simplified if a cell size is given, compacted, and given normals. metrics has
    a row for each stage with its counts, and the share of faces that are left. What later stages read again is persisted."""
    stages = [("input", vertices, faces)]
    good = clean(faces, vertices).persist()
    stages.append(("clean", vertices, good))
    if size is not None:
        vertices, good = (x.persist() for x in cluster(vertices, good, size))
        stages.append(("simplify", vertices, good))
    vertices, good = (x.persist() for x in compacted(good, vertices))
    vertices = vertices.join(vertex_normals(good, vertices), "vid", "left")
    stages.append(("output", vertices, good))
    rows = None
    for nth, (name, v, f) in enumerate(stages):
        row = validity(f, v.select("vid")).select(F.lit(nth).alias("nth"), F.lit(name).alias("stage"), "vertices", "faces", "valid")
        rows = row if rows is None else rows.unionByName(row)
    first = faces.agg(F.count("*").alias("_first"))
    metrics = rows.crossJoin(F.broadcast(first)).withColumn("kept", F.when(F.col("_first") > 0, F.col("faces") / F.col("_first")).otherwise(0.0)).drop("_first")
    return vertices, good, metrics


def from_flat(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of rows that hold whole meshes: mesh_id, positions (x, y, z one after the other) and indices (three to a face).
    Ids count from 0 in each mesh; what is left over of a last triple is ignored."""
    triples = lambda c: F.transform(F.sequence(F.lit(0), F.expr(f"size({c}) div 3 - 1")), lambda i: F.slice(c, 3 * i + 1, 3))
    v = meshes.where("size(positions) >= 3").select("mesh_id", F.posexplode(triples("positions")).alias("vid", "p"))
    f = meshes.where("size(indices) >= 3").select("mesh_id", F.posexplode(triples("indices")).alias("fid", "i"))
    return v.select("mesh_id", F.col("vid").cast("long").alias("vid"), *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")]), f.select("mesh_id", F.col("fid").cast("long").alias("fid"), *[F.col("i")[k].cast("long").alias(f"i{k}") for k in range(3)])


def to_flat(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row for each mesh, its positions and indices one after the other; the inverse of from_flat(). A row holds a whole mesh, as its
    file does."""
    row = lambda df, key, cols: df.groupBy("mesh_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, F.array(*cols).alias("a")))), lambda r: r["a"])).alias("flat"))
    p = row(vertices, "vid", ["x", "y", "z"]).withColumnRenamed("flat", "positions")
    i = row(faces, "fid", ["i0", "i1", "i2"]).withColumnRenamed("flat", "indices")
    return p.join(i, "mesh_id", "left").select("mesh_id", "positions", F.coalesce("indices", F.array().cast("array<long>")).alias("indices"))


def cluster(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Simplification by grid clustering: vertices of a cell become their mean, faces that collapse go. Stands in for quadric collapse."""
    v = vertices.withColumns({c: F.floor(F.col(n) / size).cast("long") for c, n in zip(("cx", "cy", "cz"), "xyz", strict=True)})
    cells = v.groupBy("cx", "cy", "cz").agg(F.min("vid").alias("new_id"), *[F.avg(c).alias(c) for c in "xyz"])
    remap = v.select("vid", "cx", "cy", "cz").join(cells.select("cx", "cy", "cz", "new_id"), ["cx", "cy", "cz"]).select("vid", "new_id")
    out = faces
    for k in range(3):
        out = out.join(remap.select(F.col("vid").alias(f"i{k}"), F.col("new_id").alias(f"n{k}")), f"i{k}")
    out = out.select("fid", *[F.col(f"n{k}").alias(f"i{k}") for k in range(3)]).where("i0 <> i1 AND i1 <> i2 AND i0 <> i2")
    return cells.select(F.col("new_id").alias("vid"), "x", "y", "z"), out


def occluded(points: DataFrame, faces: DataFrame, vertices: DataFrame, eyes: DataFrame, cell: float = 4.0) -> DataFrame:
    """Points (frame_id, vid, x, y, z) whose segment to their frame's eye (frame_id, ex, ey, ez) meets a face that is not theirs. A segment
    is in the xy cells that it passes, a face in those of its box, so the join is an equi-join; crowded cells are split by AQE. Faces with a
    frame_id hide points of their frame only."""
    at = lambda v: F.floor(v / cell).cast("long")
    corner = lambda c, f: f(*[F.col(f"{s}{c}") for s in "abc"])
    f = with_corners(faces, vertices)
    for g, c in (("gx", "x"), ("gy", "y")):
        f = f.withColumn(g, F.explode(F.sequence(at(corner(c, F.least)), at(corner(c, F.greatest)))))
    p = points.select("frame_id", F.col("vid").alias("pid"), *[F.col(c).alias(f"p{c}") for c in "xyz"]).join(eyes, "frame_id")
    p = p.withColumn("gx", F.explode(F.sequence(at(F.least("px", "ex")), at(F.greatest("px", "ex")))))
    # where the segment enters and leaves the column of cells
    slope = (F.col("ey") - F.col("py")) / F.when(F.col("ex") != F.col("px"), F.col("ex") - F.col("px"))
    low, high = F.greatest(F.col("gx") * cell, F.least("px", "ex")), F.least((F.col("gx") + 1) * cell, F.greatest("px", "ex"))
    y0, y1 = (F.coalesce(F.col("py") + slope * (x - F.col("px")), y) for x, y in ((low, F.col("py")), (high, F.col("ey"))))
    slack = 1e-9 * cell
    p = p.withColumn("gy", F.explode(F.sequence(at(F.least(y0, y1) - slack), at(F.greatest(y0, y1) + slack))))
    o, eye = G.vec("p"), G.vec(names=("ex", "ey", "ez"))
    own = (F.col("pid") == F.col("i0")) | (F.col("pid") == F.col("i1")) | (F.col("pid") == F.col("i2"))
    # cheap tests first: seen from above, the corners must not all lie on one side of the segment, nor the face beside its ends or height
    side = [(F.col(f"{k}x") - F.col("px")) * (F.col("ey") - F.col("py")) - (F.col(f"{k}y") - F.col("py")) * (F.col("ex") - F.col("px")) for k in "abc"]
    across = (F.least(*side) <= 1e-9) & (F.greatest(*side) >= -1e-9)
    for c in "xyz":
        across = across & (corner(c, F.least) <= F.greatest(f"p{c}", f"e{c}")) & (corner(c, F.greatest) >= F.least(f"p{c}", f"e{c}"))
    near = p.join(f, [*_frame(f), "gx", "gy"]).where(~own & across)
    t = G.ray_triangle(o, G.sub(eye, o), G.vec("a"), G.vec("b"), G.vec("c"))
    # in an aggregate, where common parts are worked out once; a filter would be pushed into the join's condition, which has them many times
    met = near.groupBy("frame_id", F.col("pid").alias("vid")).agg(F.max((t > 1e-6) & (t < 1 - 1e-6)).alias("met"))
    return met.where("met").select("frame_id", "vid")


def texel_views(texels: DataFrame, faces: DataFrame, vertices: DataFrame, cameras: DataFrame, least: float = 0.25) -> DataFrame:
    """Each texel with the cameras of its frame that its face looks towards: cosine (n_dot_c) and distance. texels: frame_id, fid, tx, ty,
    w0, w1, w2; cameras: frame_id, camera_index, x, y, z."""
    corners = with_corners(faces, vertices)
    n = G.normalize(_normal())
    on = _frame(corners)
    f = corners.select(*on, "fid", *[F.col(f"{s}{c}") for s in "abc" for c in "xyz"], *[x.alias(k) for x, k in zip(n, ("nx", "ny", "nz"), strict=True)])
    place = [sum((F.col(w) * F.col(f"{s}{c}") for w, s in (("w0", "a"), ("w1", "b"), ("w2", "c"))), F.lit(0.0)).alias(f"p{c}") for c in "xyz"]
    t = texels.join(f, [*on, "fid"]).select("frame_id", "fid", "tx", "ty", "nx", "ny", "nz", *place)
    c = cameras.select("frame_id", "camera_index", *[F.col(k).alias(f"c{k}") for k in "xyz"])
    way = G.sub(G.vec("c"), G.vec("p"))
    seen = G.worked_out(t.join(c, "frame_id"), wx=way[0], wy=way[1], wz=way[2])
    w = G.vec("w")
    seen = G.worked_out(seen, distance=G.length(w), n_dot_c=G.dot(G.vec(names=("nx", "ny", "nz")), G.normalize(w)))
    return seen.where(F.col("n_dot_c") >= least).select("frame_id", "fid", "tx", "ty", "camera_index", "n_dot_c", "distance")


def texels(faces: DataFrame, uv: DataFrame, size: int, eps: float = -1e-3) -> DataFrame:
    """(fid, tx, ty, barycentric weights) of the atlas texels whose centre lies in a face. uv: vid, u, v in [0, 1]. With frame_id in both,
    also that of the face."""
    out, on = faces, _frame(faces, uv)
    for k, s in enumerate("abc"):
        out = out.join(uv.select(*on, F.col("vid").alias(f"i{k}"), (F.col("u") * size).alias(f"{s}u"), (F.col("v") * size).alias(f"{s}v")), [*on, f"i{k}"])
    span = lambda c: F.sequence(F.greatest(F.lit(0), F.floor(F.least(*[F.col(f"{s}{c}") for s in "abc"])).cast("int")), F.greatest(F.lit(0), F.least(F.lit(size - 1), F.ceil(F.greatest(*[F.col(f"{s}{c}") for s in "abc"])).cast("int"))))
    t = out.withColumn("tx", F.explode(span("u"))).withColumn("ty", F.explode(span("v")))
    w = G.barycentric((F.col("tx") + 0.5, F.col("ty") + 0.5), *[(F.col(f"{s}u"), F.col(f"{s}v")) for s in "abc"])
    t = G.worked_out(t, w0=w[0], w1=w[1], w2=w[2]).where((F.col("w0") >= eps) & (F.col("w1") >= eps) & (F.col("w2") >= eps))
    return t.select(*on, "fid", "i0", "i1", "i2", "tx", "ty", "w0", "w1", "w2")
