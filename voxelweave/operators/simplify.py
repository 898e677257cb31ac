"""Mesh simplification by error quadrics: rounds of independent edge collapses, each a handful of joins.

Tables hold many meshes: vertices (mesh_id, vid, x, y, z), faces (mesh_id, fid, i0, i1, i2). Every vertex carries the quadric of the planes
around it, weighted by area, and of planes that stand on its border edges; moving vertex a onto its neighbour b costs a's quadric at b's place,
the mean square of the distances to those planes. In a round

* every vertex that may go picks its cheapest neighbour: not one with which it has more common neighbours than common faces (that would
  pinch the surface), nor, for a vertex on a border, one that is not along the border; a locked vertex picks none;
* picks that would turn a face over are dropped;
* of picks that would touch each other's vertices the cheaper one stays, which every pick can tell from its own surroundings: the two
  vertices of a pick must lie in no ring of a cheaper pick, and its own ring must hold no vertex of one;
* what stays collapses: faces are renamed or vanish, b takes over a's quadric.

The vertices that are left are vertices of the input, so all their attributes stay as they are. Joins are on (mesh_id, vertex), so one large
mesh is spread over the cluster as well as many small ones, and a round reads nothing but its own mesh's neighbourhoods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import geometry as G
from voxelweave.sources.scratch import cut, discard, fresh

#: The ten sums of a quadric, and its weight.
Q = ["qxx", "qxy", "qxz", "qxd", "qyy", "qyz", "qyd", "qzz", "qzd", "qdd", "qw"]
#: Weight of a border edge's plane.
BORDER = 10.0
#: Least cosine between a face's normals before and after.
TURN = 0.25
#: Whether both sides of a join must be dealt by all of its keys.
SUBSET = "spark.sql.requireAllClusterKeysForCoPartition"


#: A plane: its unit normal, distance and weight.
PLANE = ["nx", "ny", "nz", "d", "w"]


def _plane(n: tuple[Column, Column, Column], at: tuple[Column, Column, Column], weight: Column) -> list[Column]:
    return [c.alias(k) for k, c in zip(PLANE, (*n, -G.dot(n, at), weight), strict=True)]


def _summed(planes: DataFrame, here: bool = False) -> DataFrame:
    """(mesh_id, vid, Q) of planes at vertices. Planes are dealt out as five numbers; products of them are made where they are summed. here:
    they lie by mesh already."""
    x, y, z, d, w = (F.col(k) for k in PLANE)
    products = dict(zip(Q, (x * x, x * y, x * z, x * d, y * y, y * z, y * d, z * z, z * d, d * d, F.lit(1.0)), strict=True))
    dealt = planes if here else planes.repartition("mesh_id", "vid")
    return dealt.groupBy("mesh_id", "vid").agg(*[F.sum(w * p).alias(k) for k, p in products.items()])


def cornered(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the places of their corners (ax .. cz)."""
    out = faces
    for k, s in enumerate("abc"):
        out = out.join(vertices.select("mesh_id", F.col("vid").alias(f"i{k}"), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]), ["mesh_id", f"i{k}"])
    return out


def sides(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, a, b, c): the three directed sides of each face with the corner opposite."""
    three = F.array(*[F.struct(F.col(f"i{i}").alias("a"), F.col(f"i{j}").alias("b"), F.col(f"i{k}").alias("c")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))])
    return faces.select("mesh_id", "fid", F.inline(three))


def edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, n): edges and how many faces have them; two inside, one on a border."""
    return sides(faces).groupBy("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"))


def quadrics(vertices: DataFrame, faces: DataFrame, together: bool = False) -> DataFrame:
    """vertices with their quadrics, in coordinates from the middle of the mesh's box (lx, ly, lz), and the box's squared radius (r2).
    together: rows lie by mesh and stay there, as those of a union would not."""
    box = vertices.groupBy("mesh_id").agg(*[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xyz"]).join(radii(vertices), "mesh_id")
    local = vertices.join(box, "mesh_id").select("mesh_id", "vid", *[(F.col(c) - F.col(f"m{c}")).alias(f"l{c}") for c in "xyz"], "r2")
    f = cornered(faces, local.select("mesh_id", "vid", *[F.col(f"l{c}").alias(c) for c in "xyz"]))
    a, b, c = (G.vec(s) for s in "abc")
    f = f.withColumns({f"n{k}": x for k, x in zip("xyz", G.cross(G.sub(b, a), G.sub(c, a)), strict=True)})
    f = f.withColumn("size", G.length(G.vec("n"))).where("size > 0")
    unit = tuple(F.col(f"n{k}") / F.col("size") for k in "xyz")
    of_faces = f.select(F.array("i0", "i1", "i2").alias("vids"), "mesh_id", *_plane(unit, a, F.col("size") / 2))
    # a border edge with the third corner of its face, as a triangle
    once = sides(faces).groupBy("mesh_id", F.least("a", "b").alias("i0"), F.greatest("a", "b").alias("i1")).agg(F.count("*").alias("n"), F.min("c").alias("i2")).where("n = 1").drop("n")
    border = cornered(once, local.select("mesh_id", "vid", *[F.col(f"l{c}").alias(c) for c in "xyz"]))
    way = G.sub(b, a)
    border = border.withColumns({f"n{k}": x for k, x in zip("xyz", G.cross(way, G.sub(c, a)), strict=True)}).withColumn("area", G.length(G.vec("n"))).where("area > 0")
    border = border.withColumns({f"w{k}": x for k, x in zip("xyz", G.cross(way, tuple(F.col(f"n{k}") / F.col("area") for k in "xyz")), strict=True)}).withColumn("size", G.length(G.vec("w"))).where("size > 0")
    stands = tuple(F.col(f"w{k}") / F.col("size") for k in "xyz")
    of_borders = border.select(F.array("i0", "i1").alias("vids"), "mesh_id", *_plane(stands, a, BORDER * F.col("size") * F.col("size")))
    if together:
        f, b = (_summed(p.select("mesh_id", F.explode("vids").alias("vid"), *PLANE), here=True) for p in (of_faces, of_borders))
        both = f.join(b.select("mesh_id", "vid", *[F.col(k).alias(f"_{k}") for k in Q]), ["mesh_id", "vid"], "left")  # a border's face has an area too
        return local.join(both.select("mesh_id", "vid", *[(F.col(k) + F.coalesce(f"_{k}", F.lit(0.0))).alias(k) for k in Q]), ["mesh_id", "vid"])
    planes = of_faces.unionByName(of_borders).select("mesh_id", F.explode("vids").alias("vid"), *PLANE)
    return local.join(_summed(planes), ["mesh_id", "vid"])  # unused vertices go


def error_at(x: Column, y: Column, z: Column) -> Column:
    """Mean square distance of a place to the planes of a quadric (columns Q)."""
    q = {k: F.col(k) for k in Q}
    r = q["qxx"] * x * x + q["qyy"] * y * y + q["qzz"] * z * z + q["qdd"] + 2 * (q["qxy"] * x * y + q["qxz"] * x * z + q["qyz"] * y * z + q["qxd"] * x + q["qyd"] * y + q["qzd"] * z)
    return F.abs(r) / q["qw"]


def picks(state: DataFrame, faces: DataFrame, target_error: float, lock_border: bool = False, salt: int = 0, place=lambda df: df) -> DataFrame:
    """(mesh_id, a, b, cost): the cheapest collapse of each vertex that may go, faces unturned, at a distance of at most a share of the mesh's
    radius. A salt leaves out a third of the edges, another third for another salt. place deals out what was written on the way."""
    e = edges(faces)
    ends = e.select("mesh_id", F.explode(F.array("lo", "hi")).alias("vid"), "n")
    kinds = ends.groupBy("mesh_id", "vid").agg(F.max(F.col("n") == 1).alias("border"), (F.max(F.col("n") > 2) | (F.count_if(F.col("n") == 1) > 2)).alias("locked"), F.count("*").alias("valence"))
    s = sides(faces)
    ways = e.select("mesh_id", F.inline(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))), "n")
    here = state.select("mesh_id", F.col("vid").alias("a"), "r2", *Q)
    there = state.select("mesh_id", F.col("vid").alias("b"), "lx", "ly", "lz")
    ka = kinds.select("mesh_id", F.col("vid").alias("a"), F.col("border").alias("ba"), F.col("locked").alias("la"), F.col("valence").alias("va"))
    kb = kinds.select("mesh_id", F.col("vid").alias("b"), F.col("valence").alias("vb"))
    may = ways if not salt else ways.where(F.pmod(F.col("a") + 7 * F.col("b") + salt, F.lit(3)) != 0)
    # what b adds is small and comes first; a's quadric then meets the edges where they are grouped by a, and is not dealt out again
    may = may.join(kb.join(there, ["mesh_id", "b"]), ["mesh_id", "b"])
    may = may.join(ka.join(here, ["mesh_id", "a"]), ["mesh_id", "a"]).where(~F.col("la") & (~F.col("ba") | ((F.col("n") == 1) & F.lit(not lock_border))) & ~((F.col("va") == 3) & (F.col("vb") == 3)))
    may = may.withColumn("cost", error_at(F.col("lx"), F.col("ly"), F.col("lz"))).where(F.col("cost") <= target_error * target_error * F.col("r2"))
    best = may.groupBy("mesh_id", "a").agg(F.min(F.struct("cost", "b", "n")).alias("m")).select("mesh_id", "a", "m.b", "m.cost", "m.n")
    best = place(cut(best, "picks"))
    # neighbours of both ends of the pick against the faces that it has
    near = ways.select("mesh_id", "a", F.col("b").alias("c"))
    of_b = ways.select("mesh_id", F.col("a").alias("b"), F.col("b").alias("c"), F.lit(1).alias("_both"))
    common = best.join(near, ["mesh_id", "a"]).join(of_b, ["mesh_id", "b", "c"]).groupBy("mesh_id", "a").agg(F.count("*").alias("common"))
    good = best.join(common, ["mesh_id", "a"]).where("common = n").drop("common")
    # the faces around a that don't hold b, before and after
    around = s.select("mesh_id", "a", F.col("b").alias("p"), F.col("c").alias("q"))
    # the places of a pick's own ends come first, when there is one row for each pick
    at = lambda k: state.select("mesh_id", F.col("vid").alias(k), *[F.col(f"l{c}").alias(f"{k}{c}") for c in "xyz"])
    rest = good.select("mesh_id", "a", "b").join(at("b"), ["mesh_id", "b"]).join(at("a"), ["mesh_id", "a"]).join(around, ["mesh_id", "a"]).where("p <> b AND q <> b").drop("b")
    for k in "pq":
        rest = rest.join(at(k), ["mesh_id", k]).drop(k)
    a, b, p, q = (G.vec(k) for k in "abpq")
    for name, v in (("u", G.cross(G.sub(p, a), G.sub(q, a))), ("v", G.cross(G.sub(p, b), G.sub(q, b)))):
        rest = rest.withColumns({f"{name}{c}": x for c, x in zip("xyz", v, strict=True)})
    turned = rest.groupBy("mesh_id", "a").agg(F.max(G.dot(G.vec("u"), G.vec("v")) <= TURN * G.length(G.vec("u")) * G.length(G.vec("v"))).alias("turned"))
    return good.join(turned, ["mesh_id", "a"], "left").where("NOT coalesce(turned, false)").select("mesh_id", "a", "b", "cost")


def independent(picked: DataFrame, faces: DataFrame) -> DataFrame:
    """Of picks that touch each other's vertices the cheapest; equal costs, as on flat parts, go by a scattered order, so that no long chain
    of neighbours waits for its first."""
    scattered = (F.pmod("a", F.lit(1_000_003)) * 48_271) % 65_521
    own = F.struct("cost", scattered.alias("s"), "a").alias("rank")
    ring = sides(faces).select("mesh_id", "a", F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    rings = picked.select("mesh_id", "a", own).join(ring, ["mesh_id", "a"])
    in_ring = rings.groupBy("mesh_id", "v").agg(F.min("rank").alias("best"))
    at_end = picked.select("mesh_id", F.explode(F.array("a", "b")).alias("v"), own).groupBy("mesh_id", "v").agg(F.min("rank").alias("best"))
    hidden = picked.select("mesh_id", "a", own, F.explode(F.array("a", "b")).alias("v")).join(in_ring, ["mesh_id", "v"]).where("best < rank").select("mesh_id", "a")
    crossed = rings.join(at_end, ["mesh_id", "v"]).where("best < rank").select("mesh_id", "a")
    return picked.join(hidden.distinct(), ["mesh_id", "a"], "left_anti").join(crossed.distinct(), ["mesh_id", "a"], "left_anti")


def _filled(rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the bins that fit into what is left of each mesh's need, and those of the bin in which it ends, with what is then left."""
    rows = rows.withColumn("_bin", key)
    counts = rows.groupBy("mesh_id", "_bin").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("mesh_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bin
    placed = rows.join(counts.withColumn("_before", before), ["mesh_id", "_bin"]).withColumn("_ends", F.col("_before") + F.col("_k"))
    end = placed.where("_before < collapses AND _ends > collapses").withColumn("collapses", F.col("collapses") - F.col("_before"))
    return placed.where("_ends <= collapses").drop("_bin", "_k", "_before", "_ends"), end.drop("_bin", "_k", "_before", "_ends")


def within_need(chosen: DataFrame, need: DataFrame) -> DataFrame:
    """Of each mesh as many picks as it needs (mesh_id, collapses), the cheapest to a sixteenth of an octave. Bins of the cost are counted
    first, then bins of a hash inside the last one, so a mesh's picks never meet in one task; what is ranked row by row is one such bin."""
    low, rest = _filled(chosen.join(need, "mesh_id"), F.floor(F.log2(F.greatest(F.col("cost"), F.lit(1e-300))) * 16))
    some, rest = _filled(rest, F.pmod(F.xxhash64("a"), F.lit(4096)))
    last = rest.withColumn("_r", F.row_number().over(Window.partitionBy("mesh_id").orderBy("cost", "a"))).where("_r <= collapses")
    return low.select(*chosen.columns).unionByName(some.select(*chosen.columns)).unionByName(last.select(*chosen.columns))


def collapsed(state: DataFrame, faces: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, faces) after the chosen collapses."""
    moves = chosen.select("mesh_id", F.col("a").alias("_a"), F.col("b").alias("_b"))
    out = faces
    for k in range(3):
        m = moves.select(F.col("mesh_id").alias("_m"), "_a", "_b")
        out = out.join(m, (F.col("mesh_id") == F.col("_m")) & (F.col(f"i{k}") == F.col("_a")), "left").withColumn(f"i{k}", F.coalesce("_b", f"i{k}")).drop("_m", "_a", "_b")
    out = out.where("i0 <> i1 AND i1 <> i2 AND i0 <> i2").select("mesh_id", "fid", "i0", "i1", "i2")
    moved = state.join(moves.withColumnRenamed("_a", "vid"), ["mesh_id", "vid"], "left").withColumn("_to", F.coalesce("_b", "vid"))
    sums = moved.groupBy("mesh_id", F.col("_to").alias("vid")).agg(*[F.sum(k).alias(k) for k in Q], *[F.max(F.when(F.col("_b").isNull(), F.col(f"l{c}"))).alias(f"l{c}") for c in "xyz"], F.max("r2").alias("r2"))
    return sums.select("mesh_id", "vid", "lx", "ly", "lz", "r2", *Q), out


def radii(vertices: DataFrame) -> DataFrame:
    """(mesh_id, r2): the squared radius of each mesh's box."""
    box = vertices.groupBy("mesh_id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"])
    return box.select("mesh_id", ((F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / 4).alias("r2"))


def one_round(vertices: DataFrame, faces: DataFrame, target_error: float = 0.01, lock_border: bool = False, together: bool = False) -> DataFrame:
    """Faces after one round from the input, without a target. together: meshes are small, so each stays in one task throughout, and no join
    moves a row; the result is then a written table."""
    if not together:
        state = cut(quadrics(vertices, faces), "quadrics")
        chosen = independent(cut(picks(state, faces, target_error, lock_border), "good"), faces)
        return collapsed(state, faces, chosen)[1]
    spark = faces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_mesh = lambda df: df.repartition(n, "mesh_id")
    before = spark.conf.get(SUBSET)
    spark.conf.set(SUBSET, "false")  # rows that lie by mesh need not move for a join on mesh and vertex
    try:
        vertices, faces = by_mesh(vertices), by_mesh(faces)
        state = by_mesh(cut(quadrics(vertices, faces, together=True), "quadrics"))
        chosen = independent(by_mesh(cut(picks(state, faces, target_error, lock_border, place=by_mesh), "good")), faces)
        return cut(collapsed(state, faces, chosen)[1], "round")
    finally:
        spark.conf.set(SUBSET, before)


def simplify(vertices: DataFrame, faces: DataFrame, target: int = 25_000, least: int = 5_000, target_error: float = 0.01, lock_border: bool = False, share: float = 0.5, rounds: int = 400) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, metrics): every mesh reduced to at most max(target, least) faces, or one more collapse than that, or as far as the
    error allows; smaller ones stay. In a round the cheapest `share` of a mesh's picks take part. metrics: mesh_id, input and output counts and
    the largest error, relative to the radius of the mesh."""
    goal = max(target, least)
    start = faces.groupBy("mesh_id").agg(F.count("*").alias("input_faces"))
    big = start.where(F.col("input_faces") > goal).select("mesh_id")
    at = cut(faces.join(big, "mesh_id", "left_semi").select("mesh_id", "fid", "i0", "i1", "i2"), "faces")
    state = cut(quadrics(vertices.join(big, "mesh_id", "left_semi"), at), "quadrics")
    log, idle, salt = fresh(faces.sparkSession, "collapses"), 0, 0
    for nth in range(rounds):
        need = at.groupBy("mesh_id").agg(F.ceil((F.count("*") - goal) / 2).alias("collapses")).where("collapses > 0")
        live = at.join(need, "mesh_id", "left_semi")
        good = cut(picks(state, live, target_error, lock_border, salt), "good")
        some = good
        if share < 1 and not idle:
            cheap = good.groupBy("mesh_id").agg(F.percentile_approx("cost", F.lit(share), F.lit(1000)).alias("_most"))
            some = good.join(cheap, "mesh_id").where("cost <= _most").drop("_most")
        chosen = cut(within_need(independent(some, live), need), "chosen", f"{log}/nth={nth}")
        n = chosen.count()
        if not n:
            if idle == 3 or not live.limit(1).count():  # all edges, then each two thirds of them
                break
            idle, salt = idle + 1, idle + 1
            continue
        idle, salt = 0, 0 if salt == 0 else nth % 3 + 1
        new_state, new_faces = collapsed(state, at, chosen)
        old, (state, at) = (state, at), (cut(new_state, "quadrics"), cut(new_faces, "faces"))
        for table in (*old, good):
            discard(table)
    out = cut(at.unionByName(faces.join(big, "mesh_id", "left_anti").select(*at.columns)), "simplified")
    used = out.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid")).distinct()
    kept = vertices.join(used, ["mesh_id", "vid"], "left_semi")
    sizes = start.join(vertices.groupBy("mesh_id").agg(F.count("*").alias("input_vertices")), "mesh_id", "left")
    sizes = sizes.join(out.groupBy("mesh_id").agg(F.count("*").alias("output_faces")), "mesh_id", "left").join(used.groupBy("mesh_id").agg(F.count("*").alias("output_vertices")), "mesh_id", "left")
    radius = radii(vertices).withColumnRenamed("r2", "_r")
    worst = faces.sparkSession.read.schema("mesh_id long, a long, b long, cost double").option("recursiveFileLookup", "true").parquet(log)
    sizes = sizes.join(worst.groupBy("mesh_id").agg(F.max("cost").alias("worst")), "mesh_id", "left").join(radius, "mesh_id", "left").withColumn("result_error", F.when(F.col("_r") > 0, F.sqrt(F.coalesce("worst", F.lit(0.0)) / F.col("_r"))).otherwise(0.0))
    return kept, out, sizes.select("mesh_id", "input_faces", "input_vertices", F.coalesce("output_faces", F.lit(0)).alias("output_faces"), F.coalesce("output_vertices", F.lit(0)).alias("output_vertices"), "result_error")


def drawn_in_order(faces: DataFrame, vertices: DataFrame, bits: int = 10) -> DataFrame:
    """(mesh_id, fid, place): an order of drawing in which neighbours follow each other, so that a cache of vertices is hit: faces by the
    Morton code of their middle in the mesh's box. place is a key to sort by, not a number without gaps."""
    box = vertices.groupBy("mesh_id").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    f = cornered(faces, vertices).join(box, "mesh_id")
    cell = {}
    for c in "xyz":
        span = F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}")).otherwise(1.0)
        cell[c] = F.least(F.lit((1 << bits) - 1), F.floor(((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 - F.col(f"lo{c}")) / span * (1 << bits))).cast("long")
    code = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate("xyz"):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(cell[c], i).bitwiseAND(F.lit(1)), 3 * i + k))
    return f.select("mesh_id", "fid", code.alias("place"))
