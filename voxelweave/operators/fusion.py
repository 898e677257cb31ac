"""Depth fusion: unprojection, multi-view consistency, signed-distance folding, surface crossings and marching cubes.

Tables hold many frames (frame_id); cameras, pixels and voxels of a frame meet by equi-joins on frame, camera, pixel and voxel index, so
frames are spread over the cluster and no frame sees another's cameras. A rig has a row for each frame and camera: intrinsics fx, fy, cx,
cy, rotation (rows) and translation from the world to the camera, and optionally the image's width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import geometry as G

#: Corners of a cube cell, and its edges by corner: the usual numbering, fixed values.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))
#: Voxels of a piece of a column: a power of two up to 8.
SPAN = 8


def usable(depth: DataFrame, near: float, far: float) -> DataFrame:
    """Foreground pixels with a depth in range; pixels without a mask count as foreground."""
    return depth.where((F.coalesce(F.col("alpha"), F.lit(255)) >= 128) & F.col("depth").between(near, far))


def unproject(depth: DataFrame, rig: DataFrame, near: float, far: float) -> DataFrame:
    """World points of usable pixels."""
    p = usable(depth, near, far).join(rig, ["frame_id", "camera_index"])
    v = G.unproject(F.col("x"), F.col("y"), F.col("depth"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    t = F.col("translation")
    w = G.rotated(F.col("rotation"), G.sub(v, (t[0], t[1], t[2])), back=True)
    return p.select("frame_id", "camera_index", "x", "y", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"), strict=True)])


def seen_in(points: DataFrame, rig: DataFrame, keep: Column | None = None) -> DataFrame:
    """Each point once for every camera of its frame that has it in front and in the image, with its rounded pixel there (half to even)."""
    r = rig.select("frame_id", *[F.col(c).alias(f"r_{c}") for c in rig.columns if c != "frame_id"])
    t = F.col("r_translation")
    c = G.add(G.rotated(F.col("r_rotation"), G.vec(names=("wx", "wy", "wz"))), (t[0], t[1], t[2]))
    out = points.join(r, "frame_id")
    out = out if keep is None else out.where(keep)
    out = G.worked_out(out, _cx=c[0], _cy=c[1], z=c[2]).where("z > 0")
    u, v = G.project((F.col("_cx"), F.col("_cy"), F.col("z")), F.col("r_fx"), F.col("r_fy"), F.col("r_cx"), F.col("r_cy"))
    out = out.withColumns({"px": F.rint(u).cast("long"), "py": F.rint(v).cast("long")}).drop("_cx", "_cy")
    if "width" in rig.columns:
        out = out.where("px >= 0 AND py >= 0 AND px < r_width AND py < r_height")
    return out


def _met(there: DataFrame, depth: DataFrame, *more: str) -> DataFrame:
    """What seen_in() found, with the foreground depth d at its pixel."""
    d = depth.where("alpha >= 128").select("frame_id", F.col("camera_index").alias("r_camera_index"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("depth").alias("d"), *[F.col(c).alias(f"d_{c}") for c in more])
    return there.join(d, ["frame_id", "r_camera_index", "px", "py"])


def consistency(points: DataFrame, depth: DataFrame, rig: DataFrame, tau: float, least_cos: float | None = None) -> DataFrame:
    """1 plus the other cameras whose depth at the point's pixel agrees within tau; with least_cos, points have a world normal nx, ny, nz and
    a camera counts only if the cosine between it and the way to the camera is no less."""
    agree = _met(seen_in(points, rig, F.col("camera_index") != F.col("r_camera_index")), depth).where(F.abs(F.col("z") - F.col("d")) < tau)
    facing = F.lit(True)
    if least_cos is not None:  # counted in the aggregate, where common parts are worked out once
        way = G.normalize(G.sub(G.camera_position(F.col("r_rotation"), F.col("r_translation")), G.vec(names=("wx", "wy", "wz"))))
        facing = G.dot(G.vec(names=("nx", "ny", "nz")), way) >= least_cos
    key = ["frame_id", "camera_index", "x", "y"]
    n = agree.groupBy(*key).agg(F.count_if(facing).alias("n"))
    return points.join(n, key, "left").withColumn("views", 1 + F.coalesce("n", F.lit(0))).drop("n")


def with_world_normals(points: DataFrame, depth: DataFrame, rig: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Points of unproject() with their pixel's normal turned into the world."""
    key = ["frame_id", "camera_index", "x", "y"]
    n = depth_normals(depth, fx, fy, cx, cy).join(rig.select("frame_id", "camera_index", "rotation"), key[:2])
    w = G.rotated(F.col("rotation"), G.vec(names=("nx", "ny", "nz")), back=True)
    return points.join(n.select(*key, *[c.alias(k) for c, k in zip(w, ("nx", "ny", "nz"), strict=True)]), key)


def fuse(depth: DataFrame, rig: DataFrame, near: float, far: float, tau: float, views: int, least_cos: float | None = None, lens: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Point-cloud fusion: the points of all cameras that so many cameras agree on. lens (fx, fy, cx, cy) for normals, which the angle
    condition needs."""
    points = unproject(depth, rig, near, far)
    if lens is not None:
        points = with_world_normals(points, depth, rig, *lens)
    return consistency(points, depth, rig, tau, least_cos).where(F.col("views") >= views)


def depth_normals(depth: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Camera-space normals from the four neighbours; towards the viewer where one is missing."""
    c = depth.select("frame_id", "camera_index", "x", "y", "depth")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, i, j in (("r", -1, 0), ("l", 1, 0), ("d", 0, -1), ("u", 0, 1))])
    moved = c.select("frame_id", "camera_index", F.explode(steps).alias("s"), "x", "y", "depth")
    moved = moved.select("frame_id", "camera_index", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), F.col("s.k").alias("k"), "depth")
    near = moved.groupBy("frame_id", "camera_index", "x", "y").agg(*[F.max(F.when(F.col("k") == k, F.col("depth"))).alias(k) for k in "rldu"])
    p = c.join(near, ["frame_id", "camera_index", "x", "y"], "left")
    # step by step, so that what is used several times stands in a column of its own
    at = lambda i, j, d: G.unproject(F.col("x") + i, F.col("y") + j, F.col(d), fx, fy, cx, cy)
    for name, v in (("v", G.sub(at(0, 1, "d"), at(0, -1, "u"))), ("h", G.sub(at(1, 0, "r"), at(-1, 0, "l")))):
        p = p.withColumns({f"{name}{c}": x for c, x in zip("xyz", v, strict=True)})
    p = p.withColumns({f"n{c}": x for c, x in zip("xyz", G.cross(G.vec("v"), G.vec("h")), strict=True)}).withColumn("size", G.length(G.vec("n")))
    unit = [F.when(F.col("size").isNull(), w).when(F.col("size") < 1e-12, 0.0).otherwise(F.col(f"n{c}") / F.col("size")).alias(f"n{c}") for c, w in zip("xyz", (0.0, 0.0, -1.0), strict=True)]
    return p.select("frame_id", "camera_index", "x", "y", *unit)


def reproject(depth: DataFrame, shift: tuple[float, float, float], fx: float, fy: float, cx: float, cy: float, width: int, height: int, threshold: float = 0.0) -> DataFrame:
    """Depth seen by a camera that moved: pixels of enough confidence are re-keyed, the most confident wins a pixel, then the nearest."""
    w = G.sub(G.unproject(F.col("x"), F.col("y"), F.col("depth"), fx, fy, cx, cy), tuple(F.lit(s) for s in shift))
    out = G.worked_out(depth.where(F.col("confidence") >= threshold).select("frame_id", "camera_index", "x", "y", "depth", "confidence"), _wx=w[0], _wy=w[1], z=w[2]).where("z > 0")
    u, v = G.project((F.col("_wx"), F.col("_wy"), F.col("z")), fx, fy, cx, cy)
    out = G.worked_out(out, px=F.rint(u).cast("long"), py=F.rint(v).cast("long"))
    out = out.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    at = ["frame_id", "camera_index", "px", "py"]
    nearest = out.groupBy(*at, "confidence").agg(F.min("z").alias("z"))  # two aggregates of plain numbers, as rows are sorted to compare structs
    return nearest.groupBy(*at).agg(F.max_by("z", "confidence").alias("depth"), F.max("confidence").alias("confidence"))


def tsdf(voxels: DataFrame, depth: DataFrame, rig: DataFrame, truncation: float, cap: float = 128.0, by_angle: bool = False, color: str | None = None) -> DataFrame:
    """Truncated signed distance of each voxel over the cameras in order: a running mean whose weight is capped. by_angle weighs a camera by
    the cosine of the view ray, 0.1 at least. color names a column of the depth table from 0 to 255 that is folded along, cut to whole
    numbers at each step."""
    there, weight = seen_in(voxels, rig), F.lit(1.0)
    if by_angle:
        t = F.col("r_translation")
        c = G.add(G.rotated(F.col("r_rotation"), G.vec(names=("wx", "wy", "wz"))), (t[0], t[1], t[2]))
        weight = F.greatest(F.lit(0.1), F.col("z") / G.length(c))
    there = there.select("frame_id", "voxel_id", "r_camera_index", "px", "py", "z", weight.alias("w"))  # without the rig, which each row would carry to the join
    hit = _met(there, depth, *([color] if color else [])).withColumn("sdf", F.col("d") - F.col("z")).where(F.col("sdf") >= -truncation)
    seen = F.struct(F.col("r_camera_index").alias("c"), F.least(F.lit(1.0), F.col("sdf") / truncation).alias("t"), F.col("w"), (F.col(f"d_{color}").cast("double") if color else F.lit(0.0)).alias("v"))
    out = folded(hit.withColumn("_seen", seen), ["frame_id", "voxel_id"], cap).drop("frame_id")
    return out if color else out.drop("color")


def folded(hit: DataFrame, keys: list[str], cap: float, plain: bool = False) -> DataFrame:
    """(keys, tsdf, weight, color): the running mean over what each voxel met (column _seen: c, t, w, v) in the order of the cameras. plain:
    _seen is c and t alone, every weight 1 and every colour 0."""
    held = hit.groupBy(*keys).agg(F.array_sort(F.collect_list("_seen")).alias("ts"))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"), F.lit(0.0).alias("v"))

    def add(s, x):
        own, value = (F.lit(1.0), F.lit(0.0)) if plain else (x["w"], x["v"])
        w = F.least(F.lit(cap), s["w"] + own)
        share = own / w
        return F.struct(((s["t"] * s["w"] + x["t"] * own) / w).alias("t"), w.alias("w"), F.floor(s["v"] * (1 - share) + value * share).cast("double").alias("v"))

    return held.select(*keys, F.aggregate("ts", zero, add).alias("f")).select(*keys, F.col("f.t").alias("tsdf"), F.col("f.w").alias("weight"), F.col("f.v").alias("color"))


def observed(grid: DataFrame, least_weight: float = 1.0) -> DataFrame:
    """Voxels that were seen often enough for a surface."""
    return grid.where(F.col("weight") >= least_weight)


def surface_points(grid: DataFrame, far: float = 0.99) -> DataFrame:
    """Crossings between observed voxels, from ones not far from the surface, with the normal along the gradient of the distance: central
    differences, 0 along an axis where a neighbour is missing."""
    keep = observed(grid)
    near = crossings(keep.where(F.abs("sdf") <= far).select("vx", "vy", "vz", "sdf"), keep)
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(l).alias("l")) for k, i, j, l in (("xa", 1, 0, 0), ("xb", -1, 0, 0), ("ya", 0, 1, 0), ("yb", 0, -1, 0), ("za", 0, 0, 1), ("zb", 0, 0, -1))])
    moved = grid.select("vx", "vy", "vz", "sdf", F.explode(steps).alias("s")).select((F.col("vx") + F.col("s.i")).alias("vx"), (F.col("vy") + F.col("s.j")).alias("vy"), (F.col("vz") + F.col("s.l")).alias("vz"), F.col("s.k").alias("k"), "sdf")
    ends = moved.groupBy("vx", "vy", "vz").agg(*[F.max(F.when(F.col("k") == k, F.col("sdf"))).alias(k) for k in ("xa", "xb", "ya", "yb", "za", "zb")])
    g = tuple(F.coalesce(F.col(f"{c}b") - F.col(f"{c}a"), F.lit(0.0)) for c in "xyz")
    n = G.length(g)
    unit = [F.when(n > 1e-8, x / n).otherwise(x).alias(k) for x, k in zip(g, ("nx", "ny", "nz"), strict=True)]
    return near.join(ends, ["vx", "vy", "vz"]).select("vx", "vy", "vz", "axis", "t", *unit)


def crossings(grid: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Where the distance changes sign between a voxel and its next one along x, y or z (of others, if given): axis, and place between the
    two."""
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for a, i, j, k in (("x", 1, 0, 0), ("y", 0, 1, 0), ("z", 0, 0, 1))])
    a = grid.select("vx", "vy", "vz", F.col("sdf").alias("s0"), F.explode(steps).alias("s")).select("vx", "vy", "vz", "s0", F.col("s.axis").alias("axis"), (F.col("vx") + F.col("s.i")).alias("bx"), (F.col("vy") + F.col("s.j")).alias("by"), (F.col("vz") + F.col("s.k")).alias("bz"))
    b = (grid if others is None else others).select(F.col("vx").alias("bx"), F.col("vy").alias("by"), F.col("vz").alias("bz"), F.col("sdf").alias("s1"))
    return a.join(b, ["bx", "by", "bz"]).where("(s0 < 0) <> (s1 < 0)").select("vx", "vy", "vz", "axis", G.edge_crossing(F.col("s0"), F.col("s1")).alias("t"))


def cubes(grid: DataFrame) -> DataFrame:
    """Cells that have all eight corners, with the corner distances in order and the mask of those inside."""
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for c, (i, j, k) in enumerate(CORNERS)])
    e = grid.select("vx", "vy", "vz", "sdf", F.explode(steps).alias("s"))
    cell = [(F.col(f"v{n}") - F.col(f"s.{m}")).alias(f"v{n}") for n, m in zip("xyz", "ijk", strict=True)]
    e = e.select(*cell, F.col("s.c").alias("c"), "sdf")
    out = e.groupBy("vx", "vy", "vz").agg(*[F.max(F.when(F.col("c") == c, F.col("sdf"))).alias(f"d{c}") for c in range(8)], F.count("*").alias("n"), F.bit_or(F.when(F.col("sdf") < 0, F.expr("shiftleft(1, c)")).otherwise(0)).alias("mask"))
    return out.where("n = 8").drop("n")


def _pieces(grid: DataFrame) -> DataFrame:
    """Voxels dealt to pieces of SPAN along z (piece instead of vz), with their place m in it; the first of a piece is also the end of the one
    before, m being SPAN there."""
    m = F.expr(f"cast(vz & {SPAN - 1} AS int)")
    own, end = (F.struct(q.alias("piece"), i.alias("m")) for q, i in ((F.expr(f"shiftright(vz, {SPAN.bit_length() - 1})"), m), (F.expr(f"shiftright(vz, {SPAN.bit_length() - 1}) - 1"), F.lit(SPAN))))
    dealt = grid.withColumn("_at", F.explode(F.when(m == 0, F.array(own, end)).otherwise(F.array(own))))
    return dealt.select(*[c for c in grid.columns if c != "vz"], "_at.piece", "_at.m")


def cases(grid: DataFrame) -> DataFrame:
    """The cells and masks of cubes() without the distances. Voxels meet in pieces of columns along z first, as bits of one number, and four
    pieces make the cells between them; else a voxel is dealt to eight cells, and each cell has a row in the tables of the aggregate. How
    often a voxel is there (127 times at most) stands in seven bits, as a repeated one counts twice."""
    inside = F.bit_or(F.when(F.col("sdf") < 0, F.expr("shiftleft(1, m)")).otherwise(0)).alias("inside")
    held = _pieces(grid.select("vx", "vy", "vz", "sdf")).groupBy("vx", "vy", "piece").agg(F.sum(F.expr("shiftleft(1L, 7 * m)")).alias("n"), inside)
    held = held.where(F.col("n") % (1 << 7 * SPAN) != 0)  # what only ends the piece before begins no cell
    sides = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.lit(j).alias("j")) for c, (i, j, k) in enumerate(CORNERS) if k == 0])
    four = held.select("vx", "vy", "piece", "n", "inside", F.explode(sides).alias("s")).select((F.col("vx") - F.col("s.i")).alias("vx"), (F.col("vy") - F.col("s.j")).alias("vy"), "piece", F.col("s.c").alias("c"), "n", "inside")
    four = four.groupBy("vx", "vy", "piece").agg(*[F.max(F.when(F.col("c") == c, F.col(x))).alias(f"{x}{c}") for c in range(4) for x in ("n", "inside")])
    cell = four.where(" AND ".join(f"n{c} IS NOT NULL" for c in range(4))).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(SPAN)])))
    count = " + ".join(f"(shiftright(n{c}, 7 * (m + {k})) & 127)" for k in (0, 1) for c in range(4))
    mask = " | ".join(f"shiftleft(shiftright(inside{c}, m + {k}) & 1, {c + 4 * k})" for k in (0, 1) for c in range(4))
    return cell.where(f"{count} = 8").select("vx", "vy", (F.col("piece") * SPAN + F.col("m")).alias("vz"), F.expr(mask).alias("mask"))


def case_table() -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Triangles, as triples of edges, for each of the 256 masks, built by rule: on every face the border between inside and outside
    gives segments between edges (a face with two opposite inside corners keeps them apart), segments close to loops, loops become
    fans."""
    faces = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (2, 3, 7, 6), (0, 4, 7, 3), (1, 2, 6, 5))  # corners, anticlockwise from outside
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    out = []
    for mask in range(256):
        inside = [bool(mask >> c & 1) for c in range(8)]
        nxt: dict[int, int] = {}
        for f in faces:
            edges = [number[frozenset((f[i], f[(i + 1) % 4]))] for i in range(4)]
            leaves = [i for i in range(4) if inside[f[i]] and not inside[f[(i + 1) % 4]]]  # edges where the walk goes out
            enters = [i for i in range(4) if not inside[f[i]] and inside[f[(i + 1) % 4]]]
            for i in leaves:  # pairs with the entry of the same inside stretch, which lies before it
                j = max(enters, key=lambda e: (e - i) % 4)  # noqa: B023
                nxt[edges[i]] = edges[j]
        loops, left = [], dict(nxt)
        while left:
            start, at = next(iter(left)), None
            loop = [start]
            at = left.pop(start)
            while at != start:
                loop.append(at)
                at = left.pop(at)
            loops.append(loop)
        out.append((mask, [(p[0], p[i], p[i + 1]) for p in loops for i in range(1, len(p) - 1)]))
    return out


def marching_cubes(grid: DataFrame) -> DataFrame:
    """Triangles (cell, nth, three points in voxel units). The 256 cases are a broadcast table."""
    spark = grid.sparkSession
    # each case with its edges' ends: the two corners' numbers (a, b), the place of the first (f) and the way to the other (s)
    ends = [(a, b, *CORNERS[a], *[q - p for p, q in zip(CORNERS[a], CORNERS[b], strict=True)]) for a, b in EDGES]
    rows = [(m, n, *[x for e in t for x in ends[e]]) for m, ts in case_table() for n, t in enumerate(ts)]
    cases = spark.createDataFrame(rows, "mask int, nth int, " + ", ".join(f"{c}{k} int" for k in range(3) for c in ("a", "b", "fx", "fy", "fz", "sx", "sy", "sz")))
    cells = G.worked_out(cubes(grid).where("mask NOT IN (0, 255)"), d=F.array(*[f"d{c}" for c in range(8)]))  # these two have no triangles
    out = cells.select("vx", "vy", "vz", "mask", "d").join(F.broadcast(cases), "mask")
    out = out.withColumns({f"t{k}": G.edge_crossing(F.col("d")[F.col(f"a{k}")], F.col("d")[F.col(f"b{k}")]) for k in range(3)})
    out = out.withColumns({f"p{k}{v}": F.col(f"v{v}") + F.col(f"f{v}{k}") + F.col(f"t{k}") * F.col(f"s{v}{k}") for k in range(3) for v in "xyz"})
    return out.select("vx", "vy", "vz", "nth", *[f"p{k}{v}" for k in range(3) for v in "xyz"])


def volume_dims(low: tuple[float, float, float], high: tuple[float, float, float], size: float) -> tuple[int, int, int]:
    """Voxels along each axis, at least one."""
    return tuple(max(1, int((h - a) / size + 0.5)) for a, h in zip(low, high, strict=True))
