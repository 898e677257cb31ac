"""Depth maps to meshes through a block-sparse volume of signed distances.

The volume is kept in bricks of 8 x 8 x 8 voxels, and only those near a depth value exist: each pixel of a depth map allocates the bricks that
its ray passes within the truncation of its depth. A brick is paired with the cameras of its frame whose view it can lie in, by a test of its
ball against the four sides of the view, and only then taken apart into voxels, so work follows the surface and not the volume. Bricks meet
depth maps tile by tile: a join brings them the tiles that they may project to, and voxels read their pixel from the tile that they came
with, so no voxel is dealt out before it is folded. Camera coordinates are linear in a voxel's place in its brick. The folded volume gives
triangles, with vertices that neighbouring cells share: a vertex is an edge of the voxel lattice on which the distance changes sign, and only
cells beside such an edge are looked at.

Tables hold many frames: depth (frame_id, camera_index, x, y, depth, optional alpha and color), rig as in operators.fusion with width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import geometry as G
from voxelweave.operators import fusion as U

#: Voxels along a brick's side.
SIDE = 8
#: Pixels along a tile's side.
TILE = 32
#: Lattice places are kept in so many bits along each axis, from minus half of the range.
BITS = 20


def _turned(v: tuple[Column, Column, Column], back: bool = False) -> tuple[Column, Column, Column]:
    return G.rotated(F.col("rotation"), v, back=back)


def allocated(depth: DataFrame, rig: DataFrame, voxel: float, truncation: float, near: float, far: float) -> DataFrame:
    """(frame_id, bx, by, bz): bricks that hold a voxel within the truncation of a usable depth, or its neighbour."""
    if "alpha" not in depth.columns:
        depth = depth.withColumn("alpha", F.lit(255))
    p = U.usable(depth, near, far).join(rig, ["frame_id", "camera_index"])
    size = SIDE * voxel
    ray = _turned(((F.col("x") - F.col("cx")) / F.col("fx"), (F.col("y") - F.col("cy")) / F.col("fy"), F.lit(1.0)), back=True)
    eye = G.camera_position(F.col("rotation"), F.col("translation"))
    steps = int(2 * (truncation + voxel) / (size / 2)) + 1
    # half a step along the ray, half a pixel across it, and one voxel
    reach = size / 4 + voxel + 0.71 * F.col("depth") / F.least("fx", "fy")
    p = p.select("frame_id", "depth", reach.alias("reach"), *[c.alias(f"r{k}") for k, c in zip("xyz", ray, strict=True)], *[c.alias(f"e{k}") for k, c in zip("xyz", eye, strict=True)])
    at = F.explode(F.array(*[F.col("depth") + (-truncation - voxel + i * 2 * (truncation + voxel) / steps) for i in range(steps + 1)]))
    p = p.withColumn("z", at)
    out = p.select("frame_id", *[F.sequence(F.floor((F.col(f"e{k}") + F.col(f"r{k}") * F.col("z") - F.col("reach")) / size), F.floor((F.col(f"e{k}") + F.col(f"r{k}") * F.col("z") + F.col("reach")) / size)).alias(f"b{k}") for k in "xyz"]).distinct()
    for k in "xyz":
        out = out.withColumn(f"b{k}", F.explode(f"b{k}"))
    return out.distinct()


def in_view(bricks: DataFrame, rig: DataFrame, voxel: float) -> DataFrame:
    """Bricks with each camera of their frame that may see them: its parameters, the brick's first voxel centre in its coordinates (o*), and
    the steps to the next voxels (sx*, sy*, sz*)."""
    size = SIDE * voxel
    b = bricks.join(rig, "frame_id")
    t = F.col("translation")
    middle = tuple((F.col(f"b{k}") + 0.5) * size for k in "xyz")
    b = b.withColumns({f"m{k}": c for k, c in zip("xyz", G.add(_turned(middle), (t[0], t[1], t[2])), strict=True)})
    ball = 3**0.5 / 2 * size

    def beyond(place: str, focus: str, low: Column) -> Column:
        """Farther than the ball outside the side of the view through the eye and low (pixels from the middle)."""
        return (F.col(focus) * F.col(place) - low * F.col("mz")) < -ball * F.sqrt(F.col(focus) * F.col(focus) + low * low)

    def above(place: str, focus: str, high: Column) -> Column:
        return (high * F.col("mz") - F.col(focus) * F.col(place)) < -ball * F.sqrt(F.col(focus) * F.col(focus) + high * high)

    out = beyond("mx", "fx", -F.col("cx") - 0.5) | above("mx", "fx", F.col("width") - 0.5 - F.col("cx")) | beyond("my", "fy", -F.col("cy") - 0.5) | above("my", "fy", F.col("height") - 0.5 - F.col("cy")) | (F.col("mz") < -ball)
    b = b.where(~out)
    corner = tuple((F.col(f"b{k}") * SIDE + 0.5) * voxel for k in "xyz")
    first = G.add(_turned(corner), (t[0], t[1], t[2]))
    r = F.col("rotation")
    steps = [(r[i][j] * voxel).alias(f"s{'xyz'[j]}{'xyz'[i]}") for j in range(3) for i in range(3)]
    return b.select("frame_id", "camera_index", "bx", "by", "bz", "fx", "fy", "cx", "cy", "width", "height", *[c.alias(f"o{k}") for k, c in zip("xyz", first, strict=True)], *steps, "mx", "my", "mz")


def tiles(depth: DataFrame, color: str | None = None) -> DataFrame:
    """(frame_id, camera_index, tx, ty, d, v): the depth map cut into tiles, depth and colour as arrays row by row, NaN where there is none."""
    import numpy as np
    import pandas as pd

    def run(name: tuple, p: pd.DataFrame) -> pd.DataFrame:
        at = (p["y"].to_numpy() % TILE) * TILE + p["x"].to_numpy() % TILE
        out = []
        for c in ("d", "v") if color else ("d",):
            full = np.full(TILE * TILE, np.nan)
            full[at] = p[c].to_numpy()
            out.append(full)
        return pd.DataFrame([[*name, *out]], columns=["frame_id", "camera_index", "tx", "ty", "d", "v"][: 4 + len(out)])

    rows = depth.select("frame_id", "camera_index", F.floor(F.col("x") / TILE).alias("tx"), F.floor(F.col("y") / TILE).alias("ty"), "x", "y", F.col("depth").alias("d"), *([F.col(color).cast("double").alias("v")] if color else []))
    return rows.groupBy("frame_id", "camera_index", "tx", "ty").applyInPandas(run, "frame_id long, camera_index long, tx long, ty long, d array<double>" + (", v array<double>" if color else ""))


def _tile_range(middle: str, focus: str, centre: str, size: str, ball: float) -> Column:
    """Tiles along one axis that a brick's ball may project to; all of them if it reaches the eye."""
    near, far = F.col("mz") - ball, F.col("mz") + ball
    low, high = F.col(middle) - ball, F.col(middle) + ball
    lo = F.col(centre) + F.col(focus) * F.when(low < 0, low / near).otherwise(low / far) - 1
    hi = F.col(centre) + F.col(focus) * F.when(high < 0, high / far).otherwise(high / near) + 1
    first, last = F.lit(0.0), F.col(size) - 1.0
    lo = F.when(near > 1e-6, F.greatest(first, F.least(last, lo))).otherwise(first)
    hi = F.when(near > 1e-6, F.greatest(first, F.least(last, hi))).otherwise(last)
    return F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))


def fold(depth: DataFrame, rig: DataFrame, voxel: float, truncation: float, near: float, far: float, cap: float = 128.0, by_angle: bool = False, color: str | None = None) -> DataFrame:
    """(frame_id, vx, vy, vz, sdf, weight, color): the voxels of allocated bricks that some camera saw. vx, vy, vz count voxels from the
    world's origin; color (0 to 255) is 0 if the depth table has none."""
    ball = 3**0.5 / 2 * SIDE * voxel
    b = in_view(allocated(depth, rig, voxel, truncation, near, far), rig, voxel)
    b = b.withColumn("tx", F.explode(_tile_range("mx", "fx", "cx", "width", ball))).withColumn("ty", F.explode(_tile_range("my", "fy", "cy", "height", ball))).drop("mx", "my", "mz")
    alpha = F.coalesce("alpha", F.lit(255)) if "alpha" in depth.columns else F.lit(255)
    v = b.join(tiles(depth.where((alpha >= 128) & F.col("depth").between(near, far)), color), ["frame_id", "camera_index", "tx", "ty"])
    v = v.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(SIDE**3 - 1))))
    i, j, k = F.col("n") % SIDE, F.floor(F.col("n") / SIDE) % SIDE, F.floor(F.col("n") / SIDE**2)
    held = ["frame_id", "camera_index", "tx", "ty", "width", "height", "fx", "fy", "cx", "cy", "d", *(["v"] if color else [])]
    v = v.select(*held, number(*[F.col(f"b{c}") * SIDE + m for c, m in zip("xyz", (i, j, k), strict=True)]).alias("n"), *[(F.col(f"o{c}") + i * F.col(f"sx{c}") + j * F.col(f"sy{c}") + k * F.col(f"sz{c}")).alias(f"q{c}") for c in "xyz"])
    px, py = G.project(G.vec("q"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    weight = F.greatest(F.lit(0.1), F.col("qz") / G.length(G.vec("q"))) if by_angle else F.lit(1.0)
    # in an array of its own: filters on it would else bring the whole projection into each of their conditions
    made = F.array(F.struct(F.rint(px).cast("long").alias("x"), F.rint(py).cast("long").alias("y"), F.col("qz").alias("z"), weight.alias("w")))
    v = v.select("frame_id", "camera_index", "n", "tx", "ty", "width", "height", "d", *(["v"] if color else []), F.explode(made).alias("p"))
    v = v.where("p.z > 0 AND p.x >= 0 AND p.y >= 0 AND p.x < width AND p.y < height").where((F.floor(F.col("p.x") / TILE) == F.col("tx")) & (F.floor(F.col("p.y") / TILE) == F.col("ty")))
    at = ((F.col("p.y") % TILE) * TILE + F.col("p.x") % TILE).cast("int")
    hit = v.select("frame_id", "n", F.col("camera_index").alias("c"), (F.get("d", at) - F.col("p.z")).alias("s"), *([F.col("p.w").alias("w"), (F.get("v", at) if color else F.lit(0.0)).alias("v")] if by_angle or color else []))
    hit = hit.where(~F.isnan("s") & (F.col("s") >= -truncation))
    plain = not (by_angle or color)
    seen = F.struct("c", F.least(F.lit(1.0), F.col("s") / truncation).alias("t"), *([] if plain else ["w", "v"]))
    out = U.folded(hit.withColumn("_seen", seen), ["frame_id", "n"], cap, plain)
    return out.select("frame_id", *[c.alias(f"v{a}") for a, c in zip("xyz", placed(F.col("n")), strict=True)], F.col("tsdf").alias("sdf"), "weight", "color")


def number(x: Column, y: Column, z: Column) -> Column:
    """One number for a voxel."""
    half, span = 1 << (BITS - 1), 1 << BITS
    return ((x.cast("long") + half) * span + (y.cast("long") + half)) * span + (z.cast("long") + half)


def placed(n: Column) -> tuple[Column, Column, Column]:
    """The voxel that number() has numbered."""
    half, mask = 1 << (BITS - 1), (1 << BITS) - 1
    return tuple(F.shiftright(n, s).bitwiseAND(F.lit(mask).cast("long")) - half for s in (2 * BITS, BITS, 0))


#: How far apart the numbers of neighbours along x, y and z are.
STRIDE = (1 << 2 * BITS, 1 << BITS, 1)


def mesh(grid: DataFrame, voxel: float = 1.0, least_weight: float = 1.0, origin: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the zero surface of each frame, as meshes: vertices mesh_id, vid, x, y, z, color; faces mesh_id, fid, i0, i1, i2.
    grid: frame_id, vx, vy, vz, sdf, weight, color. Cells count only if all eight voxels were seen often enough. Voxel n has its centre at
    (n + origin) * voxel."""
    spark = grid.sparkSession
    g = grid.where(F.col("weight") >= least_weight).select("frame_id", number(F.col("vx"), F.col("vy"), F.col("vz")).alias("n"), "sdf", "color")
    # lattice edges on which the distance changes sign, from the voxels inside, which are the fewer
    ways = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s * STRIDE[a]).cast("long").alias("step")) for a in range(3) for s in (1, -1)])
    one = g.where("sdf < 0").select("frame_id", F.col("n").alias("a"), F.col("sdf").alias("sa"), F.col("color").alias("ca"), F.inline(ways)).withColumn("n", F.col("a") + F.col("step"))
    two = one.join(g.where("sdf >= 0").select("frame_id", "n", F.col("sdf").alias("sb"), F.col("color").alias("cb")), ["frame_id", "n"])
    up = F.col("step") > 0
    order = lambda a, b: (F.when(up, F.col(a)).otherwise(F.col(b)), F.when(up, F.col(b)).otherwise(F.col(a)))
    (s0, s1), (c0, c1) = order("sa", "sb"), order("ca", "cb")
    two = two.select("frame_id", "axis", F.least("a", "n").alias("low"), s0.alias("s0"), s1.alias("s1"), c0.alias("c0"), c1.alias("c1")).withColumn("t", G.edge_crossing(F.col("s0"), F.col("s1")))
    place = [((p + F.when(F.col("axis") == k, F.col("t")).otherwise(0.0) + origin) * voxel).alias(c) for k, (c, p) in enumerate(zip("xyz", placed(F.col("low")), strict=True))]
    vertices = two.select(F.col("frame_id").alias("mesh_id"), (F.col("low") * 3 + F.col("axis")).alias("vid"), *place, (F.col("c0") + F.col("t") * (F.col("c1") - F.col("c0"))).alias("color"))
    # the four cells around each of them, with the corners that were seen
    beside = lambda a: F.array(*[(F.col("low") - i * STRIDE[(a + 1) % 3] - j * STRIDE[(a + 2) % 3]).alias("cell") for i in (0, 1) for j in (0, 1)])
    cells = two.select("frame_id", F.explode(F.when(F.col("axis") == 0, beside(0)).when(F.col("axis") == 1, beside(1)).otherwise(beside(2))).alias("cell")).distinct()
    corners = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(sum(d * s for d, s in zip(off, STRIDE, strict=True))).cast("long").alias("step")) for c, off in enumerate(U.CORNERS)])
    held = cells.select("frame_id", "cell", F.inline(corners)).select("frame_id", "cell", "c", (F.col("cell") + F.col("step")).alias("n"))
    held = held.join(g.select("frame_id", "n", (F.col("sdf") < 0).alias("inside")), ["frame_id", "n"])
    cells = held.groupBy("frame_id", "cell").agg(F.count("*").alias("k"), F.bit_or(F.when(F.col("inside"), F.expr("shiftleft(1, c)")).otherwise(0)).alias("mask")).where("k = 8")
    rows = []
    for m, triangles in U.case_table():
        for nth, t in enumerate(triangles):
            ends = []
            for e in t:
                a, b = (U.CORNERS[c] for c in U.EDGES[e])
                ends.append(3 * sum(min(p, q) * s for p, q, s in zip(a, b, STRIDE, strict=True)) + next(k for k in range(3) if a[k] != b[k]))
            rows.append((m, nth, *ends))
    f = cells.join(F.broadcast(spark.createDataFrame(rows, "mask int, nth int, e0 long, e1 long, e2 long")), "mask")  # 256 cases
    faces = f.select(F.col("frame_id").alias("mesh_id"), (F.col("cell") * 8 + F.col("nth")).alias("fid"), *[(F.col("cell") * 3 + F.col(f"e{k}")).alias(f"i{k}") for k in range(3)])
    used = faces.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid")).distinct()
    return vertices.join(used, ["mesh_id", "vid"], "left_semi"), faces
