"""Radius joins on a uniform grid, cross-worker merge, temporal matching and budgets.

A radius predicate alone would plan as a nested loop. Cells as wide as the radius turn it into an equi-join: one side is repeated for those
of the 27 cells around it that its ball reaches, the join is on the exact cell, and the distance is the residual. Cells of one frame that are crowded are split by
AQE's skew join, as both sides reach it straight from their exchanges. Splats are paired among themselves (near_pairs()) in blocks of cells: they
move by block, and what is repeated for each cell neither moves nor is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelweave.functions import geometry as G
from voxelweave.operators.sync import numbered
from voxelweave.sources.scratch import left_as_dealt

CELL = ("cx", "cy", "cz")
#: A block has 2**BITS cells along each axis; one with more than CROWD splats of a frame is dealt over several tasks.
BLOCK, BITS, CROWD = ("bx", "by", "bz"), 3, 1 << 14
#: Shares of the radius within which match() looks one after the other.
REACHES = (1 / 16, 1 / 4, 1)


def with_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns(dict(zip(CELL, G.grid_cell(G.vec(names=("px", "py", "pz")), size), strict=True)))


def around(points: DataFrame, size: float) -> DataFrame:
    """Every row once for each of the cells of with_cells() around its own, itself included, that something within the size can lie in: the
    cells that the ball around it reaches, about 21 of 27."""
    out = points.withColumn("_far", F.lit(0.0))
    for c, p in zip(CELL, ("px", "py", "pz"), strict=True):
        low, high = F.col(p) - F.col(c) * size, (F.col(c) + 1) * size - F.col(p)
        step = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("d"), x.alias("gap")) for i, x in ((-1, low), (0, F.lit(0.0)), (1, high))]))
        out = out.withColumn("_s", step).withColumns({c: F.col(c) + F.col("_s.d"), "_far": F.col("_far") + F.col("_s.gap") * F.col("_s.gap")}).drop("_s")
    return out.where(F.col("_far") <= size * size * (1 + 1e-6)).drop("_far")  # a little more, for rounding


def grid_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = ("frame_id",), residual=None, how: str = "inner") -> DataFrame:
    """Pairs (columns a_*, b_*) within the radius, d2 being the squared distance. The right side is the one repeated."""
    a = with_cells(left, radius).select(*[F.col(c).alias(f"a_{c}") for c in (*left.columns, *CELL)])
    b = around(with_cells(right, radius), radius).select(*[F.col(c).alias(f"b_{c}") for c in (*right.columns, *CELL)])
    d = G.sub(G.vec("a_", ("px", "py", "pz")), G.vec("b_", ("px", "py", "pz")))
    cond = G.dot(d, d) < radius * radius
    for c in (*on, *CELL):
        cond = (F.col(f"a_{c}") == F.col(f"b_{c}")) & cond
    if residual is not None:
        cond = cond & residual
    return a.join(b, cond, how).withColumn("d2", G.dot(d, d)).drop(*[f"{s}_{c}" for s in "ab" for c in CELL])


def near_pairs(splats: DataFrame, radius: float) -> DataFrame:
    """Pairs (columns a_*, b_*) of splats of one frame that different workers placed within the radius, each pair once; d2 is the squared
    distance. Each splat goes to its block, and again to the blocks that the cells after its own reach; there it meets those of its cell and of
    the 13 cells after it that its ball reaches."""
    splats = left_as_dealt(splats)  # by block, and joined by cell
    key = ["frame_id", *BLOCK, "_salt"]
    block = lambda c: F.shiftright(c, BITS)
    rows = with_cells(splats, radius)
    own = rows.select(*splats.columns, *[block(c).alias(k) for c, k in zip(CELL, BLOCK, strict=True)])
    crowded = own.groupBy(*key[:4]).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD)
    crowded = F.broadcast(crowded.select(*key[:4], F.ceil(F.col("_n") / CROWD).alias("_m")))  # one row for CROWD splats at most
    dealt = lambda df: df.join(crowded, key[:4], "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    a = dealt(own).withColumn("_salt", F.pmod(F.xxhash64(*splats.columns), "_m")).drop("_m").repartition(*key)
    reach = rows
    for c, k, first in zip(CELL, BLOCK, (0, -1, -1), strict=True):
        reach = reach.withColumn(k, F.explode(F.sequence(block(F.col(c) + first), block(F.col(c) + 1))))
    b = dealt(reach.drop(*CELL)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m").repartition(*key)
    steps = [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    b = with_cells(b, radius).withColumn("_s", F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("xyz", step, strict=True)]) for step in steps])))
    far = F.lit(0.0)
    for n, c, p in zip("xyz", CELL, ("px", "py", "pz"), strict=True):
        gap = F.when(F.col(f"_s.{n}") < 0, F.col(p) - F.col(c) * radius).when(F.col(f"_s.{n}") > 0, (F.col(c) + 1) * radius - F.col(p)).otherwise(0.0)
        far = far + gap * gap
    b = b.where(far <= radius * radius * (1 + 1e-6)).withColumns({c: F.col(c) + F.col(f"_s.{n}") for n, c in zip("xyz", CELL, strict=True)})
    b = b.where(" AND ".join(f"shiftright({c}, {BITS}) = {k}" for c, k in zip(CELL, BLOCK, strict=True))).withColumn("_same", F.expr("_s.x = 0 AND _s.y = 0 AND _s.z = 0"))
    a, b = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in (*splats.columns, *BLOCK, "_salt", *CELL, *more)]) for side, df, more in (("a", with_cells(a, radius), ()), ("b", b, ("_same",))))
    d = G.sub(G.vec("a_", ("px", "py", "pz")), G.vec("b_", ("px", "py", "pz")))
    cond = (G.dot(d, d) < radius * radius) & F.when(F.col("b__same"), F.col("a_worker_id") < F.col("b_worker_id")).otherwise(F.col("a_worker_id") != F.col("b_worker_id"))
    for c in (*key, *CELL):
        cond = (F.col(f"a_{c}") == F.col(f"b_{c}")) & cond
    pairs = a.hint("shuffle_hash").join(b, cond)  # never collected to be broadcast: the planner takes what explode() makes for as small as what it came from
    return pairs.select(*[f"{side}_{c}" for side in "ab" for c in splats.columns], G.dot(d, d).alias("d2"))


def cross_worker_pairs(splats: DataFrame, radius: float) -> DataFrame:
    """Ordered pairs of splats of one frame that different workers placed within the radius."""
    few = ("frame_id", "splat_id", "worker_id", "px", "py", "pz", "opacity")
    pairs = near_pairs(splats.select(*few), radius)
    way = lambda a, b: F.struct(*[F.col(f"{own}_{c}").alias(f"{side}_{c}") for own, side in ((a, "a"), (b, "b")) for c in few], "d2")
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def winners(splats: DataFrame, radius: float) -> DataFrame:
    """For each splat the most opaque one among itself and its pairs; ties to the smaller id. Splats are numbered in that order first: the
    least of plain numbers needs no sort, and of a pair only one splat can win the other."""
    order = [F.desc_nulls_last("opacity"), F.asc_nulls_last("splat_id")]
    ranked = numbered(splats.select("frame_id", "splat_id", "worker_id", "px", "py", "pz", "opacity"), order, "rank").drop("opacity")
    first = F.col("a_rank") < F.col("b_rank")
    lost = near_pairs(ranked, radius).select(F.col("a_frame_id").alias("frame_id"), F.when(first, F.col("b_splat_id")).otherwise(F.col("a_splat_id")).alias("splat_id"), F.least("a_rank", "b_rank").alias("rank"))
    best = lost.unionByName(ranked.select("frame_id", "splat_id", "rank")).groupBy("frame_id", "splat_id").agg(F.min("rank").alias("rank"))
    return best.join(ranked.select("rank", F.col("splat_id").alias("winner_id")), "rank").select("frame_id", "splat_id", "winner_id")


def merge(splats: DataFrame, radius: float, by_opacity: bool = True, min_opacity: float = 0.0, budget: int | None = None) -> DataFrame:
    """Weighted means over each surviving winner and the losers that chose it. A loser whose winner lost itself adds to nothing.
    The rotation and the colour bands above the constant one are the survivor's, as far as the splats have them. Rows below the least opacity go; a budget keeps the most opaque of each frame."""
    rows = winners(splats, radius).join(splats, ["frame_id", "splat_id"])
    w = F.col("opacity") if by_opacity else F.lit(1.0)
    mean = lambda x: F.sum(w * x) / F.sum(w)
    sums = [mean(F.col(c)).alias(c) for c in ("px", "py", "pz", "opacity")]
    if "sx" in splats.columns:
        sums += [mean(F.col(c)).alias(c) for c in ("sx", "sy", "sz")] + [mean(F.col("sh")[i]).alias(f"sh{i}") for i in range(3)]
    own = lambda x: F.first(F.when(F.col("splat_id") == F.col("winner_id"), x), ignorenulls=True)
    sums += [own(F.col(q)).alias(q) for q in ("qw", "qx", "qy", "qz") if q in splats.columns]
    if "sx" in splats.columns:
        sums.append(own(F.col("sh")).alias("sh"))
    out = rows.groupBy("frame_id", F.col("winner_id").alias("splat_id")).agg(*sums, F.count("*").alias("merged"), F.max(F.col("splat_id") == F.col("winner_id")).alias("_won"))
    out = out.where("_won").drop("_won")  # the winner's own row is among them, or it lost itself
    if "sx" in splats.columns:
        out = out.withColumn("sh", F.concat(F.array("sh0", "sh1", "sh2"), F.slice("sh", 4, F.greatest(F.size("sh") - 3, F.lit(0)))))
    out = out.where(F.col("opacity") >= min_opacity)
    return out if budget is None else top_opacity(out, budget)


def top_opacity(splats: DataFrame, budget: int) -> DataFrame:
    """The most opaque splats of each frame."""
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("opacity"), "splat_id"))
    return splats.withColumn("_r", rank).where(F.col("_r") <= budget).drop("_r")


def match(new: DataFrame, old: DataFrame, radius: float, threshold: float, color_weight: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Each new splat's cheapest old one: distance plus weighted mean difference of the constant colour band (the weight is not negative), under
    the threshold; null if none. new and old: splat_id, px, py, pz, sh, and the columns that a pair must agree on.

    A pair costs no less than its distance. So who finds one nearby that costs less than the reach is done, and only the others look further:
    the pairs within the whole radius, which grow with the square of the splats, are made for the few that have nothing near."""
    few = lambda df: df.select(*on, "splat_id", "px", "py", "pz", *[F.col("sh")[i].alias(f"sh{i}") for i in range(3)])  # noqa: E731  what is repeated stays narrow
    left = few(new)
    those = few(old).groupBy(*[c for c in left.columns if c != "splat_id"]).agg(F.min("splat_id").alias("splat_id"))  # of copies the smallest id, as in a tie
    color = sum((F.abs(F.col(f"a_sh{i}") - F.col(f"b_sh{i}")) for i in range(3)), F.lit(0.0)) / 3
    cost = F.sqrt("d2") + color_weight * color
    found = None
    for share in REACHES:
        pairs = grid_join(those, left, radius * share, on=on).withColumn("cost", cost).where(F.col("cost") < threshold)
        best = pairs.groupBy(F.col("b_splat_id").alias("new_id")).agg(F.min(F.struct("cost", F.col("a_splat_id").alias("old_id"))).alias("m"))
        done = best if share == 1 else best.where(F.col("m.cost") < radius * share * (1 - 1e-9))  # a little less, for rounding
        found = done if found is None else found.unionByName(done)
        left = left.join(done.select(F.col("new_id").alias("splat_id")), "splat_id", "left_anti").select(*left.columns)
    return new.select("splat_id").join(found, F.col("splat_id") == F.col("new_id"), "left").select("splat_id", "m.old_id", "m.cost")


def cell_runs(splats: DataFrame, size: float) -> DataFrame:
    """First and last position of each hashed cell in the order of hash and id, as an index over the sorted rows of a frame."""
    cells = with_cells(splats, size).withColumn("hash", G.cell_hash(tuple(F.col(c) for c in CELL)))
    at = F.row_number().over(Window.partitionBy("frame_id").orderBy("hash", "splat_id"))
    return cells.withColumn("at", at).groupBy("frame_id", "hash").agg(F.min("at").cast("long").alias("first"), F.max("at").cast("long").alias("last"))


def bounds(splats: DataFrame) -> DataFrame:
    """Bounding box of each frame."""
    return splats.groupBy("frame_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("px", "py", "pz") for n, f in (("min", F.min), ("max", F.max))])


def keyframe_deltas(splats: DataFrame, interval: int) -> DataFrame:
    """Splats of the frames between keyframes against their last keyframe, by splat_id: moved (with the differences), added, or removed
    (those of the keyframe that the frame lacks)."""
    cols = ("px", "py", "pz", "qw", "qx", "qy", "qz")
    key = F.col("frame_id") - F.col("frame_id") % interval
    now = splats.where(F.col("frame_id") % interval != 0).withColumn("key_id", key)
    k = splats.where(F.col("frame_id") % interval == 0).select(F.col("frame_id").alias("key_id"), "splat_id", *[F.col(c).alias(f"k_{c}") for c in cols])
    base = now.select("frame_id", "key_id").distinct().join(k, "key_id")  # what a keyframe has, for each of its frames
    rows = base.join(now.select("frame_id", "splat_id", *cols, "opacity"), ["frame_id", "splat_id"], "full")
    kind = F.when(F.col("k_px").isNull(), "added").when(F.col("px").isNull(), "removed").otherwise("moved")
    return rows.select("frame_id", "splat_id", kind.alias("kind"), *[(F.col(c) - F.col(f"k_{c}")).alias(f"d{c}") for c in cols], "opacity")


def concatenated(parts: dict[int, DataFrame]) -> DataFrame:
    """The partial results of several workers as one table, each row with its worker."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [p.withColumn("worker_id", F.lit(w).cast("long")) for w, p in parts.items()])
