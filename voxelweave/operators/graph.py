"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from voxelweave.sources.scratch import cut, discard

#: Rounds of small groups between two looks whether they have settled.
ROUNDS = 3


def _settled(at: DataFrame, group: str) -> bool:
    """Whether the links are a star forest: each node hangs on one, and that one on none."""
    ends = at.select(group, F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("hangs")), F.struct(F.col("b").alias("n"), F.lit(0).alias("hangs")))))
    off = ends.groupBy(group, "n").agg(F.sum("hangs").alias("k"), F.count("*").alias("all")).where("k > 1 OR (k > 0 AND all > k)")
    return not off.limit(1).count()


def _connected_together(links: DataFrame, group: str, most: int) -> DataFrame:
    """connected() for groups of which each is in one task: the same rounds by windows."""
    deal = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    least = lambda c, by: F.min(c).over(Window.partitionBy(group, by))
    at = deal(links.where("a <> b").select(group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()
    old = None
    for _ in range(most):
        for _ in range(ROUNDS):
            both = at.select(group, F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
            large = both.withColumn("m", F.least(least("v", "u"), F.col("u"))).where("v > u").select(group, F.col("v").alias("a"), F.col("m").alias("b")).distinct()
            at = large.withColumn("m", least("b", "a")).select(group, F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).where("a <> b").distinct()
        new = cut(at, "links")
        at = deal(new)
        settled = _settled(at, group)
        if old is not None:
            discard(old)
        if settled:
            return new.select(group, F.col("a").alias("node"), F.col("b").alias("root"))
        old = new
    raise RuntimeError("the components did not settle")


def connected(links: DataFrame, group: str, most: int = 100, together: bool = False) -> DataFrame:
    """(group, node, root): the smallest node that each node is linked to, for all nodes but the roots. links: group, a, b; only nodes of
    one group are linked.

    Rounds of two steps: every node hangs its larger neighbours on the smallest node that it sees, then its smaller ones (alternating large
    and small stars). Both keep components whole, and the number of rounds grows with the logarithm of the nodes. Joins are on the node, and
    a node with many neighbours is split by the skew join. together: groups are small and many, so each stays in one task, where windows take
    the place of the joins; then three rounds need the one exchange that deals out the groups.
    """
    if together:
        return _connected_together(links, group, most)
    at = cut(links.where("a <> b").select(group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most):
        both = at.select(group, F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        least = both.groupBy(group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, [group, "u"]).select(group, F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(group, "a").agg(F.min("b").alias("m"))
        small = large.join(down, [group, "a"]).select(group, F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).where("a <> b").distinct()
        new = cut(small, "links")
        settled = _settled(new, group)
        discard(at)
        at = new
        if settled:
            return at.select(group, F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("the components did not settle")
