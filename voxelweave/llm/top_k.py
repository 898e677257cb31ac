"""Exact top-k inner products: candidates by descending length, partial sums on rotated vectors, Cauchy-Schwarz bounds on the rest.

Components are floor(scale * x). Candidates are range-sorted by length and packed into blocks, each with its vectors as they are and
rotated by the singular vectors of all of them, and with what is left of each length after so many leading components. Every query first
meets the longest block, which gives it a k-th best score. Then candidates form groups of blocks, and a query goes to the groups whose
longest vector times its own length can still reach that score. In a group it walks the blocks by descending length; in a block the
bound on each pair, its partial sum so far plus the product of the lengths left, is tightened a few leading components at a time, and only
pairs that can still reach the k-th best score go on. What is left is scored in whole numbers.

Cases: vectors that are null, or hold a null or non-finite component, take no part; shorter vectors count as padded with zeros; an
empty vector is a zero vector; rows with a null id take no part; rows that repeat an id, or id and vector, are candidates each, also of
one another, and queries each; ties go to the smaller id; extra columns are ignored; an empty table gives an empty table. A score beyond
64 bits that no bound rules out raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import materialize

#: Leading components after which a bound is looked at again; queries that walk a block together; rows of a group of blocks, and groups at
#: least.
STEPS, TOGETHER, GROUP, GROUPS = (4, 8, 16, 32), 64, 1 << 16, 48
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53

PACKED = "block long, longest double, n int, rows binary, ids binary, vectors binary, rotated binary, rest binary"
FOUND = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v array of whole numbers as doubles, norm2) of the rows that take part; row tells those of one id apart."""
    x = F.col(vector)
    # beyond 2**53 every double is whole, and beyond 2**63 floor() has no long to give
    floor = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    whole = F.transform(x, lambda c: floor(c.cast("double") * scale))
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    rows = vectors.where(usable & F.col(vec_id).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products over all rows: one matrix from each task, summed by its rows; width rows reach the driver."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0).to_pylist(), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([r.tobytes() for r in total], pa.binary())], names=["at", "x"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("x"))
        return pa.table([table.column("at").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["at", "x"])

    out = np.zeros((width, width))
    for at, x in rows.select("v").mapInArrow(run, "at long, x binary").groupBy("at").applyInArrow(add, "at long, x binary").collect():
        out[at] = np.frombuffer(x, np.float64)
    return out


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def heads(width: int) -> list[int]:
    """Numbers of leading components at which bounds are looked at; at the last nothing is left."""
    return [h for h in STEPS if h < width] + [width]


def rests(rotated: np.ndarray) -> np.ndarray:
    """Lengths of what follows the leading components, a column for none and for each of heads()."""
    return np.stack([np.sqrt((rotated[:, h:] ** 2).sum(1)) for h in (0, *heads(rotated.shape[1]))], 1)


def packed(rows: DataFrame, width: int, parts: int, size: int, rotation: np.ndarray) -> DataFrame:
    """Blocks of up to size vectors in the order of descending length, then id, rotated once; a block never needs more than its task's
    rows."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = [c.split(" ")[0] for c in PACKED.split(", ")]
    kinds = [pa.int64(), pa.float64(), pa.int32()] + 5 * [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                own, ids, v = (batch.slice(at, size).column(i) for i in range(3))
                m = _matrix(v.to_pylist(), width)
                q = m @ rotation
                left = rests(q)
                values = (part << 32 | seq, float(np.sqrt((m * m).sum(1)).max()), len(m), np.array(own.to_pylist(), np.int64).tobytes(), np.array(ids.to_pylist(), np.int64).tobytes(), m.tobytes(), q.tobytes(), left.tobytes())
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=names)

    ordered = rows.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    return ordered.select("row", "vec_id", "v").mapInArrow(run, PACKED)


class Block:
    """A packed row as arrays."""

    def __init__(self, r: dict, width: int):
        self.rows, self.ids = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids"))
        self.vectors, self.rotated, self.rest = (np.frombuffer(r[c], np.float64).reshape(r["n"], -1) for c in ("vectors", "rotated", "rest"))
        self.longest = r["longest"]


def whole_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: doubles where these are exact, Python's integers otherwise."""
    limit = np.sqrt((queries * queries).sum(1).max(initial=0)) * np.sqrt((vectors * vectors).sum(1).max(initial=0))
    if limit < EXACT:
        return queries @ vectors.T
    q, v = ([[int(x) for x in row] for row in m.tolist()] for m in (queries, vectors))
    out = np.array([[sum(a * b for a, b in zip(x, y, strict=True)) for y in v] for x in q], object)
    if any(abs(s) >= 1 << 63 for s in out.ravel()):
        raise OverflowError("a score needs over 64 bits")
    return out


def best_of(asks: Block, mine: np.ndarray, block: Block, k: int, least: np.ndarray) -> tuple[list[tuple[int, int, int, int]], int]:
    """(position among mine, score, id, row) of the k best of a block for each of the asks' rows in mine, and the number of pairs that
    were scored. least: a score that each one's k-th best is known to reach (-inf: unknown)."""
    q, rest_q = asks.rotated[mine], asks.rest[mine]
    slack = 1e-6 * (1 + rest_q[:, 0].max(initial=0) * block.rest[:, 0].max(initial=0))
    some, partial, done = np.arange(len(block.ids)), np.zeros((len(mine), len(block.ids))), 0
    for j, h in enumerate(heads(q.shape[1]), 1):
        partial = partial + q[:, done:h] @ block.rotated[some, done:h].T
        bound = partial + np.outer(rest_q[:, j], block.rest[some, j])
        keep = bound >= (least - slack)[:, None]
        alive = keep.any(0)
        some, partial, keep, done = some[alive], partial[:, alive], keep[:, alive], h
        if not len(some):
            return [], 0
    scores = whole_scores(asks.vectors[mine], block.vectors[some])
    out = []
    for i, row in enumerate(asks.rows[mine]):
        x = np.nonzero(keep[i] & (block.rows[some] != row))[0]
        s = scores[i, x]
        if len(x) > 4 * k and scores.dtype != object:
            low = np.partition(s, len(s) - k)[len(s) - k]
            x, s = x[s >= low], s[s >= low]
        best = sorted(zip((-int(v) for v in s), block.ids[some][x].tolist(), block.rows[some][x].tolist(), strict=True))[:k]
        out += [(i, -v, c, r) for v, c, r in best]
    return out, int(keep.sum())


def walk(asks: Block, block: Block, k: int, least: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(query row, query id, id, score) of the asks that can reach a block; raises least to what a full k of them gives."""
    found = []
    near = np.nonzero(asks.rest[:, 0] * block.longest * (1 + 1e-9) + 1e-6 >= least)[0]
    for at in range(0, len(near), TOGETHER):
        mine = near[at : at + TOGETHER]
        best, _ = best_of(asks, mine, block, k, least[mine])
        counts = np.bincount([b[0] for b in best], minlength=len(mine))
        for i, score, c, _ in best:
            found.append((int(asks.rows[mine[i]]), int(asks.ids[mine[i]]), c, score))
        ends = np.cumsum(counts)
        for i in np.nonzero(counts >= k)[0]:
            least[mine[i]] = max(least[mine[i]], float(best[ends[i] - 1][1]))
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the blocks found: at most k rows of a query and block reach this shuffle."""
    best = found.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, k).alias("best"))
    return best.select("query_row", "query_id", F.posexplode("best").alias("rank", "b")).select("query_row", "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = 2048, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which the column is_query holds."""
    import pyarrow as pa

    rows = materialize(quantised(vectors, scale, vec_id, vector), "vectors")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    rotation = np.linalg.svd(gram(rows, width))[0] if count else np.eye(width)
    blocks = materialize(packed(rows, width, max(1, -(-count // (8 * block))), block, rotation), "candidate-blocks")
    asks = materialize(packed(rows.where(is_query), width, max(1, -(-count // (50 * block))), 512, rotation), "query-blocks")

    def output(found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    # The longest blocks, enough of them for k others, give every query its first scores: at most k + 2 blocks, of a bounded size.
    lead = [(r.block, r.n) for r in blocks.select("block", "n").orderBy("block").limit(2 + k).collect()]
    lead = [b for i, (b, _) in enumerate(lead) if sum(n for _, n in lead[:i]) <= k]
    shipped = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in blocks.where(F.col("block").isin(lead)).collect()])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Block(r, width) for r in sorted(shipped.value, key=lambda r: r["block"])]
        for batch in batches:
            for r in batch.to_pylist():
                own = Block(r, width)
                least = np.full(len(own.ids), -np.inf)
                for b in held:
                    yield output(walk(own, b, k, least))

    seeded = materialize(asks.mapInArrow(first, FOUND), "first-scores")
    kth = ranked(seeded, k).groupBy("query_row").agg(F.max("rank").alias("r"), F.min("score").cast("double").alias("low")).where(F.col("r") == k)

    # Groups of neighbouring blocks; a query block goes to each group that its longest vector can reach.
    members = asks.select("block", F.col("longest").alias("q_longest"), "n", "rows").mapInArrow(_members, "ask long, query_row long")
    lows = members.join(kth, "query_row", "left").groupBy("ask").agg(F.collect_list(F.struct("query_row", F.coalesce("low", F.lit(float("-inf"))).alias("low"))).alias("lows"), F.min(F.coalesce("low", F.lit(float("-inf")))).alias("lowest"))
    per = max(1, min(GROUP // block, -(-count // block) // GROUPS))
    # a block's number holds its range of lengths and its place there, so neighbours share a group
    others = blocks.where(~F.col("block").isin(lead)).withColumn("group", F.floor((8 * F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)) / per).cast("long"))
    reach = materialize(others.groupBy("group").agg(F.max("longest").alias("reach")), "reach")
    groups = max(1, reach.count())
    pairs = asks.select("block", "longest").join(lows, F.col("block") == F.col("ask")).select("ask", "longest", "lowest")
    small = F.broadcast(reach) if groups <= 100_000 else reach  # 16 bytes each
    pairs = pairs.join(small, F.col("longest") * F.col("reach") * (1 + 1e-9) + 1e-6 >= F.col("lowest")).select("ask", "group")
    asking = asks.join(lows.select("ask", "lows"), F.col("block") == F.col("ask")).join(pairs, "ask")
    none = F.lit(None).cast("array<struct<query_row:bigint,low:double>>")
    columns = [c.split(" ")[0] for c in PACKED.split(", ")]
    both = others.select("group", F.lit(0).alias("kind"), *columns, none.alias("lows")).unionByName(asking.select("group", F.lit(1).alias("kind"), *columns, "lows"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["group"] != at:
                    at, held = r["group"], []
                if r["kind"] == 0:
                    held.append(Block(r, width))
                    continue
                own, low = Block(r, width), {x["query_row"]: x["low"] for x in r["lows"]}
                least = np.array([low.get(x, -np.inf) for x in own.rows.tolist()])
                yield output([x for b in held for x in walk(own, b, k, least)])

    found = both.repartition(groups, "group").sortWithinPartitions("group", "kind", "block").mapInArrow(second, FOUND)
    return ranked(seeded.unionByName(found), k).drop("query_row")


def _members(batches):
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            own = np.frombuffer(r["rows"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["block"])), pa.array(own)], names=["ask", "query_row"])
