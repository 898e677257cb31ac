"""What the operators share: reading tables, the shared folder, lineage cuts and hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; one of our own only where that is unset and all run on one
    machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="voxelweave-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxelweave/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker while a table is written; the batch is held a few times on either side.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: what follows survives lost executors without a rerun of what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(BATCH_LIMIT[0])
    spark.conf.set(*BATCH_LIMIT)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_LIMIT[0], before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files that a table of materialize() reads; nothing may read it after."""
    spark = df.sparkSession
    for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets), null as empty, without a Python object per row."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    starts = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def lookup(left: DataFrame, right: DataFrame, on: str, key: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of left.on to right.key, where right has one row for each key and a count _n of the left rows that hold it.

    Keys that hold over one share-th of the left rows number under share, so these are joined by broadcast; the others by a
    shuffled join in which the hot rows are dealt out by a hash of themselves, so no task gets a hot key.
    """
    from pyspark.sql import functions as F

    values = [c for c in right.columns if c not in (key, "_n")]
    limit = total / share
    hot = right.where(F.col("_n") > limit).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = right.where(F.col("_n") <= limit).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_c_{c}") for c in values])
    out = left.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")
    spread = F.when(F.col("_hot").isNotNull() | F.col(on).isNull(), F.xxhash64(*[F.col(c) for c in left.columns])).otherwise(F.lit(0))
    out = out.withColumn("_s", spread).join(cold.withColumn("_z", F.lit(0).cast("long")), (F.col(on) == F.col("_cold")) & (F.col("_s") == F.col("_z")), "left")
    return out.select(*left.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Smallest node that each node is linked to: (node, root) for every node but the roots, from edges (a, b) of longs with a > b.

    A round hangs the larger neighbours of every node on its smallest one and then skips over parents; it ends when all parents are
    roots. A node meets only its smaller neighbours in one task; parents with many children are looked up hot-safe.
    """
    from pyspark.sql import functions as F

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(limit):
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("bs"))
        moved = least.select(F.explode(F.concat(F.array("a"), "bs")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        moved = materialize(moved, "edges")
        children = moved.groupBy("b").agg(F.count("*").alias("_n"))
        parents = moved.groupBy("a").agg(F.min("b").alias("up"), F.count("*").alias("k"))
        right = materialize(parents.join(children, parents.a == children.b).select(parents.a.alias("p"), "up", "_n"), "parents")
        several = parents.where("k > 1").limit(1).count()
        nested = right.limit(1).count()
        if not several and not nested:
            return moved.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if nested:
            up = lookup(moved, right, "b", "p", max(1, moved.count()))
            edges = up.select("a", F.coalesce("up", "b").alias("b")).unionByName(right.select(F.col("p").alias("a"), F.col("up").alias("b"))).where("a <> b")
            edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        else:
            edges = moved
    raise RuntimeError("the components did not settle")


def pack(values: np.ndarray) -> bytes:
    """An array of unsigned integers as zstandard bytes, byte planes apart."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def bundle(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers as one zstandard frame: their lengths, then each with its byte planes apart."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays if len(a)]
    return _zstd()[0].compress(b"".join([np.array([len(a) for a in arrays], np.uint32).tobytes(), *planes]))


def unbundle(data: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(_zstd()[1].decompress(data), np.uint8)
    out, at = [], 4 * len(kinds)
    for kind, n in zip(kinds, raw[:at].view(np.uint32).tolist(), strict=True):
        size = n * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += size
    return out


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    n = len(sorted_values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.nonzero(sorted_values[1:] != sorted_values[:-1])[0] + 1])
    return starts, np.diff(np.concatenate([starts, [n]]))


def give_back() -> None:
    """Returns what the allocators of a Python worker hold but don't use, so that its peak doesn't stay for the stages that follow."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)
