"""Tables and files between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and everything runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="voxelweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxelweave-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a written table: what follows does not depend on what came before, and lost executors repeat none of it."""
    path = path or fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that cut() made; nothing may read it after."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def left_as_dealt(df: DataFrame) -> DataFrame:
    """df in a session like its own, but for one setting: joins of it take rows where they lie if both sides are dealt by some of the join's
    columns alike (frames, or blocks of cells). Else Spark deals them anew by all of the columns, which moves every pixel, voxel and vertex at
    each step. For rows that are dealt evenly; what is made of df stays in that session, and the caller's does not change."""
    spark = df.sparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)
