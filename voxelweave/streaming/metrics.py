"""Metrics of running streams, from the run itself: expressions that a stream observes, and a table of what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run string, name string, batch long, at string, step string, metric string, value double"


def observed(rows: DataFrame, step: str, **metrics: Column) -> DataFrame:
    """rows, with aggregates over what passes here in each batch; no second pass over the data."""
    return rows.observe(step, *[m.alias(k) for k, m in metrics.items()])


class MetricLog(StreamingQueryListener):
    """Appends a row for each observed metric of each batch to a table, and the batch's own input rows and seconds as step "batch". A batch
    that is repeated after a restart is there again, under its other run."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    def rows(self, progress) -> list[tuple]:
        key = (str(progress.runId), progress.name, progress.batchId, progress.timestamp)
        out = [(*key, "batch", "rows", float(progress.numInputRows)), (*key, "batch", "seconds", progress.durationMs.get("triggerExecution", 0) / 1000)]
        for step, row in progress.observedMetrics.items():
            out += [(*key, step, k, None if v is None else float(v)) for k, v in row.asDict().items()]
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.spark.createDataFrame(self.rows(event.progress), SCHEMA).coalesce(1).write.mode("append").parquet(self.table)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def log_metrics(spark: SparkSession, table: str) -> MetricLog:
    """Starts logging all streams of a session; spark.streams.removeListener() ends it."""
    log = MetricLog(spark, table)
    spark.streams.addListener(log)
    return log
