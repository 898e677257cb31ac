"""Observed metrics of streams, and packets through a table function."""

import time

from pyspark.sql import functions as F

from voxelweave.functions import binary as B
from voxelweave.operators import codec as D
from voxelweave.streaming import metrics as M


def test_a_stream_logs_what_it_observes(spark, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "log")
    log = M.log_metrics(spark, table)
    try:
        for n in (10, 25):
            spark.range(n).coalesce(1).write.mode("append").parquet(src)
            rows = M.observed(spark.readStream.schema("id long").parquet(src), "read", n=F.count(F.lit(1)), least=F.min("id"))
            even = M.observed(rows.where("id % 2 = 0"), "even", n=F.count(F.lit(1)))
            even.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).queryName("counted").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        for _ in range(50):  # progress is told a little later
            try:
                got = {(r.batch, r.step, r.metric): r.value for r in spark.read.parquet(table).where("name = 'counted' AND metric <> 'seconds'").collect()}
            except Exception:  # the table is not there yet
                got = {}
            if len(got) >= 8:
                break
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(log)
    assert got == {(b, s, m): v for b, n in ((0, 10), (1, 25)) for s, m, v in (("batch", "rows", n), ("read", "n", n), ("read", "least", 0), ("even", "n", (n + 1) // 2))}


def test_packets_in_sql(spark):
    one, two = B.packet(0, 1, 7, 99, b"abc"), B.packet(2, 0, 8, 100, b"")
    D.register_packets(spark)
    streams = [(1, one + two), (2, one + two[:-3]), (3, one + b"\xff" + two), (4, b""), (5, None), (6, one[:2]), (7, b"x"), (8, one[:-1])]
    frame = spark.createDataFrame(streams, "id long, data binary")
    rows = spark.sql("SELECT s.id, u.* FROM {s} s, LATERAL unpack_packets(s.data) u", s=frame).collect()
    got = {i: [(r.kind, r.frame_id, r.timestamp_ms, bytes(r.payload), r.rest) for r in rows if r.id == i] for i, _ in streams}
    first, second = (0, 7, 99, b"abc", None), (2, 8, 100, b"", None)
    assert got[1] == [first, second] and got[4] == got[5] == []
    assert got[2] == [first, (None, None, None, two[:-3], "cut")] and got[3] == [first, (None, None, None, b"\xff" + two, "foreign")]
    assert got[6] == [(None, None, None, one[:2], "cut")] and got[7] == [(None, None, None, b"x", "foreign")] and got[8] == [(None, None, None, one[:-1], "cut")]
