"""The merge pipeline as a stream of micro-batches: decode, merge, track, encode, wire.

Each batch holds released partial payloads. Of its frames only the newest is worked on, as a renderer has no use for older ones; what is
left out is counted. State is tables in a folder that driver and executors share, one version for each batch, so a batch that is run again
after a failure starts from the version before it and overwrites its own results.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions import binary as B
from voxelweave.operators import codec as D
from voxelweave.operators import spatial as S
from voxelweave.operators import tracker as T

_SPLATS = f"frame_id long, worker_id long, {D.SPLAT}"


def decode_partials(payloads: DataFrame) -> DataFrame:
    """Splats of quantised payload rows (frame_id, worker_id, payload), each with its worker; ids are told apart by worker. Bad payloads
    give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame_id, worker, payload in zip(batch["frame_id"], batch["worker_id"], batch["payload"], strict=True):
                x = B.dequantise(payload)
                if x is None or not len(x["opacity"]):
                    continue
                out = pd.DataFrame(np.concatenate([x["position"], x["scale"], x["rotation"], x["opacity"][:, None]], 1), columns=[*T.ATTRIBUTES])
                out.insert(0, "splat_id", (int(worker) << 32) + np.arange(len(out)))
                out.insert(0, "worker_id", worker)
                out.insert(0, "frame_id", frame_id)
                out["sh"] = list(np.asarray(x["sh"], float))
                yield out

    return payloads.select("frame_id", "worker_id", "payload").mapInPandas(run, _SPLATS)


@dataclass
class MergePipeline:
    """Settings, and the folder of its state and results: state, packets and metrics."""

    spark: SparkSession
    folder: str
    radius: float = 0.005
    min_opacity: float = 0.0
    interval: int = 30
    tracker: T.TrackerConfig = field(default_factory=T.TrackerConfig)

    def _versions(self, name: str) -> list[int]:
        """Batches that a table has a version of: two or three, as older ones are deleted."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def _read(self, name: str, batch_id: int) -> DataFrame | None:
        """The newest version of a table before a batch."""
        before = [v for v in self._versions(name) if v < batch_id]
        return self.spark.read.parquet(f"{self.folder}/{name}/batch={before[-1]}") if before else None

    def _forget(self, batch_id: int) -> None:
        """Deletes what no batch reads again: a batch that is repeated needs the version before its own."""
        for name in ("decoded", "merged", "state", "clock", "keyframe"):
            for v in [v for v in self._versions(name) if v < batch_id][:-1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch={v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> tuple[DataFrame, int]:
        """The written table and its rows, which are counted as they are written."""
        path, seen = f"{self.folder}/{name}/batch={batch_id}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), seen.get["rows"]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of (frame_id, worker_id, timestamp_ms, payload)."""
        began = time.time()
        newest = batch.agg(F.max(F.struct("frame_id", "timestamp_ms")).alias("last"), F.count_distinct("frame_id").alias("frames")).first()
        if newest.last is None:
            return
        (frame_id, stamp), frames = newest.last, newest.frames
        splats, n_splats = self._write(decode_partials(batch.where(F.col("frame_id") == frame_id)), "decoded", batch_id)
        merged = S.merge(splats, self.radius, min_opacity=self.min_opacity).select("splat_id", *T.ATTRIBUTES, "sh")
        merged, n_merged = self._write(merged, "merged", batch_id)
        before, clock = self._read("state", batch_id), self._read("clock", batch_id)
        state, n_state = self._write(T.start(merged) if before is None else T.step(before, merged, self.tracker), "state", batch_id)
        since = None if clock is None else clock.first()["since"]
        now = state.withColumn("frame_id", F.lit(frame_id).cast("long"))
        key = None if since is None or since + 1 >= self.interval else self._read("keyframe", batch_id)
        if key is not None and not self._same(key, state):
            key = None
        chunk = D.encode_frames(now, "spz", self.tracker.budget) if key is None else D.encode_deltas(key, now)
        packets = chunk.select((F.lit(0) if key is None else F.lit(1)).alias("kind"), F.lit(0).alias("flags"), "frame_id", F.lit(stamp).cast("long").alias("timestamp_ms"), "payload")
        self._write(D.wire(packets), "packets", batch_id)
        self._write(now if key is None else key, "keyframe", batch_id)
        self._write(self.spark.createDataFrame([(0 if key is None else since + 1,)], "since int"), "clock", batch_id)
        row = (frame_id, frames - 1, n_splats, n_merged, n_state, key is None, time.time() - began)
        self._write(self.spark.createDataFrame([row], "frame_id long, skipped long, splats long, merged long, tracked long, is_keyframe boolean, seconds double"), "metrics", batch_id)
        self._forget(batch_id)

    def _same(self, key: DataFrame, state: DataFrame) -> bool:
        """Whether two tables hold the same splats."""
        a, b = key.select("splat_id"), state.select("splat_id")
        return a.join(b, "splat_id", "full").agg(F.count("*")).first()[0] == a.count() == b.count()

    def start(self, partials: DataFrame, checkpoint: str, trigger: dict):
        """Runs the pipeline over a stream; stop() of what it returns ends it, its tables stay, another folder starts anew."""
        return partials.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**trigger).start()
