"""Capture streams: spark.readStream.format("capture").load(folder), also spark.read and df.write.

A recorder writes the messages of a capture session (functions.protowire.CAPTURE_FRAME, length-prefixed) to segments "<stream>-<number>.cap" in
a folder: it appends to "<stream>-<number>.open" and renames it when the segment is full. Streams are read side by side, the segments of one
in the order of their numbers. An offset has the segment and byte reached in each stream, so it stays small however long a session is, and a
batch that is asked for again after a restart holds the same bytes: segments only grow. Whole messages alone are in a batch: what a recorder
has not finished waits. A batch is cut into parts of about `split` bytes; a part finds its first message by hopping over length prefixes.

A row is a message, with where it was (stream, segment, position). A message that cannot be read gives a row with `error` and nothing else,
as does the rest of a closed segment that is cut off. Option clean=delete removes segments that a committed batch has gone past.
Executors and the driver must see the folder (pyarrow's file systems).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition

from voxelweave.functions import protowire as W
from voxelweave.sources.publish import Publication, Staged, listed, opened

IMAGE = "camera_index int, serial_number int, width int, height int, channels int, bit_depth int, cpu_data binary, gpu_ptr long, shm_handle string, alpha_data binary, depth_data binary"
METRICS = "capture_latency_ms double, sync_delta_ms double, dropped_frames int, per_camera_latency_ms array<double>"
FRAME = f"frame_id long, timestamp_ns long, num_cameras int, images array<struct<{IMAGE}>>, metrics struct<{METRICS}>"
SCHEMA = f"stream string, segment long, position long, {FRAME}, error string"
SPLIT = 64 << 20

_NAME = re.compile(r"(.+)-(\d+)\.(cap|open)")


def segments(path: str) -> dict[str, dict[int, tuple[str, int, bool]]]:
    """By stream and number: file, size, and whether it is closed."""
    files, base = opened(path)
    out: dict[str, dict[int, tuple[str, int, bool]]] = {}
    for name, size in listed(files, base).items():
        if m := _NAME.fullmatch(name):
            of = out.setdefault(m[1], {})
            closed = m[3] == "cap"
            if closed or int(m[2]) not in of:  # both names may be listed while it is renamed
                of[int(m[2])] = (f"{base}/{name}", size, closed)
    return out


def hop(f, at: int, end: int, to: int | None = None) -> int:
    """The place after the last whole message before end; with `to`, of the first message that begins there or later."""
    while at + W.FRAMING.size <= end and (to is None or at < to):
        f.seek(at)
        size = W.FRAMING.unpack(f.read(W.FRAMING.size))[1]
        if at + W.FRAMING.size + size > end:
            break
        at += W.FRAMING.size + size
    return at if to is None or at >= to else end


@dataclass
class Part(InputPartition):
    """Messages of a segment that begin in [start, stop), where the batch has its bytes first..last."""

    stream: str
    segment: int
    first: int
    last: int
    start: int
    stop: int


def parts(stream: str, segment: int, first: int, last: int, split: int) -> list[Part]:
    return [Part(stream, segment, first, last, at, min(at + split, last)) for at in range(first, last, split)]


def _found(path: str, stream: str, segment: int) -> str:
    """The segment's file, whether it was closed meanwhile or not."""
    from pyarrow import fs

    files, base = opened(path)
    for end in ("cap", "open"):
        name = f"{base}/{stream}-{segment}.{end}"
        if files.get_file_info(name).type == fs.FileType.File:
            return name
    known = segments(path).get(stream, {})
    if segment not in known:
        raise FileNotFoundError(f"segment {segment} of {stream} is gone from {path}")
    return known[segment][0]  # a number written with leading zeros


def messages(path: str, part: Part | None) -> Iterator[tuple]:
    if part is None:  # what Spark asks for where there are no parts
        return
    files, _ = opened(path)
    with files.open_input_file(_found(path, part.stream, part.segment)) as f:
        at = hop(f, part.first, part.last, part.start)
        while at < part.stop:
            f.seek(at)
            head = f.read(W.FRAMING.size)
            where, none = (part.stream, part.segment, at), (None,) * 5
            if len(head) < W.FRAMING.size or at + W.FRAMING.size + W.FRAMING.unpack(head)[1] > part.last:
                yield (*where, *none, "the segment ends inside a message")
                return
            packed, size = W.FRAMING.unpack(head)
            body = f.read(size)
            at += W.FRAMING.size + size
            try:
                if packed:
                    raise ValueError("a compressed message")
                m = W.decode(body, W.CAPTURE_FRAME)
            except (ValueError, UnicodeDecodeError) as e:
                yield (*where, *none, str(e))
                continue
            images = [tuple(i.values()) for i in m["images"]]
            metrics = None if m["metrics"] is None else tuple(m["metrics"].values())
            yield (*where, m["frame_id"], m["timestamp_ns"], m["num_cameras"], images, metrics, None)


class CaptureReader(DataSourceReader):
    """All that the closed segments and the whole messages of open ones hold now."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        out = []
        for stream, of in sorted(segments(self.path).items()):
            for number, (file, size, closed) in sorted(of.items()):
                out += parts(stream, number, 0, size if closed else whole(self.path, file, 0, size), self.split)
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from messages(self.path, partition)


def whole(path: str, file: str, at: int, size: int) -> int:
    files, _ = opened(path)
    with files.open_input_file(file) as f:
        return hop(f, at, size)


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int, clean: bool):
        self.path, self.split, self.clean = path, split, clean
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"at": {}}

    def latestOffset(self) -> dict:
        """The end of each stream: numbers are followed as long as none is missing."""
        out = dict(self.known)
        for stream, of in segments(self.path).items():
            number, at = self.known.get(stream, [min(of), 0])
            if number not in of:
                continue
            while number + 1 in of and of[number][2]:
                number, at = number + 1, 0
            file, size, closed = of[number]
            out[stream] = [number, max(at, size if closed else whole(self.path, file, at, size))]
        self.known = out
        return {"at": out}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out, here = [], segments(self.path)
        for stream, (last, stop) in sorted(end["at"].items()):
            first, begin = start["at"].get(stream, [None, 0])
            known = here.get(stream, {})
            first = min([n for n in known if n <= last], default=last) if first is None else first
            for number in range(first, last + 1):
                if number < last and number not in known:
                    raise FileNotFoundError(f"segment {number} of {stream} is gone from {self.path}")
                size = stop if number == last else known[number][1]
                out += parts(stream, number, begin if number == first else 0, size, self.split)
        self.known |= {s: max(list(v), self.known.get(s, list(v))) for s, v in end["at"].items()}
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from messages(self.path, partition)

    def commit(self, end: dict) -> None:
        if not self.clean:
            return
        files, _ = opened(self.path)
        for stream, of in segments(self.path).items():
            last = end["at"].get(stream, [-1])[0]
            for number, (file, _, closed) in of.items():
                if number < last and closed:
                    files.delete_file(file)


class CaptureWriter(DataSourceWriter):
    """Each task that has rows writes one segment; the driver gives it the next number of its stream, `stream` and the task's place."""

    def __init__(self, path: str, stream: str, overwrite: bool):
        self.to, self.stream, self.overwrite = Publication(path), stream, overwrite

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        folder = self.to.stage()
        files, base = opened(self.to.path)
        if (row := next(iterator, None)) is None:  # no segment, but Spark wants a message of each task
            return Staged(folder, 0)
        with files.open_output_stream(f"{base}/{folder}/{context.partitionId() if context else 0:05d}") as f:
            for row in chain([row], iterator):
                body = W.encode(row.asDict(recursive=True), W.CAPTURE_FRAME)
                f.write(W.FRAMING.pack(0, len(body)) + body)
                n += 1
        return Staged(folder, n)

    def commit(self, messages: list) -> None:
        there = {} if self.overwrite else segments(self.to.path)

        def rename(task: str) -> str:
            stream = f"{self.stream}{task}"
            return f"{stream}-{max(there.get(stream, {-1: None})) + 1}.cap"

        self.to.publish(messages, rename, replace=self.overwrite)

    def abort(self, messages: list) -> None:
        self.to.clear()


class Capture(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("clean", "off") == "delete")

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], self.options.get("stream", "cam"), overwrite)


def read_capture(spark: SparkSession, folder: str, stream: bool = False, **options) -> DataFrame:
    """Rows of a capture folder, as a table or as a stream."""
    spark.dataSource.register(Capture)
    return (spark.readStream if stream else spark.read).format("capture").options(**options).load(folder)


def write_capture(frames: DataFrame, folder: str, mode: str = "append", **options) -> None:
    """frames (the columns of FRAME) as segments of a capture folder."""
    frames.sparkSession.dataSource.register(Capture)
    frames.select("frame_id", "timestamp_ns", "num_cameras", "images", "metrics").write.format("capture").mode(mode).options(**options).save(folder)


def acknowledged(frames: DataFrame) -> DataFrame:
    """(frame_id, accepted, processing_latency_ms) for each message that could be read: a frame is accepted if the images of all its cameras
    came, each with data or a handle to it."""
    image = lambda i: i["cpu_data"].isNotNull() | (F.coalesce(i["shm_handle"], F.lit("")) != "") | (i["gpu_ptr"] != 0)
    had = F.size(F.array_distinct(F.transform(F.filter("images", image), lambda i: i["camera_index"])))
    return frames.where("error IS NULL").select("frame_id", (had >= F.col("num_cameras")).alias("accepted"), F.col("metrics.capture_latency_ms").alias("processing_latency_ms"))


def status(frames: DataFrame) -> DataFrame:
    """(stream, connected_cameras, current_fps, total_frames) of each stream of a table: cameras seen, and frames a second between its
    first and its last."""
    each = frames.where("error IS NULL").select("stream", "timestamp_ns", F.posexplode_outer("images").alias("nth", "i"))
    total = F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, 1))
    span = (F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9
    return each.groupBy("stream").agg(F.count_distinct("i.camera_index").alias("connected_cameras"), F.when(span > 0, (total - 1) / span).otherwise(0.0).alias("current_fps"), total.alias("total_frames"))
