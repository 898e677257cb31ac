"""Capture streams and files: replay after a restart, segments that grow, cut and broken messages, tasks that are tried again."""

import glob
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from voxelweave.functions import binary as B
from voxelweave.functions import protowire as W
from voxelweave.sources import capture as C
from voxelweave.sources import views as V
from voxelweave.sources import writers
from voxelweave.sources.frame_files import FrameFileStreamWriter, FrameFileWriter, stream_files, write_files
from voxelweave.sources.publish import Staged, proper

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def frame(n, images=2, size=40):
    rng = random.Random(n)
    shot = lambda c: {"camera_index": c, "serial_number": -5 - c, "width": 4, "height": 2, "channels": 1, "bit_depth": 8, "cpu_data": rng.randbytes(size), "gpu_ptr": 0, "shm_handle": None, "alpha_data": b"\1", "depth_data": None}
    metrics = {"capture_latency_ms": n / 4, "sync_delta_ms": 0.0, "dropped_frames": n % 3, "per_camera_latency_ms": [1.5, -2.0]}
    return {"frame_id": n, "timestamp_ns": n * 10**8, "num_cameras": 2, "images": [shot(c) for c in range(images)], "metrics": metrics}


def framed(*bodies):
    return b"".join(W.FRAMING.pack(0, len(b)) + b for b in bodies)


def message(n, **more):
    return W.encode(frame(n, **more), W.CAPTURE_FRAME)


def put(path, data, mode="wb"):
    with open(path, mode) as f:
        f.write(data)


def test_messages_survive_the_wire():
    for n in (0, 1, 7, 2**30, -3):
        assert W.decode(message(n), W.CAPTURE_FRAME) == frame(n) | {"images": [i | {"shm_handle": None} for i in frame(n)["images"]]}
    assert message(1)[:6] == b"\x08\x01\x10\x80\xc2\xd7"  # frame_id 1, timestamp 1e8
    assert W.decode(b"", W.CAPTURE_FRAME)["images"] == []
    assert W.decode(message(3) + b"\x78\x05\x82\x01\x02ab", W.CAPTURE_FRAME)["frame_id"] == 3  # unknown fields
    assert W.decode(b"\x21" + b"\0" * 7 + b"\xf0\x3f"[0:1] + b"\x21" + b"\0" * 8, {4: ("x", ["double"])})["x"] == [W.struct.unpack("<d", b"\0" * 7 + b"\xf0")[0], 0.0]  # not packed
    for bad in (message(5)[:-1], b"\xff" * 12, b"\x0a", b"\x0b", b"\x09" + b"\0" * 8):
        with pytest.raises(ValueError):
            W.decode(bad, W.CAPTURE_FRAME)


def test_table_of_a_capture_folder(spark, tmp_path):
    put(tmp_path / "a-0.cap", framed(*map(message, range(50))))
    put(tmp_path / "a-1.cap", framed(message(50), b"\xff\xff", message(51)) + W.FRAMING.pack(1, 1) + b"x" + W.FRAMING.pack(0, 99) + b"cut")
    put(tmp_path / "b-007.open", framed(message(60), message(61)) + W.FRAMING.pack(0, 500) + b"not yet")
    put(tmp_path / "notes.txt", b"no segment")
    for split in (1, 33, 500):  # parts of any size hold each message once
        reader = C.CaptureReader(str(tmp_path), split)
        assert sorted(m[3] for p in reader.partitions() for m in reader.read(p) if m[-1] is None) == [*range(52), 60, 61]
    for split in (3000, 1 << 20):
        rows = C.read_capture(spark, str(tmp_path), split=split).collect()
        assert sorted(r.frame_id for r in rows if r.error is None) == [*range(52), 60, 61]
        assert [(r.stream, r.segment) for r in rows if r.error] == [("a", 1)] * 3
        one = next(r for r in rows if r.frame_id == 9).asDict(recursive=True)
        assert {k: one[k] for k in frame(9)} == frame(9)
    acks = {r.frame_id: r.accepted for r in C.acknowledged(C.read_capture(spark, str(tmp_path))).collect()}
    assert len(acks) == 54 and all(acks.values())
    seen = {r.stream: r for r in C.status(C.read_capture(spark, str(tmp_path))).collect()}
    assert (seen["a"].connected_cameras, seen["a"].total_frames, round(seen["a"].current_fps, 6)) == (2, 52, 10.0) and seen["b"].total_frames == 2
    assert C.read_capture(spark, str(tmp_path / "none")).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()

    def run():
        rows = C.read_capture(spark, str(folder), stream=True, split=300)
        q = rows.select("stream", "frame_id", "error", F.size("images").alias("n")).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.frame_id for r in spark.read.parquet(out).where("error IS NULL").collect())

    put(folder / "a-0.open", framed(*map(message, range(5))) + framed(message(5))[:20])
    put(folder / "b-3.cap", framed(message(100)))
    assert run() == [0, 1, 2, 3, 4, 100]
    assert run() == [0, 1, 2, 3, 4, 100]  # nothing new
    put(folder / "a-0.open", framed(message(5))[20:] + framed(message(6)), "ab")
    os.rename(folder / "a-0.open", folder / "a-0.cap")
    put(folder / "a-1.cap", framed(message(7)))
    put(folder / "a-2.open", framed(message(8)))
    put(folder / "b-4.open", b"")
    put(folder / "c-0.open", framed(message(200)))
    assert run() == [*range(9), 100, 200]
    put(folder / "a-4.cap", framed(message(10)))  # number 3 is missing yet
    assert run() == [*range(9), 100, 200]
    os.rename(folder / "a-2.open", folder / "a-2.cap")
    put(folder / "a-3.cap", framed(message(9)))
    assert run() == [*range(11), 100, 200]
    table = sorted(r.frame_id for r in C.read_capture(spark, str(folder)).collect())
    assert table == [*range(11), 100, 200]


def test_a_batch_holds_the_same_bytes_again(tmp_path):
    put(tmp_path / "a-0.open", framed(*map(message, range(3))))
    first = C.CaptureStreamReader(str(tmp_path), 1 << 20, False)
    end = first.latestOffset()
    put(tmp_path / "a-0.open", framed(message(3)), "ab")
    os.rename(tmp_path / "a-0.open", tmp_path / "a-0.cap")
    put(tmp_path / "a-1.cap", framed(message(4)))
    again = C.CaptureStreamReader(str(tmp_path), 1 << 20, True)
    ids = lambda reader, a, b: [m[3] for p in reader.partitions(a, b) for m in reader.read(p)]
    assert ids(again, again.initialOffset(), end) == [0, 1, 2]
    later = again.latestOffset()
    assert ids(again, end, later) == [3, 4]
    again.commit(later)
    assert os.listdir(tmp_path) == ["a-1.cap"]
    with pytest.raises(FileNotFoundError):
        again.partitions(end, later)


def test_written_frames_come_back(spark, tmp_path):
    frames = spark.createDataFrame([frame(n) for n in range(40)], C.FRAME).repartition(3)
    for _ in range(2):
        C.write_capture(frames, str(tmp_path / "log"))
    rows = C.read_capture(spark, str(tmp_path / "log"))
    assert sorted(r.frame_id for r in rows.collect()) == sorted([*range(40)] * 2)
    assert {r.segment for r in rows.collect()} == {0, 1} and not glob.glob(str(tmp_path / "log" / "_*"))
    C.write_capture(frames.limit(5), str(tmp_path / "log"), mode="overwrite")
    assert C.read_capture(spark, str(tmp_path / "log")).count() == 5


def test_files_of_frames_equal_their_payloads(spark, tmp_path):
    s = V.splats(spark, SF)
    for name, payloads in (("ply", writers.ply_payloads(s)), ("glb", writers.splat_payloads(s)), ("spz.glb", writers.splat_payloads(s, True))):
        writers.write_payloads(payloads, str(tmp_path / name), f"frame_%06d.{name}")
        want = {f"frame_{r.frame_id:06d}.{name}": bytes(r.payload) for r in payloads.collect()}
        assert {os.path.basename(p): open(p, "rb").read() for p in glob.glob(str(tmp_path / name / "*"))} == want
    v, f = V.height_field(spark, SF)
    one, mine = F.expr("vid div 576").alias("mesh_id"), F.expr("fid div 1152").alias("mesh_id")
    local = lambda c, of: F.expr(f"{c} - {of} div {1152 if of == 'fid' else 576} * 576").alias(c)
    meshes = writers.mesh_payloads(f.select(mine, "fid", *[local(c, "fid") for c in ("i0", "i1", "i2")]), v.select(one, local("vid", "vid"), "x", "y", "z"))
    writers.write_payloads(meshes, str(tmp_path / "mesh"), "mesh_%d.glb", "mesh_id")
    files = glob.glob(str(tmp_path / "mesh" / "mesh_*.glb"))
    assert len(files) == meshes.count() and all(B.parse_glb(open(p, "rb").read())[0]["accessors"][0]["count"] == 576 for p in files)


def test_names_and_modes(spark, tmp_path):
    at = str(tmp_path / "files")
    rows = lambda *r: spark.createDataFrame(list(r), "name string, payload binary").repartition(2)
    write_files(rows(("a/one.bin", b"1"), ("two.bin", None), ("größe 3", b"")), at)
    read = lambda: {os.path.relpath(p, at): open(p, "rb").read() for p in glob.glob(at + "/**", recursive=True) if os.path.isfile(p) and "_staging" not in p}
    assert read() == {"a/one.bin": b"1", "two.bin": b"", "größe 3": b""}
    write_files(rows(("two.bin", b"new"), ("four", b"4")), at, "append")
    assert read() == {"a/one.bin": b"1", "two.bin": b"new", "größe 3": b"", "four": b"4"}
    write_files(rows(("five", b"5")), at)
    assert read() == {"five": b"5"} and not glob.glob(at + "/_*")
    write_files(rows(), at)
    assert read() == {}
    for bad in (("x", b"1"), ("../y", b"1"), ("/z", b"1"), ("_w", b"1"), (None, b"1"), ("", b"1")):
        with pytest.raises(Exception, match="several|no name"):
            write_files(rows(("x", b"0"), bad), at)
    assert read() == {} and proper("a/b") == "a/b"


def test_only_accepted_attempts_are_published(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["f"], "payload": [b"x"]})
    w = FrameFileWriter(str(tmp_path), False)
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    assert lost.folder != kept.folder
    w.commit([kept, None])
    assert sorted(os.listdir(tmp_path)) == ["f"]
    w = FrameFileWriter(str(tmp_path), True)
    w.write(iter([batch]))
    w.abort([])
    assert sorted(os.listdir(tmp_path)) == ["f"]
    s = FrameFileStreamWriter(str(tmp_path))
    s.commit([s.write(iter([batch]))], 0)
    os.remove(tmp_path / "f")
    again = FrameFileStreamWriter(str(tmp_path))
    again.commit([again.write(iter([batch]))], 0)  # the batch is known
    assert not os.path.exists(tmp_path / "f")
    again.commit([again.write(iter([batch]))], 1)
    assert os.path.exists(tmp_path / "f") and isinstance(kept, Staged)


def test_a_retried_task_leaves_one_file_each(tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession, functions as F
from voxelweave.sources.frame_files import write_files
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
def flaky(batches):
    from pyspark import TaskContext
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() < 2:
        raise RuntimeError("lost")
rows = spark.range(60).select(F.format_string("f%03d", "id").alias("name"), F.col("id").cast("string").cast("binary").alias("payload"))
write_files(rows.repartition(3).mapInArrow(flaky, rows.schema), {str(tmp_path / "out")!r})
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300, capture_output=True)
    out = {p: open(tmp_path / "out" / p).read() for p in os.listdir(tmp_path / "out")}
    assert out == {f"f{i:03d}": str(i) for i in range(60)}


def test_stream_of_packets_as_files(spark, tmp_path):
    packets = spark.createDataFrame([(i, 1, i // 3, i, f"p{i}".encode()) for i in range(30)], "kind int, flags int, frame_id long, timestamp_ms long, payload binary")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    from voxelweave.operators import codec as D

    wired = lambda rows: D.wire(rows).select(F.format_string("p%03d.pkt", "timestamp_ms").alias("name"), F.col("wire").alias("payload"))
    for part in ("timestamp_ms < 20", "timestamp_ms >= 20"):
        packets.where(part).coalesce(1).write.mode("append").parquet(src)
        stream_files(wired(spark.readStream.schema(packets.schema).parquet(src)), out, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    want = {r.name: bytes(r.payload) for r in wired(packets).collect()}
    assert {p: open(f"{out}/{p}", "rb").read() for p in os.listdir(out) if p[0] != "_"} == want and len(want) == 30


def test_tasks_without_rows_write_no_segment(spark, tmp_path):
    """a task that had no rows gave Spark no message, which failed the write."""
    folder = str(tmp_path / "session")
    frames = spark.createDataFrame([frame(n) for n in range(6)], C.FRAME).where("frame_id < 3").repartitionByRange(3, "frame_id").where("frame_id <> 1")
    C.write_capture(frames, folder)
    assert len(os.listdir(folder)) == 2 and all(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))
    assert sorted(r.frame_id for r in C.read_capture(spark, folder).collect()) == [0, 2]
    C.write_capture(frames.where("false"), folder)
    assert len(os.listdir(folder)) == 2
