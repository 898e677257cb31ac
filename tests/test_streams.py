"""Synchronisation, multiplexing, codecs and registry."""

import json

import numpy as np
import pytest

from voxelweave.functions import binary as B
from voxelweave.operators import backend, codec, sync, tracker
from voxelweave.plans import registry
from voxelweave.sources import readers, writers
from voxelweave.sources import views as V
from voxelweave.streaming import stateful as T


def test_frame_sync_rules():
    s = T.FrameSync(4)
    assert [s.push(1, c) for c in (2, 0, 3, 1)] == [None, None, None, 1]
    s = T.FrameSync(2)
    assert [s.push(*x) for x in ((1, 0), (2, 0), (2, 1), (1, 1))] == [None, None, 2, 1]
    s = T.FrameSync(4, pending=3)
    for f in (1, 1, 2, 3, 4):
        s.push(f, len(s.pending.get(f, ())))
    assert sorted(s.pending) == [2, 3, 4] and s.dropped == 2
    assert T.FrameSync(4, 3, json.loads(json.dumps(s.state()))).pending == s.pending


def test_quorum_rules():
    q = T.Quorum(4, 3, timeout_ms=200)
    assert q.push(1, 0, 0) == [] == q.push(1, 0, 1) and q.push(1, 1, 2) == []
    assert q.push(1, 2, 3) == [(1, "quorum", [0, 1, 2], 3)]
    assert q.push(1, 3, 4) == [(1, "late", [3], 4)]
    assert q.push(2, 0, 10) == [] and q.tick(211) == [(2, "timeout", [0], 211)]
    many = [r for f in range(10, 16) for r in q.push(f, 0, 300)]
    assert many and all(r[1] == "in flight" for r in many)
    assert {r[1] for r in q.drain(301)} == {"drain"}


def test_mux_rules():
    m = T.Mux(500)
    assert m.push("video", 5, 0) == []
    assert m.push("keyframe", 5, 10) == [("keyframe", 5, 10), ("video", 5, 0)]
    assert m.push("video", 4, 20) == [("video", 4, 20)]
    m.push("video", 9, 30)
    m.push("delta", 6, 600)
    assert m.expired == 1
    m.push("video", 11, 610)
    assert m.flush() == [("video", 11, 610), ("end", -1, -1)]
    clock = T.KeyframeClock(3)
    assert [clock.push(i == 4) for i in range(7)] == [True, False, False, True, True, False, False]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    rows = [("a", f, c) for f in range(6) for c in range(3) if (f, c) != (2, 1)]
    expect = [f for s in [T.FrameSync(3)] for _, f, c in rows if s.push(f, c) is not None]
    frame = spark.createDataFrame(rows, "rig string, frame_id long, camera_index long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = T.sync_stream(stream, 3).writeStream.format("memory").queryName("synced").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted(r.frame_id for r in spark.table("synced").collect()) == sorted(expect)


def _run(df, name, tmp_path, **trigger):
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(**trigger).start()


def _stream(spark, frame, path):
    frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_mux_and_byte_streams_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    rows = [("a", k, f, t) for t, (k, f) in enumerate([("video", 1), ("video", 2), ("keyframe", 1), ("video", 3), ("delta", 2), ("end", -1)])]
    m = T.Mux(500)
    want = [r for _, k, f, t in rows for r in (m.flush() if k == "end" else m.push(k, f, t))]
    frame = spark.createDataFrame(rows, "rig string, kind string, frame_id long, timestamp_ms long")
    q = _run(T.mux_stream(_stream(spark, frame, str(tmp_path / "mux"))), "muxed", tmp_path, availableNow=True)
    q.awaitTermination(120)
    assert [(r.kind, r.frame_id, r.timestamp_ms) for r in spark.table("muxed").collect()] == want and want[-1][0] == "end"
    data = b"".join(B.packet(0, 0, i, 10 * i, bytes([i]) * i) for i in range(6))
    cuts = [("a", i, bytearray(data[a : a + 11])) for i, a in enumerate(range(0, len(data), 11))]
    for i in range(0, len(cuts), 4):  # several batches
        stream = _stream(spark, spark.createDataFrame(cuts[i : i + 4], "rig string, seq int, piece binary"), str(tmp_path / "bytes"))
    q = _run(T.packet_stream(stream), "pieces", tmp_path, availableNow=True)
    q.awaitTermination(120)
    got = {(r.frame_id, bytes(r.payload)) for r in spark.table("pieces").collect()}
    assert got == {(i, bytes([i]) * i) for i in range(6)}


def test_quorum_stream_releases_by_timer_and_drains(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    rows = [("a", 1, w, 10 * w) for w in (0, 1, 2)] + [("a", 2, 0, 50)]  # frame 2 waits for partials that never come
    frame = spark.createDataFrame(rows, "rig string, frame_id long, worker_id long, at_ms long")
    q = _run(T.quorum_stream(_stream(spark, frame, str(tmp_path / "in")), 4, 3, 200), "released", tmp_path, processingTime="0 seconds")
    try:
        until = time.time() + 60
        while time.time() < until and len(got := {(r.frame_id, r.why) for r in spark.table("released").collect()}) < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == {(1, "quorum"), (2, "timeout")}
    frame = spark.createDataFrame([*rows, ("a", 0, None, 60)], frame.schema)
    q = _run(T.quorum_stream(_stream(spark, frame, str(tmp_path / "in2")), 4, 3, 200, timers=False), "drained", tmp_path, availableNow=True)
    q.awaitTermination(120)
    assert [(r.frame_id, r.why) for r in spark.table("drained").collect()] == [(1, "quorum"), (2, "drain")]


def test_keyframe_and_matting_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    clock = T.KeyframeClock(3)
    want = [(i, clock.push(i == 4)) for i in range(7)]
    frame = spark.createDataFrame([("a", i, i == 4) for i in range(7)], "rig string, frame_id long, forced boolean")
    q = _run(T.keyframe_stream(_stream(spark, frame, str(tmp_path / "k")), 3), "keys", tmp_path, availableNow=True)
    q.awaitTermination(120)
    assert [(r.frame_id, r.is_keyframe) for r in spark.table("keys").collect()] == want
    m = T.MattingMean(0.6)
    assert m.push([1.0, 0.0]) == [1.0, 0.0] and m.push([0.0, 1.0]) == pytest.approx([0.6, 0.4]) and m.push([1.0]) == [1.0]


def test_merge_pipeline(spark, tmp_path):
    from voxelweave.streaming import merge as P

    rng = np.random.default_rng(0)
    at = rng.random((40, 3))
    q = np.tile([1.0, 0, 0, 0], (40, 1))
    blob = lambda move: bytearray(B.quantise(at + move, np.full((40, 3), 0.01), q, np.full(40, 0.9), np.zeros((40, 48))))
    schema = "frame_id long, worker_id long, timestamp_ms long, payload binary"
    for frames in ((1, 2), (3,), (4,)):
        rows = [(f, w, 10 * f, blob(0.0001 * f)) for f in frames for w in (0, 1)] + [(frames[-1], 2, 0, bytearray(b"broken"))]
        stream = _stream(spark, spark.createDataFrame(rows, schema), str(tmp_path / "in"))
    pipe = P.MergePipeline(spark, str(tmp_path / "out"), radius=0.01, interval=3)
    query = pipe.start(stream, str(tmp_path / "at"), {"availableNow": True})
    query.awaitTermination(300)
    assert query.exception() is None
    rows = [r.asDict() for r in spark.read.parquet(str(tmp_path / "out/metrics")).orderBy("batch").collect()]
    assert [r["frame_id"] for r in rows] == [2, 3, 4] and [r["skipped"] for r in rows] == [1, 0, 0]
    assert all(r["splats"] == 80 and r["merged"] == 40 and r["tracked"] == 40 for r in rows) and [r["is_keyframe"] for r in rows] == [True, False, False]
    wires = [bytes(r.wire) for r in spark.read.parquet(str(tmp_path / "out/packets")).orderBy("batch").collect()]
    heads = [B.parse_packets(w)[0][0] for w in wires]
    assert [(h[0], h[2], h[3]) for h in heads] == [(0, 2, 20), (1, 3, 30), (1, 4, 40)]
    moved = B.apply_delta(B.spz_decode(heads[0][4]), heads[1][4])
    assert len(moved["opacity"]) == 40
    last = spark.read.parquet(str(tmp_path / "in")).where("frame_id = 4")
    pipe.process(last, 2)  # a batch that runs again overwrites its own results
    assert spark.read.parquet(str(tmp_path / "out/metrics")).count() == 3


def test_windows_in_blocks_equal_plain_windows(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(2)), int(t), int(t) // 1000, int(rng.integers(1, 50)), str(rng.choice(["video", "delta", "keyframe"]))) for i, t in enumerate(np.sort(rng.integers(0, 900_000, 800)))]
    p = spark.createDataFrame(rows, "event_id long, worker_id long, timestamp_ms long, frame_id long, bytes long, type string")
    w = Window.partitionBy("worker_id").orderBy("timestamp_ms").rangeBetween(-2000, 0)
    want = {r.event_id: r.n for r in p.select("event_id", F.count("*").over(w).alias("n")).collect()}
    assert {r.event_id: r.frames for r in sync.trailing_count(p, 2000).collect()} == want
    keys = Window.partitionBy("worker_id").orderBy("timestamp_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.event_id: r.k for r in p.select("event_id", F.last(F.when(F.col("type") == "keyframe", F.col("event_id")), True).over(keys).alias("k")).collect()}
    assert {r.event_id: r.keyframe_id for r in sync.last_keyframe(p, block_ms=5000).collect()} == want
    fold = {}
    for i, k, t, _, b, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        fold[k] = fold.get(k, 0.0) * 0.9 + b * 0.1
    assert {r.worker_id: r.ema for r in sync.ema(p, "worker_id", ["timestamp_ms", "event_id"], "bytes", 0.1, block=7000).collect()} == pytest.approx(fold)
    held = {r.event_id: r.released_by for r in sync.hold_and_release(p, 500, block=16).collect()}
    geometry = sorted((k, f) for _, k, _, f, _, kind in rows if kind != "video")
    assert held == {i: min((g for w, g in geometry if w == k and g >= f), default=None) for i, k, _, f, _, kind in rows if kind == "video"}
    order = Window.partitionBy("worker_id").orderBy("frame_id", (F.col("type") == "video").cast("int"), "timestamp_ms", "event_id")
    want = {r.event_id: r.n for r in p.select("event_id", F.row_number().over(order).alias("n")).collect()}
    assert {r.event_id: r.place for r in sync.mux_places(p, block=16).collect()} == want
    for high, full in ((2, 3),):
        depth = {r.event_id: r.frames for r in sync.trailing_count(p, 2000).collect()}
        want, last = set(), {}
        for i, k, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
            action = "skip_video" if depth[i] >= full else "drop_delta" if depth[i] >= high else "none"
            if action not in ("none", last.get(k, "none")):  # draining is not told
                want.add((i, action))
            last[k] = action
        assert {(r.event_id, r.action) for r in sync.queue_actions(p, high, full, 2000).collect()} == want
        fewer = {(i, "reduce_splats" if a == "skip_video" else a) for i, a in want}
        assert {(r.event_id, r.action) for r in sync.queue_actions(p, high, full, 2000, video_tracks=0).collect()} == fewer
        kinds = {r[0]: r[5] for r in rows}
        assert {r.event_id: r.sent for r in sync.adapted(p, full, 2000).collect()} == {i: kinds[i] != "delta" or depth[i] < full for i in kinds}


def test_miss_streaks_of_many_workers(spark):
    rows = [(f, w) for w in range(1500) for f in ((0, 1, 4) if w else (0, 1, 2, 3, 4))]
    arrivals = spark.createDataFrame(rows, "frame_id long, worker_id long")
    got = sorted(tuple(r) for r in sync.miss_streaks(arrivals, 2).select("worker_id", "from_frame", "misses").collect())
    assert got == [(w, 2, 2) for w in range(1, 1500)]


def test_packets():
    p = B.packet(0, 1, 42, 12345, b"x" * 7)
    assert B.parse_header(p) == (0, 1, 42, 12345, 7) and B.parse_header(p[:17]) is None and B.parse_header(b"\0" + p) is None
    assert len(p) == 25
    got, rest = B.parse_packets(p + p + p[:5])
    assert [g[4] for g in got] == [b"x" * 7] * 2 and rest == p[:5]
    assert B.parse_packets(b"junk" * 10) == ([], b"")


def test_packet_columns_equal_bytes(spark):
    df = spark.createDataFrame([(1, 2, 42, 1 << 33 | 5, b"abc")], "kind int, flags int, frame_id long, timestamp_ms long, payload binary")
    wired = codec.wire(df)
    assert bytes(wired.first().wire) == B.packet(1, 2, 42, 1 << 33 | 5, b"abc")
    assert codec.unwire(wired).first().timestamp_ms == 5
    assert codec.dispatch(wired)["end"].count() == 1


def test_blob_and_chunk_round_trips():
    rng = np.random.default_rng(0)
    q = rng.normal(size=(50, 4))
    a = (rng.random((50, 3)), np.exp(rng.normal(size=(50, 3)) - 3), q / np.linalg.norm(q, axis=1, keepdims=True), rng.random(50), rng.normal(size=(50, 48)))
    blob = B.quantise(*a)
    assert len(blob) == 36 + 50 * 68
    x = B.dequantise(blob)
    assert abs(x["position"] - a[0]).max() < 1e-4 and abs(x["opacity"] - a[3]).max() < 0.003 and abs(x["rotation"] - a[2]).max() < 0.02
    assert abs(np.log(x["scale"]) - np.log(a[1])).max() < 1e-3 and abs(x["sh"] - a[4]).max() < 0.03
    assert B.dequantise(blob[:-1]) is None and B.dequantise(b"") is None and B.dequantise(b"\0" + blob[1:]) is None
    key = B.spz_decode(B.spz_keyframe(*a))
    assert abs(key["position"] - a[0]).max() < 1e-4 and np.allclose(key["scale"], a[1], rtol=1e-6)
    moved = key | {"position": key["position"] + 0.25}
    assert abs(B.apply_delta(key, B.spz_delta(key, moved))["position"] - moved["position"]).max() < 1e-6
    with pytest.raises(ValueError):
        B.spz_delta(key, {k: v[:3] for k, v in moved.items()})


def test_files():
    assert B.ply(["x"], np.array([[1.5]]), binary=False).endswith(b"1.500000\n")
    g = B.mesh_glb(np.eye(3), np.eye(3), np.array([0, 1, 2]))
    magic, version, size = B.GLB.unpack_from(g)
    assert (magic, version, size) == (B.GLB_MAGIC, 2, len(g)) and len(g) % 4 == 0
    doc, data = B.parse_glb(B.mesh_glb(np.eye(3), None, np.array([0, 1, 2]), np.zeros((3, 2)), np.full((3, 4), 255), b"png bytes"))
    assert set(doc["meshes"][0]["primitives"][0]["attributes"]) == {"POSITION", "TEXCOORD_0", "COLOR_0"} and doc["buffers"][0]["byteLength"] <= len(data)
    view = doc["bufferViews"][doc["images"][0]["bufferView"]]
    assert data[view["byteOffset"] :][: view["byteLength"]] == b"png bytes" and all(v["byteOffset"] % 4 == 0 for v in doc["bufferViews"])
    doc, data = B.parse_glb(B.splats_glb(np.eye(3), np.ones((3, 3)), np.tile([1.0, 0, 0, 0], (3, 1)), np.ones(3), np.zeros((3, 48))))
    names = doc["meshes"][0]["primitives"][0]["attributes"]
    assert len(names) == 4 + 16 and doc["meshes"][0]["primitives"][0]["mode"] == 0
    at = doc["bufferViews"][doc["accessors"][names["_ROTATION"]]["bufferView"]]
    assert np.frombuffer(data, "<f4", 4, at["byteOffset"]).tolist() == [0, 0, 0, 1]
    doc, data = B.parse_glb(B.chunk_glb(b"chunk", 3, 9))
    assert doc["extensionsRequired"] == [B.CHUNK_EXTENSION] and data[20:25] == b"chunk"
    assert B.parse_glb(B.splats_glb(np.zeros((0, 3)), np.zeros((0, 3)), np.zeros((0, 4)), np.zeros(0), np.zeros((0, 48))))[0]["scenes"] == [{"nodes": []}]
    assert B.floats(np.arange(6, dtype="<f4").tobytes(), 2).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert b'"nodes":[]' in B.mesh_glb(np.zeros((0, 3)), np.zeros((0, 3)), np.zeros(0))


def test_rig_and_manifest(spark, tmp_path):
    cam = {"serial": "1", "image_size": [4, 3], "camera_matrix": [[9, 0, 2], [0, 8, 1], [0, 0, 1]], "rvec": [0, 0, 0], "tvec": [1, 2, 3]}
    (tmp_path / "rig.json").write_text(json.dumps({"version": "1.0", "rig_id": "r", "cameras": [cam, cam | {"camera_index": 7}]}))
    rows = readers.rig(spark, str(tmp_path / "rig.json")).orderBy("camera_index").collect()
    assert [r.camera_index for r in rows] == [0, 7] and rows[0].fx == 9 and rows[0].rotation[0][0] == 1
    chunks = spark.createDataFrame([(0, 9, 100, True), (10, 19, 50, False)], "start_frame long, end_frame long, bytes long, is_keyframe boolean")
    m = json.loads(writers.manifest(chunks, 30).first().json)
    assert m["frames"] == 20 and m["total_bytes"] == 150 and m["mean_chunk_bytes"] == 75 and len(m["segments"]) == 2


def test_file_payloads(spark):
    s = V.splats(spark, "/root/testdata/sf0.001").where("frame_id < 2")
    n = {r.frame_id: r["count"] for r in s.groupBy("frame_id").count().collect()}
    for r in writers.ply_payloads(s).collect():
        head, body = bytes(r.payload).split(b"end_header\n", 1)
        assert head.count(b"property float") == 59 and len(body) == n[r.frame_id] * 59 * 4
    for compressed in (False, True):
        assert {r.frame_id for r in writers.splat_payloads(s, compressed).collect() if B.parse_glb(bytes(r.payload))} == set(n)
    v, f = V.height_field(spark, "/root/testdata/sf0.001")
    v = v.where("frame_id < 2").selectExpr("frame_id mesh_id", "vid % 576 vid", "x", "y", "z", "0 r", "1 g", "2 b")
    f = f.selectExpr("fid div 1152 mesh_id", "fid", "i0 % 576 i0", "i1 % 576 i1", "i2 % 576 i2").where("mesh_id < 2")
    docs = [B.parse_glb(bytes(r.payload))[0] for r in writers.mesh_payloads(f, v).collect()]
    assert len(docs) == 2 and all(d["accessors"][0]["count"] == 576 and "COLOR_0" in d["meshes"][0]["primitives"][0]["attributes"] for d in docs)
    samples = spark.createDataFrame([(0, 1, 2, [3, 0])], "rig long, frame_id long, target long, sources array<long>")
    meta = writers.sample_metadata(samples, V.cameras(spark, "/root/testdata/sf0.001")).first()
    assert [c["camera_index"] for c in json.loads(meta.cameras)["cameras"]] == [2, 3, 0] and json.loads(meta.metadata) == {"frame_id": 1, "target": 2, "sources": 2}


def test_backend_and_tracker(spark):
    frames = spark.createDataFrame([(c, f, "p") for f in (0, 1) for c in range(5 - 4 * f)], "camera_index int, frame_id long, path string")
    out = backend.infer(frames, backend.Cylinder(10))
    assert out.groupBy("frame_id", "pair").count().count() == 2
    s = V.splats(spark, "/root/testdata/sf0.001").where("frame_id = 1").drop("frame_id", "worker_id")
    first = tracker.start(s)
    again = tracker.step(first, s).collect()
    assert len(again) == first.count() and {r.age for r in again} == {2}
    gone = tracker.step(first, s.limit(0)).collect()
    assert all(r.age == -1 for r in gone)


def test_registry_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 90


def test_trailing_windows_only_grow(spark):
    """A window whose start moves is summed anew at each row; sums must come from windows that start with their block."""
    rows = [(i, i % 2, 700 * (i // 3), None if i == 5 else i) for i in range(200)] + [(900, 0, 500_000, None), (901, 0, 500_001, None)]
    p = spark.createDataFrame(rows, "event_id long, worker_id long, timestamp_ms long, bytes long")
    out = sync.bitrate(p)
    assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        seen = [x for x in rows if x[1] == r.worker_id and r.timestamp_ms - 2000 <= x[2] <= r.timestamp_ms]
        span, known = r.timestamp_ms - min(x[2] for x in seen), [x[3] for x in seen if x[3] is not None]
        assert r.bps == (sum(known) * 8000 / span if len(seen) >= 2 and span > 0 and known else None)
