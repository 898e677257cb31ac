"""Stateful stream operators: frame sync, quorum, multiplexing and tracking, keyed by rig or scene.

Each has a plain step class that holds the rules, and a runner that feeds it from `transformWithStateInPandas`; tests run the same
step classes in batch, so stream and batch results can be compared row by row. The state store must be RocksDB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FrameSync:
    """Frames of a rig until every camera has one; the lowest frames above the pending limit are dropped."""

    def __init__(self, cameras: int, pending: int = 25, state: dict | None = None):
        self.cameras, self.limit = cameras, pending
        state = state or {}
        self.pending: dict[int, set[int]] = {int(k): set(v) for k, v in state.get("pending", {}).items()}
        self.dropped = state.get("dropped", 0)

    def push(self, frame_id: int, camera: int) -> int | None:
        """The frame that this arrival completes."""
        held = self.pending.setdefault(frame_id, set())
        held.add(camera)
        if len(held) >= self.cameras:
            del self.pending[frame_id]
            return frame_id
        while len(self.pending) > self.limit:
            self.dropped += len(self.pending.pop(min(self.pending)))
        return None

    def state(self) -> dict:
        return {"pending": {k: sorted(v) for k, v in self.pending.items()}, "dropped": self.dropped}


class Quorum:
    """Partial results of a frame until enough distinct workers sent theirs, until a timeout since the first, or until too many frames
    are in flight. Workers that miss so many frames in a row count as dead until they send again; late partials are told apart."""

    def __init__(self, workers: int, quorum: int = 3, timeout_ms: int = 200, in_flight: int = 4, misses: int = 10, state: dict | None = None):
        self.workers, self.quorum, self.timeout, self.in_flight, self.most = workers, quorum, timeout_ms, in_flight, misses
        state = state or {}
        self.pending: dict[int, dict] = {int(k): v for k, v in state.get("pending", {}).items()}
        self.released: dict[int, int] = {int(k): v for k, v in state.get("released", {}).items()}
        self.missed: dict[int, int] = {int(k): v for k, v in state.get("missed", {}).items()}

    def needed(self) -> int:
        alive = self.workers - sum(m >= self.most for m in self.missed.values())
        return max(1, min(self.quorum, alive))

    def _release(self, frame_id: int, why: str, now: int) -> tuple:
        p = self.pending.pop(frame_id)
        self.released[frame_id] = now
        for w in range(self.workers):
            self.missed[w] = 0 if w in p["workers"] else self.missed.get(w, 0) + 1
        return frame_id, why, sorted(p["workers"]), now

    def tick(self, now: int) -> list[tuple]:
        out = [self._release(f, "timeout", now) for f in sorted(f for f, p in self.pending.items() if now - p["first"] >= self.timeout)]
        while len(self.pending) > self.in_flight:
            out.append(self._release(min(self.pending), "in flight", now))
        self.released = {f: t for f, t in self.released.items() if now - t < 50 * self.timeout}
        return out

    def push(self, frame_id: int, worker: int, now: int) -> list[tuple]:
        out = self.tick(now)
        self.missed[worker] = 0
        if frame_id in self.released:
            return [*out, (frame_id, "late", [worker], now)]
        p = self.pending.setdefault(frame_id, {"first": now, "workers": []})
        if worker not in p["workers"]:
            p["workers"].append(worker)
        if len(p["workers"]) >= self.needed():
            out.append(self._release(frame_id, "quorum", now))
        return out

    def drain(self, now: int) -> list[tuple]:
        return [self._release(f, "drain", now) for f in sorted(self.pending)]

    def state(self) -> dict:
        return {"pending": self.pending, "released": self.released, "missed": self.missed}


class Mux:
    """Geometry passes; video waits for geometry of its frame or a later one, and expires after so much media time."""

    def __init__(self, hold_ms: int = 500, state: dict | None = None):
        self.hold, state = hold_ms, state or {}
        self.held: list[list] = state.get("held", [])
        self.newest = state.get("newest", -1)
        self.expired = state.get("expired", 0)

    def push(self, kind: str, frame_id: int, timestamp_ms: int) -> list[tuple]:
        if kind == "video":
            if frame_id <= self.newest:
                return [("video", frame_id, timestamp_ms)]
            self.held.append([frame_id, timestamp_ms])
            out = []
        else:
            self.newest = max(self.newest, frame_id)
            out = [(kind, frame_id, timestamp_ms)] + [("video", f, t) for f, t in sorted(self.held) if f <= self.newest]
            self.held = [h for h in self.held if h[0] > self.newest]
        old = [h for h in self.held if timestamp_ms - h[1] > self.hold]
        self.expired += len(old)
        self.held = [h for h in self.held if h not in old]
        return out

    def flush(self) -> list[tuple]:
        out = [("video", f, t) for f, t in sorted(self.held)]
        self.held = []
        return [*out, ("end", -1, -1)]

    def state(self) -> dict:
        return {"held": self.held, "newest": self.newest, "expired": self.expired}


class KeyframeClock:
    """Whether a frame becomes a keyframe: the first, every so-many-th, or on request."""

    def __init__(self, interval: int, state: dict | None = None):
        self.interval, self.since = interval, (state or {}).get("since", None)

    def push(self, forced: bool = False) -> bool:
        key = forced or self.since is None or self.since + 1 >= self.interval
        self.since = 0 if key else self.since + 1
        return key

    def state(self) -> dict:
        return {"since": self.since}


def _processor(make, step, schema_names, timeout_ms: int | None = None, late=None):
    """A runner of a step class whose state is small: a few frames in flight, as JSON. With a timeout, late(machine) is asked for rows when
    so much time has passed without a row of the key."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Runner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("state", "json string")

        def _machine(self):
            return make(json.loads(self.held.get()[0]) if self.held.exists() else None)

        def _rows(self, key, found) -> pd.DataFrame:
            return pd.DataFrame([(key[0], *r) for r in found], columns=schema_names)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            machine = self._machine()
            out = [r for part in rows for row in part.itertuples(index=False) for r in step(machine, row)]
            self.held.update((json.dumps(machine.state()),))
            if timeout_ms is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + timeout_ms)
            yield self._rows(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            machine = self._machine()
            out = late(machine)
            self.held.update((json.dumps(machine.state()),))
            yield self._rows(key, out)

        def close(self) -> None:
            pass

    return Runner()


def sync_stream(arrivals: DataFrame, cameras: int, pending: int = 25) -> DataFrame:
    """(rig, frame_id) of frames as they complete. arrivals: rig string, frame_id, camera_index; a stream."""
    step = lambda m, r: [] if (f := m.push(int(r.frame_id), int(r.camera_index))) is None else [(f,)]
    runner = _processor(lambda s: FrameSync(cameras, pending, s), step, ["rig", "frame_id"])
    return arrivals.groupBy("rig").transformWithStateInPandas(runner, "rig string, frame_id long", "append", "none")


def quorum_stream(partials: DataFrame, workers: int, quorum: int = 3, timeout_ms: int = 200, timers: bool = True) -> DataFrame:
    """(rig, frame_id, why, workers, at_ms) as frames are released. partials: rig, frame_id, worker_id, at_ms; a stream. A row without a
    worker drains the rig. With timers, frames that no further row comes for are released after the timeout of processing time."""
    flat = lambda found: [(f, why, len(w), at) for f, why, w, at in found]
    step = lambda m, r: flat(m.drain(int(r.at_ms)) if pd.isna(r.worker_id) else m.push(int(r.frame_id), int(r.worker_id), int(r.at_ms)))
    late = lambda m: flat(m.tick(max((p["first"] for p in m.pending.values()), default=0) + timeout_ms))
    runner = _processor(lambda s: Quorum(workers, quorum, timeout_ms, state=s), step, ["rig", "frame_id", "why", "workers", "at_ms"], timeout_ms if timers else None, late)
    return partials.groupBy("rig").transformWithStateInPandas(runner, "rig string, frame_id long, why string, workers int, at_ms long", "append", "processingTime" if timers else "none")


def mux_stream(packets: DataFrame, hold_ms: int = 500) -> DataFrame:
    """(rig, kind, frame_id, timestamp_ms) in sending order. packets: rig, kind, frame_id, timestamp_ms; a stream. A packet of kind "end"
    flushes what is held and passes on as the last one."""
    step = lambda m, r: m.flush() if r.kind == "end" else m.push(r.kind, int(r.frame_id), int(r.timestamp_ms))
    runner = _processor(lambda s: Mux(hold_ms, s), step, ["rig", "kind", "frame_id", "timestamp_ms"])
    return packets.groupBy("rig").transformWithStateInPandas(runner, "rig string, kind string, frame_id long, timestamp_ms long", "append", "none")


class Reassembly:
    """Packets of a byte stream that comes in pieces: what is left after the last whole packet waits for the next piece."""

    def __init__(self, state: dict | None = None):
        self.rest = bytes.fromhex((state or {}).get("rest", ""))

    def push(self, piece: bytes) -> list[tuple]:
        from voxelweave.functions import binary as B

        found, self.rest = B.parse_packets(self.rest + piece)
        return found

    def state(self) -> dict:
        return {"rest": self.rest.hex()}


def packet_stream(pieces: DataFrame) -> DataFrame:
    """(rig, kind, flags, frame_id, timestamp_ms, payload) of byte streams. pieces: rig, seq, piece; a stream."""

    def step(machine, row):
        return machine.push(bytes(row.piece))

    names = ["rig", "kind", "flags", "frame_id", "timestamp_ms", "payload"]
    runner = _processor(Reassembly, step, names)
    return pieces.groupBy("rig").transformWithStateInPandas(runner, "rig string, kind int, flags int, frame_id long, timestamp_ms long, payload binary", "append", "none")


def keyframe_stream(frames: DataFrame, interval: int) -> DataFrame:
    """(rig, frame_id, is_keyframe) of frames as they come. frames: rig, frame_id, forced boolean; a stream."""
    step = lambda m, r: [(int(r.frame_id), bool(m.push(bool(r.forced))))]
    runner = _processor(lambda s: KeyframeClock(interval, s), step, ["rig", "frame_id", "is_keyframe"])
    return frames.groupBy("rig").transformWithStateInPandas(runner, "rig string, frame_id long, is_keyframe boolean", "append", "none")


class MattingMean:
    """A camera's alpha over time: each frame's values fold into the last ones; another resolution starts anew."""

    def __init__(self, keep: float = 0.6, state: dict | None = None):
        self.keep, self.before = keep, (state or {}).get("alpha")

    def push(self, alpha: list[float]) -> list[float]:
        if self.before is not None and len(self.before) == len(alpha):
            alpha = [self.keep * b + (1 - self.keep) * a for a, b in zip(alpha, self.before, strict=True)]
        self.before = list(alpha)
        return self.before

    def state(self) -> dict:
        return {"alpha": self.before}


def matting_stream(mattes: DataFrame, keep: float = 0.6) -> DataFrame:
    """(rig, frame_id, alpha) smoothed per camera. mattes: rig (a camera), frame_id, alpha array<double>; a stream."""
    step = lambda m, r: [(int(r.frame_id), m.push(list(r.alpha)))]
    runner = _processor(lambda s: MattingMean(keep, s), step, ["rig", "frame_id", "alpha"])
    return mattes.groupBy("rig").transformWithStateInPandas(runner, "rig string, frame_id long, alpha array<double>", "append", "none")
