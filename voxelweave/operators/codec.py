"""Codecs over tables: one payload row for each frame, and rows back from payloads. A frame's splats are bounded by its budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from voxelweave.functions import binary as B

SPLAT = "splat_id long, px double, py double, pz double, sx double, sy double, sz double, qw double, qx double, qy double, qz double, opacity double, sh array<double>"
_GROUPS = (["px", "py", "pz"], ["sx", "sy", "sz"], ["qw", "qx", "qy", "qz"])


def _arrays(p: pd.DataFrame) -> tuple:
    p = p.sort_values("splat_id")
    return (*(p[g].to_numpy(float) for g in _GROUPS), p["opacity"].to_numpy(float), np.stack(p["sh"].to_list()))


def encode_frames(splats: DataFrame, how: str = "blob", budget: int = 500_000) -> DataFrame:
    """(frame_id, splats, payload): quantised blobs or keyframe chunks. Frames over the budget are refused, not cut."""
    make = {"blob": B.quantise, "spz": B.spz_keyframe}[how]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > budget:
            raise ValueError(f"a frame has over {budget} splats")
        return pd.DataFrame({"frame_id": [p["frame_id"].iloc[0]], "splats": [len(p)], "payload": [make(*_arrays(p))]})

    return splats.groupBy("frame_id").applyInPandas(run, "frame_id long, splats long, payload binary")


def decode_frames(payloads: DataFrame, how: str = "blob") -> DataFrame:
    """Splat rows (numbered from 0 in each frame) of payload rows; bad blobs give none."""
    read = {"blob": B.dequantise, "spz": B.spz_decode}[how]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame_id, payload in zip(batch["frame_id"], batch["payload"], strict=True):
                x = read(payload)
                if x is None or not len(x["opacity"]):
                    continue
                cols = np.concatenate([x["position"], x["scale"], x["rotation"], x["opacity"][:, None]], 1)
                out = pd.DataFrame(cols, columns=[c for g in _GROUPS for c in g] + ["opacity"])
                out.insert(0, "splat_id", range(len(out)))
                out.insert(0, "frame_id", frame_id)
                out["sh"] = list(x["sh"])
                yield out

    return payloads.select("frame_id", "payload").mapInPandas(run, f"frame_id long, {SPLAT}")


def encode_sequence(splats: DataFrame, interval: int, forced: DataFrame | None = None) -> DataFrame:
    """(frame_id, key_id, is_keyframe, payload): every so-many-th frame a keyframe chunk, the others deltas against their last one if
    they hold the same splats by id, else keyframes too; so are the frames asked for in forced (frame_id). A group is one keyframe
    interval, so intervals run in parallel."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows, key = [], None
        for frame_id, f in p.groupby("frame_id", sort=True):
            ids = f["splat_id"].sort_values().to_numpy()
            a = _arrays(f)
            own = {"position": a[0], "scale": a[1], "rotation": a[2], "opacity": a[3], "sh": a[4]}
            if key is None or f["forced"].iloc[0] or not np.array_equal(ids, key[2]):
                data = B.spz_keyframe(*a)
                key = (frame_id, B.spz_decode(data), ids)
                rows.append((frame_id, frame_id, True, data))
            else:
                rows.append((frame_id, key[0], False, B.spz_delta(key[1], own)))
        return pd.DataFrame(rows, columns=["frame_id", "key_id", "is_keyframe", "payload"])

    marked = splats.withColumn("forced", F.lit(False))
    if forced is not None:
        asked = forced.select("frame_id", F.lit(True).alias("_f")).distinct()
        marked = splats.join(asked, "frame_id", "left").withColumn("forced", F.coalesce("_f", F.lit(False))).drop("_f")
    return marked.withColumn("gop", F.floor(F.col("frame_id") / interval)).groupBy("gop").applyInPandas(run, "frame_id long, key_id long, is_keyframe boolean, payload binary")


def encode_deltas(key: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, splats, payload): delta chunks of frames that hold the same splats as a keyframe (splat rows of one frame)."""

    def run(name: tuple, k: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if f.empty:
            return pd.DataFrame(columns=["frame_id", "splats", "payload"])
        was = B.spz_decode(B.spz_keyframe(*_arrays(k)))
        a = _arrays(f)
        own = {"position": a[0], "rotation": a[2], "opacity": a[3]}
        return pd.DataFrame({"frame_id": [f["frame_id"].iloc[0]], "splats": [len(f)], "payload": [B.spz_delta(was, own)]})

    ids = frames.select("frame_id").distinct().withColumnRenamed("frame_id", "_for")
    k = key.drop("frame_id").crossJoin(F.broadcast(ids))  # a row for each frame
    return k.groupBy("_for").cogroup(frames.withColumn("_for", F.col("frame_id")).groupBy("_for")).applyInPandas(run, "frame_id long, splats long, payload binary")


def wire(packets: DataFrame) -> DataFrame:
    """Adds wire: the packet's header and payload as bytes. packets: kind, flags, frame_id, timestamp_ms, payload."""
    return packets.withColumn("wire", B.packet_column(*[F.col(c) for c in ("kind", "flags", "frame_id", "timestamp_ms", "payload")]))


def unwire(streams: DataFrame, data: str = "wire") -> DataFrame:
    """Packet rows of byte-stream rows; what is left of a stream after its last whole packet is dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [p for d in batch[data] for p in B.parse_packets(bytes(d) if d is not None else b"")[0]]
            yield pd.DataFrame(rows, columns=["kind", "flags", "frame_id", "timestamp_ms", "payload"])

    return streams.select(data).mapInPandas(run, "kind int, flags int, frame_id long, timestamp_ms long, payload binary")


class UnpackPackets:
    """The whole packets of one byte stream, in order, and a last row with what is left after them, if anything is: the bytes of a packet
    that is not complete yet (cut), or foreign ones, after which nothing is read. A null stream has no rows."""

    def eval(self, data: bytes):
        if data is None:
            return
        data, at = bytes(data), 0
        while at < len(data):
            head = B.parse_header(data[at : at + B.PACKET.size])
            end = at + B.PACKET.size + (head[4] if head else 0)
            if head is None or end > len(data):
                cut = head is not None or B.PACKET.pack(B.PACKET_MAGIC, 0, 0, 0, 0, 0)[:4].startswith(data[at : at + 4])
                yield None, None, None, None, data[at:], "cut" if cut else "foreign"
                return
            yield (*head[:4], data[at + B.PACKET.size : end], None)
            at = end


def register_packets(spark, name: str = "unpack_packets") -> None:
    """Makes the table function usable in SQL: SELECT .. FROM streams, LATERAL unpack_packets(data)."""
    spark.udtf.register(name, udtf(UnpackPackets, returnType="kind int, flags int, frame_id long, timestamp_ms long, payload binary, rest string"))


def dispatch(packets: DataFrame) -> dict[str, DataFrame]:
    """Packets by what they carry: end markers first, then by type; unknown types are in none."""
    final = F.col("flags").bitwiseAND(F.lit(B.FLAG_IS_FINAL)) != 0
    rest = packets.where(~final)
    return {"end": packets.where(final), "splats": rest.where("kind IN (0, 1)"), "video": rest.where("kind = 2"), "manifest": rest.where("kind = 3").withColumn("json", F.decode("payload", "UTF-8"))}
