"""Byte codecs: packet headers, quantised splat blobs, SPZ-style chunks, PLY and GLB. Rows in, bytes out, and back.

Layouts are the formats' own: little-endian, field order as in each docstring.
"""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stream and chunk formats.
PACKET_MAGIC = 0x48454D44
PACKET = struct.Struct("<IBBIII")  # magic, type, flags, frame_id, timestamp_ms, payload_size
FLAG_HAS_VIDEO, FLAG_IS_FINAL = 1, 2
BLOB_MAGIC = 0x48454947
BLOB = struct.Struct("<IBBHI6f")  # magic, version, flags, reserved, count, bounding box low and high
BLOB_DC = 1  # flag: the first three colour coefficients alone, else all 48 and three bytes of padding
CHUNK_MAGIC = 0x005A5053
CHUNK = struct.Struct("<IIIHH")  # magic, version, count, colour degree, flags
CHUNK_DELTA = 1
GLB = struct.Struct("<III")
GLB_MAGIC, GLB_JSON, GLB_BIN = 0x46546C67, 0x4E4F534A, 0x004E4942


def packet(kind: int, flags: int, frame_id: int, timestamp_ms: int, payload: bytes) -> bytes:
    return PACKET.pack(PACKET_MAGIC, kind, flags, frame_id & 0xFFFFFFFF, timestamp_ms & 0xFFFFFFFF, len(payload)) + payload


def parse_header(data: bytes) -> tuple[int, int, int, int, int] | None:
    """(type, flags, frame_id, timestamp_ms, payload size), or None for short or foreign bytes."""
    if len(data) < PACKET.size:
        return None
    magic, *rest = PACKET.unpack_from(data)
    return tuple(rest) if magic == PACKET_MAGIC else None


def parse_packets(data: bytes) -> tuple[list[tuple], bytes]:
    """Whole packets at the front of a byte stream, and what is left; a foreign header drops the rest."""
    out, at = [], 0
    while len(data) - at >= PACKET.size:
        head = parse_header(data[at : at + PACKET.size])
        if head is None:
            return out, b""
        end = at + PACKET.size + head[4]
        if end > len(data):
            break
        out.append((*head[:4], data[at + PACKET.size : end]))
        at = end
    return out, data[at:]


def le(value: Column, size: int) -> Column:
    """An unsigned number as little-endian bytes, without Python."""
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    pairs = [F.substring(text, 2 * i + 1, 2) for i in range(size)]
    return F.unhex(F.concat(*reversed(pairs)))


def packet_column(kind: Column, flags: Column, frame_id: Column, timestamp_ms: Column, payload: Column) -> Column:
    u32 = lambda c: c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.concat(le(F.lit(PACKET_MAGIC), 4), le(kind, 1), le(flags, 1), le(u32(frame_id), 4), le(u32(timestamp_ms), 4), le(F.octet_length(payload), 4), payload)


def _u(x, top: int) -> np.ndarray:
    return np.floor(np.clip(x, 0, 1) * top + 0.5)


def _record(full: bool) -> np.dtype:
    return np.dtype([("p", "<u2", 3), ("s", "<u2", 3), ("q", "i1", 4), ("o", "u1"), ("c", "u1", 48 if full else 3)] + ([("pad", "u1", 3)] if full else []))


def quantise(positions, scales, quats, opacity, sh) -> bytes:
    """Worker blob: header, then a record for each splat: 3 u16 in the box, 3 u16 of log scale in [-10, 2], 4 i8, u8 opacity, u8 colours."""
    p = np.asarray(positions, np.float64).reshape(-1, 3)
    sh = np.asarray(sh, np.float64).reshape(len(p), -1)
    full = sh.shape[1] > 3
    low, high = (p.min(0), p.max(0)) if len(p) else (np.zeros(3), np.zeros(3))
    pad = (high - low) * 0.001 + 1e-6
    low, high = (low - pad).astype(np.float32), (high + pad).astype(np.float32)
    rec = np.zeros(len(p), _record(full))
    rec["p"] = _u((p - low) / (high - low), 65535)
    rec["s"] = _u((np.log(np.maximum(scales, 1e-10)) + 10) / 12, 65535)
    rec["q"] = np.clip(np.asarray(quats) * 127, -127, 127).astype(np.int8)
    rec["o"] = _u(np.asarray(opacity), 255)
    rec["c"][:, : sh.shape[1]] = _u((sh + 5) / 10, 255)
    return BLOB.pack(BLOB_MAGIC, 1, 0 if full else BLOB_DC, 0, len(p), *low, *high) + rec.tobytes()


def dequantise(data: bytes) -> dict[str, np.ndarray] | None:
    """The blob's splats, or None if it is foreign, cut off or of another version."""
    if data is None or len(data) < BLOB.size:
        return None
    magic, version, flags, _, n, *box = BLOB.unpack_from(data)
    kind = _record(not flags & BLOB_DC)
    if magic != BLOB_MAGIC or version != 1 or len(data) != BLOB.size + n * kind.itemsize:
        return None
    rec = np.frombuffer(data, kind, n, BLOB.size)
    low, high = np.array(box[:3]), np.array(box[3:])
    q = rec["q"] / 127.0
    size = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(size > 1e-8, q / np.maximum(size, 1e-8), [1.0, 0, 0, 0])
    return {"position": low + rec["p"] / 65535 * (high - low), "scale": np.exp(rec["s"] / 65535 * 12 - 10), "rotation": q, "opacity": rec["o"] / 255, "sh": rec["c"] / 255 * 10 - 5}


def spz_keyframe(positions, scales, quats, opacity, sh) -> bytes:
    """Chunk of a keyframe, gzip of: header, box, then by column u16 places, f32 scales, u8 rotations, u8 opacities, u8 colours."""
    p = np.asarray(positions, np.float64).reshape(-1, 3)
    n = len(p)
    low, high = (p.min(0), p.max(0)) if n else (np.zeros(3), np.zeros(3))
    span = np.where(high - low < 1e-12, 1, high - low)
    r = lambda x, top, kind: np.round(np.clip(x, 0, 1) * top).astype(kind)
    sh = np.asarray(sh, np.float64).reshape(n, -1)
    body = [
        np.concatenate([low, high]).astype("<f4").tobytes(),
        r((p - low) / span, 65535, "<u2").T.tobytes(),
        np.asarray(scales, "<f4").reshape(n, 3).T.tobytes(),
        r((np.asarray(quats).reshape(n, 4) + 1) / 2, 255, "u1").T.tobytes(),
        r(np.asarray(opacity), 255, "u1").tobytes(),
        r((sh + 5) / 10, 255, "u1").T.tobytes(),
    ]
    degree = int(round((sh.shape[1] / 3) ** 0.5)) - 1 if n else 0
    return gzip.compress(CHUNK.pack(CHUNK_MAGIC, 1, n, degree, 0) + b"".join(body), 6, mtime=0)


def spz_decode(data: bytes) -> dict[str, np.ndarray]:
    raw = gzip.decompress(data)
    magic, _, n, degree, flags = CHUNK.unpack_from(raw)
    if magic != CHUNK_MAGIC or flags & CHUNK_DELTA:
        raise ValueError("not a keyframe chunk")
    at = CHUNK.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    box = take("<f4", 6)
    p = take("<u2", 3 * n).reshape(3, n).T
    scales = take("<f4", 3 * n).reshape(3, n).T
    q = take("u1", 4 * n).reshape(4, n).T / 255 * 2 - 1
    opacity = take("u1", n) / 255
    colours = (degree + 1) ** 2 * 3
    return {"position": box[:3] + p / 65535 * (box[3:] - box[:3]), "scale": scales, "rotation": q, "opacity": opacity, "sh": take("u1", colours * n).reshape(colours, n).T / 255 * 10 - 5}


def spz_delta(key: dict, frame: dict) -> bytes:
    """Chunk of a frame against its keyframe, by position: box of the moves, u16 moves, u8 turns (clamped to [-1, 1]), u8 opacities."""
    n = len(frame["opacity"])
    if n != len(key["opacity"]):
        raise ValueError("a delta needs as many splats as its keyframe")
    moves, turns = (np.asarray(frame[k] - key[k], np.float64) for k in ("position", "rotation"))
    low, high = (moves.min(0), moves.max(0)) if n else (np.zeros(3), np.zeros(3))
    span = np.where(high - low < 1e-12, 1, high - low)
    body = [
        np.concatenate([low, high]).astype("<f4").tobytes(),
        np.round(np.clip((moves - low) / span, 0, 1) * 65535).astype("<u2").T.tobytes(),
        np.round((np.clip(turns, -1, 1) + 1) / 2 * 255).astype("u1").T.tobytes(),
        np.round(np.clip(frame["opacity"], 0, 1) * 255).astype("u1").tobytes(),
    ]
    return gzip.compress(CHUNK.pack(CHUNK_MAGIC, 1, n, 0, CHUNK_DELTA) + b"".join(body), 6, mtime=0)


def apply_delta(key: dict, data: bytes) -> dict:
    """The frame that a delta chunk makes of its keyframe; scales and colours stay the keyframe's."""
    raw = gzip.decompress(data)
    _, _, n, *_ = CHUNK.unpack_from(raw)
    at = CHUNK.size
    box = np.frombuffer(raw, "<f4", 6, at)
    moves = box[:3] + np.frombuffer(raw, "<u2", 3 * n, at + 24).reshape(3, n).T / 65535 * (box[3:] - box[:3])
    turns = np.frombuffer(raw, "u1", 4 * n, at + 24 + 6 * n).reshape(4, n).T / 255 * 2 - 1
    return key | {"position": key["position"] + moves, "rotation": key["rotation"] + turns, "opacity": np.frombuffer(raw, "u1", n, at + 24 + 10 * n) / 255}


GLTF_BUFFER_MAGIC = 0x5A505347


def spz_buffer(chunk: bytes, splats: int, frame: int = 0) -> bytes:
    """A chunk as a glTF buffer: 20-byte header (magic, version, frame, splats, size), the bytes, and padding to four."""
    return struct.pack("<IIIII", GLTF_BUFFER_MAGIC, 1, frame, splats, len(chunk)) + chunk + b"\0" * (-len(chunk) % 4)


def ply(columns: list[str], values: np.ndarray, binary: bool = True) -> bytes:
    """A vertex list with float properties, binary or with six decimals."""
    head = f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement vertex {len(values)}\n" + "".join(f"property float {c}\n" for c in columns) + "end_header\n"
    if binary:
        return head.encode() + np.ascontiguousarray(values, "<f4").tobytes()
    return (head + "".join(" ".join(f"{v:.6f}" for v in row) + "\n" for row in values)).encode()


def parse_ply(data: bytes) -> tuple[list[str], np.ndarray]:
    """Names and float values of a vertex list, binary or text."""
    end = data.index(b"end_header\n") + 11
    lines = [line.split() for line in data[:end].decode("ascii").splitlines()]
    if lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    names = [line[2] for line in lines if line[:2] == ["property", "float"]]
    n = next(int(line[2]) for line in lines if line[:2] == ["element", "vertex"])
    if any(line[1] == "binary_little_endian" for line in lines if line[0] == "format"):
        values = np.frombuffer(data, "<f4", n * len(names), end)
    else:
        values = np.array(data[end:].split(), "<f4")
    return names, values.reshape(n, len(names))


def glb(document: dict, buffer: bytes) -> bytes:
    """A binary glTF of a JSON chunk and, if there are bytes, a binary one, both padded to four."""
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    buffer += b"\0" * (-len(buffer) % 4)
    total = 12 + 8 + len(text) + (8 + len(buffer) if buffer else 0)
    out = GLB.pack(GLB_MAGIC, 2, total) + struct.pack("<II", len(text), GLB_JSON) + text
    return out + (struct.pack("<II", len(buffer), GLB_BIN) + buffer if buffer else b"")


class _Buffer:
    """The binary part of a glTF file: views and accessors as parts come in, each at a multiple of four bytes."""

    def __init__(self):
        self.data, self.views, self.accessors = bytearray(), [], []

    def view(self, part: bytes, target: int | None = None) -> int:
        self.data += b"\0" * (-len(self.data) % 4)
        self.views.append({"buffer": 0, "byteOffset": len(self.data), "byteLength": len(part)} | ({"target": target} if target else {}))
        self.data += part
        return len(self.views) - 1

    def accessor(self, values: np.ndarray, kind: str, component: int, target: int | None = None, bounds: bool = False, normalised: bool = False) -> int:
        own = {"bufferView": self.view(np.ascontiguousarray(values).tobytes(), target), "componentType": component, "count": len(values), "type": kind}
        if bounds and len(values):
            own |= {"min": np.min(values, 0).tolist(), "max": np.max(values, 0).tolist()}
        self.accessors.append(own | ({"normalized": True} if normalised else {}))
        return len(self.accessors) - 1

    def document(self, **more) -> dict:
        return {"asset": {"version": "2.0", "generator": "voxelweave"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], **more, "accessors": self.accessors, "bufferViews": self.views, "buffers": [{"byteLength": len(self.data)}]}


_EMPTY = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}]}
_FLOAT, _UINT, _UBYTE = 5126, 5125, 5121  # component types; 34962 and 34963 are the targets of vertices and indices: fixed values


def mesh_glb(positions: np.ndarray, normals: np.ndarray | None, indices: np.ndarray, uv: np.ndarray | None = None, colors: np.ndarray | None = None, texture: bytes | None = None, mime: str = "image/png") -> bytes:
    """A mesh with positions and u32 indices, and whatever of normals, texture coordinates, 8-bit RGBA vertex colours and an embedded
    texture there is; an empty mesh has a scene without nodes."""
    if not len(positions) or not len(indices):
        return glb(_EMPTY, b"")
    b = _Buffer()
    attributes = {"POSITION": b.accessor(np.asarray(positions, "<f4"), "VEC3", _FLOAT, 34962, bounds=True)}
    if normals is not None:
        attributes["NORMAL"] = b.accessor(np.asarray(normals, "<f4"), "VEC3", _FLOAT, 34962)
    if uv is not None:
        attributes["TEXCOORD_0"] = b.accessor(np.asarray(uv, "<f4"), "VEC2", _FLOAT, 34962)
    if colors is not None:
        attributes["COLOR_0"] = b.accessor(np.asarray(colors, "u1"), "VEC4", _UBYTE, 34962, normalised=True)
    primitive = {"attributes": attributes, "indices": b.accessor(np.asarray(indices, "<u4").reshape(-1), "SCALAR", _UINT, 34963)}
    more: dict = {"meshes": [{"primitives": [primitive]}]}
    if texture is not None and uv is not None:
        more |= {"images": [{"bufferView": b.view(texture), "mimeType": mime}], "samplers": [{}], "textures": [{"source": 0, "sampler": 0}], "materials": [{"pbrMetallicRoughness": {"baseColorTexture": {"index": 0}, "metallicFactor": 0.0, "roughnessFactor": 1.0}}]}
        primitive["material"] = 0
    return glb(b.document(**more), bytes(b.data))


#: Names of the splat attributes in a glTF point primitive, and of the two extensions: fixed values.
SPLAT_EXTENSION, CHUNK_EXTENSION = "KHR_gaussian_splatting", "KHR_gaussian_splatting_compression_spz"


def splats_glb(positions, scales, quats, opacity, sh) -> bytes:
    """Splats as points with their attributes as they are: rotation x, y, z, w, log scale, opacity, and colour bands of three by degree."""
    p = np.asarray(positions, "<f4").reshape(-1, 3)
    if not len(p):
        return glb(_EMPTY, b"")
    b = _Buffer()
    q = np.asarray(quats, "<f4").reshape(-1, 4)
    sh = np.asarray(sh, "<f4").reshape(len(p), -1, 3)
    attributes = {
        "POSITION": b.accessor(p, "VEC3", _FLOAT, 34962, bounds=True),
        "_ROTATION": b.accessor(q[:, [1, 2, 3, 0]], "VEC4", _FLOAT, 34962),
        "_SCALE": b.accessor(np.log(np.maximum(np.asarray(scales, "<f4").reshape(-1, 3), 1e-10)), "VEC3", _FLOAT, 34962),
        "_OPACITY": b.accessor(np.asarray(opacity, "<f4").reshape(-1), "SCALAR", _FLOAT, 34962),
    }
    degree = int(round(sh.shape[1] ** 0.5)) - 1
    for d in range(degree + 1):
        for i in range(2 * d + 1):
            attributes[f"_SH_DEGREE_{d}_COEF_{i}"] = b.accessor(sh[:, d * d + i], "VEC3", _FLOAT, 34962)
    primitive = {"mode": 0, "attributes": attributes, "extensions": {SPLAT_EXTENSION: {"degree": degree}}}
    return glb(b.document(extensionsUsed=[SPLAT_EXTENSION], meshes=[{"primitives": [primitive]}]), bytes(b.data))


def chunk_glb(chunk: bytes, splats: int, frame: int = 0) -> bytes:
    """A compressed chunk inside a glTF file, with its buffer header, as points whose attributes the extension unpacks."""
    if not splats:
        return glb(_EMPTY, b"")
    b = _Buffer()
    view = b.view(spz_buffer(chunk, splats, frame))
    primitive = {"mode": 0, "attributes": {}, "extensions": {SPLAT_EXTENSION: {"extensions": {CHUNK_EXTENSION: {"bufferView": view, "count": splats}}}}}
    return glb(b.document(extensionsUsed=[SPLAT_EXTENSION, CHUNK_EXTENSION], extensionsRequired=[CHUNK_EXTENSION], meshes=[{"primitives": [primitive]}]), bytes(b.data))


def floats(data: bytes, count: int) -> np.ndarray:
    """A flat float buffer as count rows; its stride is what the length gives."""
    values = np.frombuffer(data, "<f4")
    return values.reshape(count, -1) if count else values.reshape(0, 0)


def parse_glb(data: bytes) -> tuple[dict, bytes]:
    """The document and the binary chunk (empty if there is none) of a binary glTF."""
    magic, version, total = GLB.unpack_from(data)
    if magic != GLB_MAGIC or version != 2 or total != len(data):
        raise ValueError("not a binary glTF")
    size, _ = struct.unpack_from("<II", data, 12)
    document, at = json.loads(data[20 : 20 + size]), 20 + size
    return document, data[at + 8 :] if at < total else b""
