"""Protocol-buffer wire format for messages that a field table describes, and the length-prefixed framing of message streams."""

from __future__ import annotations

import struct

#: Field tables of the capture service's messages: number -> (name, kind). A kind is "int" (varint, two's complement), "float", "double",
#: "bytes", "string" or a field table; a list around a kind means repeated. Names, numbers and kinds are fixed values of the format.
CAMERA_IMAGE = {
    1: ("camera_index", "int"),
    2: ("serial_number", "int"),
    3: ("width", "int"),
    4: ("height", "int"),
    5: ("channels", "int"),
    6: ("bit_depth", "int"),
    7: ("cpu_data", "bytes"),
    8: ("gpu_ptr", "int"),
    9: ("shm_handle", "string"),
    10: ("alpha_data", "bytes"),
    11: ("depth_data", "bytes"),
}
FRAME_METRICS = {
    1: ("capture_latency_ms", "double"),
    2: ("sync_delta_ms", "double"),
    3: ("dropped_frames", "int"),
    4: ("per_camera_latency_ms", ["double"]),
}
CAPTURE_FRAME = {
    1: ("frame_id", "int"),
    2: ("timestamp_ns", "int"),
    3: ("num_cameras", "int"),
    4: ("images", [CAMERA_IMAGE]),
    5: ("metrics", FRAME_METRICS),
}

#: A message in a stream: one byte that is 1 if it is compressed, then its length, high byte first.
FRAMING = struct.Struct(">BI")

_FIXED = {"double": (1, struct.Struct("<d")), "float": (5, struct.Struct("<f"))}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number does not end")
        byte = data[at]
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return n & ((1 << 64) - 1), at


def _numeric(kind) -> bool:
    return isinstance(kind, str) and (kind == "int" or kind in _FIXED)


def encode(values: dict, fields: dict) -> bytes:
    """A message of the values by name; what is None or missing is left out, and so is a number that is 0."""
    out = bytearray()
    for number, (name, kind) in fields.items():
        value = values.get(name)
        repeated = isinstance(kind, list)
        one = kind[0] if repeated else kind
        if repeated and _numeric(one) and value:  # numbers are packed
            body = b"".join(_varint(int(v)) if one == "int" else _FIXED[one][1].pack(v) for v in value)
            out += _varint(number << 3 | 2) + _varint(len(body)) + body
            continue
        for v in (value or []) if repeated else [value]:
            if v is None or (_numeric(one) and not v):
                continue
            if one == "int":
                out += _varint(number << 3) + _varint(int(v))
            elif _numeric(one):
                out += _varint(number << 3 | _FIXED[one][0]) + _FIXED[one][1].pack(v)
            else:
                body = encode(v, one) if isinstance(one, dict) else v.encode() if one == "string" else bytes(v)
                out += _varint(number << 3 | 2) + _varint(len(body)) + body
    return bytes(out)


def _empty(fields: dict) -> dict:
    return {name: [] if isinstance(kind, list) else 0 if kind == "int" else 0.0 if _numeric(kind) else None for name, kind in fields.values()}


def decode(data: bytes | memoryview, fields: dict) -> dict:
    """Values by name; scalars that are missing have their default, other fields None. Unknown fields are passed over; ValueError if the
    bytes are no such message."""
    data, at, out = memoryview(data), 0, _empty(fields)
    while at < len(data):
        tag, at = _read_varint(data, at)
        number, wire = tag >> 3, tag & 7
        name, kind = fields.get(number, (None, None))
        one = kind[0] if isinstance(kind, list) else kind
        if wire == 0:
            raw, at = _read_varint(data, at)
            found = [raw - (1 << 64) if raw >> 63 else raw]
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise ValueError("a number is cut off")
            found = [struct.unpack_from("<d" if wire == 1 else "<f", data, at)[0]]
            at += size
        elif wire == 2:
            size, at = _read_varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is cut off")
            body, at = data[at : at + size], at + size
            if isinstance(one, dict):
                found = [decode(body, one)]
            elif one == "int":
                found, k = [], 0
                while k < size:
                    raw, k = _read_varint(body, k)
                    found.append(raw - (1 << 64) if raw >> 63 else raw)
            elif _numeric(one):
                if size % _FIXED[one][1].size:
                    raise ValueError("a list of numbers is cut off")
                found = [v[0] for v in _FIXED[one][1].iter_unpack(body)]
            else:
                found = [str(body, "utf-8") if one == "string" else bytes(body)]
        else:
            raise ValueError(f"unknown kind of field: {wire}")
        if name is None:
            continue
        expected = {"int": (0, 2), "double": (1, 2), "float": (5, 2)}.get(one if isinstance(one, str) else "", (2,))
        if wire not in expected or (wire == 2 and expected != (2,) and not isinstance(kind, list)):
            raise ValueError(f"field {name} has another kind")
        if isinstance(kind, list):
            out[name] += found
        elif found:
            out[name] = found[-1]
    return out
