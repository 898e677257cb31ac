"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

The pieces of the model are the vocabulary's byte strings, each byte written as one printable character; a piece's score is its
negative rank, so the best-scored merge is the lowest rank. Normalisation is the identity. Texts are cut by the pattern first and
each match is encoded on its own; decoding maps ids back to bytes.

Cases: a null text is an empty text and gives no ids; nulls in other columns and extra columns stay as they are, names clashing with
the results excepted; repeated rows are encoded each; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens a worker remembers; beyond that it starts anew. Speed only: results don't depend on it.
MEMORY = 400_000

#: Text of these code points alone is cut by the standard library, which is faster; all other text by regex.
NARROW = 0x250

_STATE: dict = {}


def splitter(pattern: str):
    """findall of a pattern of \\p{L}, \\p{N} and \\s; both ways below cut alike."""
    import re
    import unicodedata

    import regex

    wide = regex.compile(pattern).findall
    spaces = "".join(c for c in map(chr, range(NARROW)) if regex.match(r"\s", c))
    chosen = lambda kind: "".join(re.escape(c) for c in map(chr, range(NARROW)) if unicodedata.category(c)[0] == kind)
    letters, digits, space = chosen("L"), chosen("N"), re.escape(spaces)
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
    narrow = re.compile(narrow.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")).findall if "\\p" not in narrow else wide
    beyond = re.compile(f"[^\x00-{chr(NARROW - 1)}]").search
    return lambda text: wide(text) if beyond(text) else narrow(text)


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(word)) for word, rank in (line.split() for line in f if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps: a piece's id is its rank")
    return [word for _, word in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(words: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is words[i] in the byte alphabet with score -i; the unknown piece comes last."""
    letters = byte_alphabet()
    out = bytearray()
    for rank, word in enumerate(words):
        out += _field(1, _field(1, "".join(letters[b] for b in word).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(40, len(words)) + _field(41, 0xFFFFFFFFFFFFFFFF) + _field(42, 0xFFFFFFFFFFFFFFFF) + _field(43, 0xFFFFFFFFFFFFFFFF))
    out += _field(3, _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes whole texts on one worker."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = splitter(pattern)
        letters = byte_alphabet()
        self.letters = dict(enumerate(letters))
        back = {c: b for b, c in enumerate(letters)}
        self.words = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]
        self.known: dict[str, list[int]] = {}

    def learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list(matches)
        mapped = [m.encode().decode("latin-1").translate(self.letters) for m in new]
        self.known.update(zip(new, self.pieces.encode(mapped, out_type=int, num_threads=1), strict=True))

    def encode(self, text: str) -> list[int]:
        matches = self.split(text)
        self.learn(set(matches))
        return list(chain.from_iterable(map(self.known.__getitem__, matches)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


def _codec(shipped) -> Codec:
    model, pattern = shipped.value
    if _STATE.get("key") != (len(model), hash(model), pattern):
        _STATE.update(key=(len(model), hash(model), pattern), codec=Codec(model, pattern))
    return _STATE["codec"]


def _ship(df: DataFrame, ranks_path: str, pattern: str):
    """The serialised model to every executor once; its size is that of the vocabulary, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast((serialise_model(read_ranks(ranks_path)), pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the array of ids of each whole text; a map without a shuffle. The text column is dropped, all others stay."""
    import pyarrow as pa

    shipped = _ship(df, ranks_path, pattern)
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for at in range(0, batch.num_rows, 256):
                ids = pa.array([codec.encode(t or "") for t in texts.slice(at, 256).to_pylist()], pa.list_(pa.int32()))
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in rest] + [ids], names=[*rest, out])

    return df.select(*rest, text).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that each array of ids stands for; null ids give empty bytes."""
    import pyarrow as pa

    shipped = _ship(df, ranks_path, pattern)
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = pa.array([codec.decode(x or ()) for x in part.column(part.schema.get_field_index(ids)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), data], names=[*rest, out])

    return df.select(*rest).mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the bytes."""
    return df.select(
        *[c for c in df.columns if c not in (ids, decoded, "n_tokens", "ids_sha256", "decoded_sha256")],
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
