"""WARC archives with an index: each record is one gzip member, and the index holds its archive, offset, length, URL and digest.

Writing yields the index; reading takes any selection of index rows, sorts it by place, joins neighbouring byte ranges into one read
each, and parses the records. Records with equal payloads become one response and revisits of it. Archives lie in the shared folder.

Cases: a null payload is an empty payload; a null URL leaves the URL header out; line breaks and other controls in a URL are
percent-encoded in its header (the index keeps it as it was); rows with equal id and equal payload are all responses; a null id never
becomes the response of others unless all ids of its payload are null; an empty table gives an empty index. Extra columns are not
archived. A lost executor's half-written archive has no index row and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import fresh_path, materialize

INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long, payload_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def filesystem(uri: str):
    """A file system and the path in it, for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without it."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    named = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": None if refers_to is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The named fields of one record and its payload (None in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    named["payload"] = block.partition(b"\r\n\r\n")[2] if named["WARC-Type"] == "response" else None
    return named


def with_originals(pages: DataFrame, min_bytes: int = 0, share: int = 1000) -> DataFrame:
    """Adds first_id: the smallest page_id among rows of the same payload, null where the payload is alone or too small.

    Payload groups are summed before the shuffle. The few groups that hold over one share-th of all rows (so at most that many) are
    joined by broadcast, all others by a shuffled join, so no task gets a hot group.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(html).alias("_key"), F.octet_length(html).alias("_bytes"))
    groups = keyed.where(F.col("_bytes") >= min_bytes).groupBy("_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n"))
    groups = materialize(groups.where("_n > 1"), "warc-groups")
    limit = pages.count() / share
    hot = groups.where(F.col("_n") > limit).select(F.col("_key").alias("_hot"), F.col("first_id").alias("_hot_id"))
    cold = groups.where(F.col("_n") <= limit).select(F.col("_key").alias("_cold"), F.col("first_id").alias("_cold_id"))
    out = keyed.join(F.broadcast(hot), (F.col("_key") == F.col("_hot")) & (F.col("_bytes") >= min_bytes), "left")
    spread = F.when(F.col("_hot").isNotNull(), F.concat_ws(":", "_key", F.xxhash64("page_id", "url"))).otherwise(F.col("_key"))
    out = out.withColumn("_at", spread).join(cold.hint("shuffle_hash"), (F.col("_at") == F.col("_cold")) & (F.col("_bytes") >= min_bytes), "left")
    return out.select("page_id", "url", "html", F.coalesce("_hot_id", "_cold_id").alias("first_id"))


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns the index, itself a table in the shared folder."""
    import pyarrow as pa

    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        out, name, at = None, "", 0
        names = [x.split(" ")[0] for x in INDEX.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                    page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                    payload = (html.as_py() or "").encode()
                    digest = base32_sha1(payload)
                    refers = first if first is not None and first != page_id else None
                    data = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(page_id, url, payload, digest, refers, date)
                    member = data.compress(raw) + data.flush()
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    rows.append((f"{folder}/{name}", at, len(member), page_id, url, digest, "response" if refers is None else "revisit", refers, len(payload)))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return materialize(with_originals(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def coalesced(rows, gap: int, span: int) -> Iterator[tuple[str, int, int, list]]:
    """Rows sorted by place, as reads of (archive, start, end, rows): neighbours at most gap bytes apart share a read of about span
    bytes."""
    held: list = []
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > gap or row[1] + row[2] - held[0][1] > span):
            yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held
            held = []
        held.append(row)
    if held:
        yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held


def checked(x: dict) -> tuple[str, int]:
    """Digest and bytes of the full payload: of a response as worked out from the payload that was read, and held against its headers; of
    a revisit, which has none, as its headers tell."""
    digest, size = x["WARC-Payload-Digest"].removeprefix("sha1:"), int(x["X-Payload-Length"])
    if x["payload"] is None:
        return digest, size
    found = base32_sha1(x["payload"]), len(x["payload"])
    if found != (digest, size):
        raise ValueError(f"the payload of {x['WARC-Record-ID']} is not the one that its headers tell of")
    return found


def read_records(index: DataFrame, partition_bytes: int = 32 << 20, gap: int = 64 << 10, span: int = 4 << 20) -> DataFrame:
    """The records of the selected index rows, read back from their archives; a payload that differs from its digest raises an error."""
    import pyarrow as pa

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, -(-total // partition_bytes))
    placed = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [kinds[x.split(" ")[1]] for x in RECORD.split(", ")]
    number = lambda x: None if x is None else int(x)

    def places(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = ("", None)
        for archive, start, end, rows in coalesced(places(batches), gap, span):
            if opened[0] != archive:
                fs, path = filesystem(archive)
                opened = (archive, fs.open_input_file(path))
            data = opened[1].read_at(end - start, start)
            out = []
            for _, offset, length in rows:
                x = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                page_id, refers = number(x.get("X-Page-ID")), number(x.get("X-Refers-To-Page-ID"))
                out.append((page_id, x.get("WARC-Target-URI"), x["WARC-Type"], refers, *checked(x), x["payload"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return placed.mapInArrow(run, RECORD)
