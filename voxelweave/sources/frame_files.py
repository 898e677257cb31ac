"""A sink that writes files: df.write.format("frame_files").save(folder), or writeStream with a checkpoint.

Each row (name, payload) is a file of that name under the folder. Tasks stage their files and the driver moves them into place when the job
is accepted, so a retried task leaves one file for each row. A name that several rows have is an error, as is one that leads out of the
folder; a null payload is an empty file. Mode "append" replaces files of equal name and leaves others, "overwrite" removes the others. A
stream notes the last batch that it published, and a batch that is sent again is published once; a folder takes one stream.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter

from voxelweave.sources.publish import Publication, Staged, opened, proper

SCHEMA = "name string, payload binary"


def _write(to: Publication, batches: Iterator) -> Staged:
    folder = to.stage()
    files, base = opened(to.path)
    seen: set[str] = set()
    for batch in batches:
        names, payloads = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "payload"))
        for name, payload in zip(names.to_pylist(), payloads, strict=True):
            if proper(name) in seen:
                raise ValueError(f"several rows have the name {name}")
            seen.add(name)
            if posixpath.dirname(name):
                files.create_dir(f"{base}/{folder}/{posixpath.dirname(name)}", recursive=True)
            with files.open_output_stream(f"{base}/{folder}/{name}") as f:
                if payload.is_valid:
                    f.write(payload.as_buffer())
    return Staged(folder, len(seen))


class FrameFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.to, self.overwrite = Publication(path), overwrite

    def write(self, iterator: Iterator) -> Staged:
        return _write(self.to, iterator)

    def commit(self, messages: list) -> None:
        self.to.publish(messages, replace=self.overwrite)

    def abort(self, messages: list) -> None:
        self.to.clear()


class FrameFileStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.to = Publication(path)

    def write(self, iterator: Iterator) -> Staged:
        return _write(self.to, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        if batchId <= self.to.last_batch():
            self.to.clear()
            return
        self.to.publish(messages)
        self.to.note_batch(batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.to.clear()


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FrameFileWriter:
        return FrameFileWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> FrameFileStreamWriter:
        return FrameFileStreamWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """rows (name, payload) as files under a folder."""
    rows.sparkSession.dataSource.register(FrameFiles)
    rows.select("name", "payload").write.format("frame_files").mode(mode).save(folder)


def stream_files(rows: DataFrame, folder: str, checkpoint: str, **trigger):
    """The running query that writes a stream of rows (name, payload) as files."""
    rows.sparkSession.dataSource.register(FrameFiles)
    return rows.select("name", "payload").writeStream.format("frame_files").option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start(folder)
