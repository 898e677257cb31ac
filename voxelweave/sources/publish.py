"""Files that tasks write and the driver publishes: each attempt of a task writes to a folder of its own, and only the folders of attempts
that Spark has accepted are moved into place. A lost, repeated or speculative attempt publishes nothing; one that still runs when its job is
given up may leave its folder under _staging, which readers pass over."""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql.datasource import WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: its folder."""

    folder: str
    files: int


def opened(path: str):
    """(file system, path in it) of a path or URI that the driver and all executors see."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def listed(files, folder: str) -> dict[str, int]:
    """Sizes of the files under a folder, by path in it; names that begin with _ or . are left out."""
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    out = {posixpath.relpath(f.path, folder): f.size for f in found if f.is_file}
    return {name: size for name, size in out.items() if not any(p[0] in "_." for p in name.split("/"))}


def proper(name: str | None) -> str:
    """A name of a file under the folder; anything that would lead elsewhere, or be hidden, is refused."""
    if not name or name.startswith("/") or any(not p or p[0] in "._" for p in name.split("/")):
        raise ValueError(f"no name for a file: {name!r}")
    return name


@dataclass
class Publication:
    """One write of files to a folder."""

    path: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    def stage(self) -> str:
        """A folder for one attempt of a task."""
        files, base = opened(self.path)
        folder = f"_staging/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(f"{base}/{folder}", recursive=True)
        return folder

    def publish(self, messages: list[Staged | None], rename=None, replace: bool = False) -> int:
        """Moves the files of accepted attempts into place; two tasks may not have written one name. replace: other files go. rename: gives
        the final name of a staged one."""
        files, base = opened(self.path)
        moves = [(f"{base}/{m.folder}/{n}", rename(n) if rename else n) for m in messages if m for n in sorted(listed(files, f"{base}/{m.folder}"))]
        twice = [n for n, k in Counter(n for _, n in moves).items() if k > 1]
        if twice:
            raise ValueError(f"{len(twice)} files were written by several tasks, such as {twice[0]}")
        for folder in {posixpath.dirname(n) for _, n in moves} - {""}:
            files.create_dir(f"{base}/{folder}", recursive=True)
        old = set(listed(files, base)) - {n for _, n in moves} if replace else set()
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: files.move(m[0], f"{base}/{m[1]}"), moves))
            list(pool.map(lambda n: files.delete_file(f"{base}/{n}"), old))
        self.clear()
        return len(moves)

    def clear(self) -> None:
        """Whatever attempts of this write have left."""
        from pyarrow import fs

        files, base = opened(self.path)
        if files.get_file_info(f"{base}/_staging/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/_staging/{self.job}")
        if not files.get_file_info(fs.FileSelector(f"{base}/_staging", allow_not_found=True)):
            if files.get_file_info(f"{base}/_staging").type == fs.FileType.Directory:
                files.delete_dir(f"{base}/_staging")

    def last_batch(self) -> int:
        """Number of the last micro-batch that was published here, -1 if none."""
        from pyarrow import fs

        files, base = opened(self.path)
        if files.get_file_info(f"{base}/_batch").type != fs.FileType.File:
            return -1
        with files.open_input_stream(f"{base}/_batch") as f:
            return int(f.read())

    def note_batch(self, batch: int) -> None:
        files, base = opened(self.path)
        with files.open_output_stream(f"{base}/_batch-{self.job}") as f:
            f.write(str(batch).encode())
        files.move(f"{base}/_batch-{self.job}", f"{base}/_batch")
