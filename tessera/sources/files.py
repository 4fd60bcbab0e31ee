"""What the file sources and sinks share: listing, and files that appear under their name only once complete."""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import WriterCommitMessage


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> tuple[object, list[tuple[str, int]]]:
    """The file system, and (name, bytes) of the files of a path."""
    from pyarrow import fs as pafs

    fs, root = file_system(path)
    folder, _, pattern = root.rpartition("/")
    globbed = any(c in pattern for c in "*?[")
    info = fs.get_file_info(folder if globbed else root)
    if info.type == pafs.FileType.File:
        return fs, [(info.path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(folder if globbed else root))
    return fs, sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and (not globbed or fnmatch.fnmatch(posixpath.basename(f.path), pattern)) and posixpath.basename(f.path)[0] not in "._")


@dataclass
class Written(WriterCommitMessage):
    """Hidden names of a task's complete files, and the names they take when the job commits."""

    files: list[tuple[str, str]] = field(default_factory=list)


def hidden(base: str) -> str:
    return f"{base}/.{uuid.uuid4().hex}"


def publish(path: str, messages: list) -> None:
    """Give the files of all tasks that succeeded their names; a retried task's first files never get one."""
    fs, _ = file_system(path)
    for m in messages:
        for temp, name in m.files if m else ():
            fs.move(temp, name)


def withdraw(path: str, messages: list) -> None:
    fs, _ = file_system(path)
    for m in messages:
        for temp, _ in m.files if m else ():
            fs.delete_file(temp)
