"""What the data sources for SQLite files and workbooks share: files on a path that every executor can open, and a sink of one file a task."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def local_path(path: str) -> str:
    """The path of a file: URI or plain path; other stores cannot be opened by these formats' libraries."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: copy the files to a folder that all executors mount")
    return unquote(parts.path) if parts.scheme else path


def files_at(path: str, ending: str) -> list[str]:
    """Files with the ending in a folder, those that a pattern matches, or the one file, by name."""
    here = local_path(path)
    found = glob.glob(os.path.join(here, f"*{ending}")) if os.path.isdir(here) else glob.glob(here)
    if not found:
        raise FileNotFoundError(f"no file at {path}")
    return sorted(found)


@dataclass
class Written(WriterCommitMessage):
    made: str
    final: str


class FolderWriter(DataSourceArrowWriter):
    """Each task writes a hidden file of its own, which gets its final name when all tasks are done.

    So a task that runs twice, or is lost, leaves nothing that a reader sees. Subclasses write one file in `fill`.
    """

    ending = ""

    def __init__(self, path: str, overwrite: bool):
        self.folder = local_path(path)
        self.job = uuid.uuid4().hex
        os.makedirs(self.folder, exist_ok=True)
        self.former = files_at(path, self.ending) if glob.glob(os.path.join(self.folder, f"*{self.ending}")) else []
        if self.former and not overwrite:
            self.former = []

    def fill(self, path: str, batches: Iterator[pa.RecordBatch]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own = uuid.uuid4().hex
        made = os.path.join(self.folder, f".{self.job}-{own}")
        self.fill(made, iterator)
        return Written(made, os.path.join(self.folder, f"part-{own}{self.ending}"))

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.made, m.final)
        for old in self.former:
            os.remove(old)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Removes what attempts of this job have left."""
        for left in glob.glob(os.path.join(self.folder, f".{self.job}-*")):
            os.remove(left)
