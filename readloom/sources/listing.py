"""A listing of files as a data source: one partition per folder, empty files included.

Spark's own file sources pass over files without contents and over hidden ones. The
driver lists the top folder only; each folder in it is listed by the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatchcase
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "folder_listing"
SCHEMA = "path string, size bigint, mtime timestamp"
BATCH = 10_000


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path = path
        self.deep = deep


def opened(directory: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what comes before that path in a name."""
    parts = urlsplit(directory)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path if parts.scheme else directory, "file:"
    system, path = fs.FileSystem.from_uri(directory)
    return system, path, directory[: directory.index(path)] if path in directory else f"{parts.scheme}://"


class ListingReader(DataSourceReader):
    def __init__(self, directory: str, pattern: str) -> None:
        self.directory = directory
        self.pattern = pattern

    def partitions(self) -> list[Folder]:
        system, path, _ = opened(self.directory)
        top = system.get_file_info(fs.FileSelector(path))
        folders = sorted(x.path for x in top if x.type == fs.FileType.Directory)
        return [Folder(path, False), *(Folder(x, True) for x in folders)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.directory)
        # a stack of folders, so that no list of all files of a tree is held
        waiting = [partition.path]
        rows: list[tuple[str, int, datetime]] = []
        while waiting:
            for info in system.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True)):
                if info.type == fs.FileType.Directory and partition.deep:
                    waiting.append(info.path)
                elif info.type == fs.FileType.File and fnmatchcase(info.base_name, self.pattern):
                    # in milliseconds, as in Spark's own listing
                    mtime = datetime.fromtimestamp(info.mtime_ns // 1_000_000 / 1000, timezone.utc)
                    rows.append((before + info.path, info.size, mtime))
            while len(rows) >= BATCH or (rows and not waiting):
                yield _batch(rows[:BATCH])
                rows = rows[BATCH:]


def _batch(rows: list[tuple[str, int, datetime]]) -> pa.RecordBatch:
    path, size, mtime = zip(*rows, strict=True)
    kinds = pa.string(), pa.int64(), pa.timestamp("us", "UTC")
    columns = [pa.array(x, kind) for x, kind in zip((path, size, mtime), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["path", "size", "mtime"])


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ListingReader:
        return ListingReader(self.options["path"], self.options.get("pattern", "*"))
