"""A data source of file digests: each task streams the bytes of its own files.

Spark's binary reader holds a whole file in one value, which ends at 2 GB. Here a partition is a
list of files, packed by size, and a task reads them a chunk at a time, so the memory of a digest
does not depend on the file. Stores are reached through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "file_digests"
SCHEMA = "path string, file_name string, size_bytes long, sha256 string"
CHUNK = 1 << 22
#: Bytes that one task reads, as far as whole files allow.
TASK_BYTES = 1 << 28


@dataclass
class Files(InputPartition):
    """Paths of the files of one task."""

    paths: tuple[str, ...]


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it); fails for a scheme that Arrow does not know."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:") and not folder.startswith("file://"):
            folder = "file://" + folder.removeprefix("file:")
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def reachable(folder: str) -> bool:
    """Whether Arrow has a file system for the folder's scheme."""
    try:
        store_of(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def streamed_digest(system: pafs.FileSystem, path: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file, ``chunk`` bytes in memory at a time."""
    state = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while data := stream.read(chunk):
            state.update(data)
    return state.hexdigest()


def packed(files: list[tuple[str, int]], task_bytes: int) -> list[tuple[str, ...]]:
    """Files in order of size, the largest first, in lists of about ``task_bytes``."""
    parts: list[tuple[str, ...]] = []
    current: list[str] = []
    held = 0
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if current and held + size > task_bytes:
            parts.append(tuple(current))
            current, held = [], 0
        current.append(path)
        held += size
    if current:
        parts.append(tuple(current))
    return parts


class FileDigests(DataSource):
    """``spark.read.format("file_digests").option("pattern", "*.csv").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*")
        self.chunk = int(options.get("chunk", CHUNK))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        system, root = store_of(self.folder)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [
            (f.path, f.size) for f in found
            if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and fnmatch.fnmatchcase(f.base_name, self.pattern)
        ]
        return [Files(p) for p in packed(files, self.task_bytes)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = store_of(self.folder)
        for path in partition.paths:
            size = system.get_file_info(path).size
            yield path, path.rsplit("/", 1)[-1], size, streamed_digest(system, path, self.chunk)


def register(spark) -> None:
    """Make the source known to a session; again is harmless."""
    spark.dataSource.register(FileDigests)
