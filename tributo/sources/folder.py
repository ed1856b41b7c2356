"""A folder of XML files as a data source, batch and stream: ``spark.read.format("fiscal_xml").load(path)``.

Many small files are packed into partitions by their bytes, and read and parsed in the task that lists them, so contents
never pass through Spark as rows.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import xml

NAME = "fiscal_xml"
#: Bytes of files in a partition, and what opening one costs in bytes.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 64 << 10
#: Bytes of contents held at once while a partition is read, but for a larger file.
BATCH_BYTES = 8 << 20
SCHEMA = f"nome_arquivo string, caminho_arquivo string, hash string, bytes bigint, {xml.DOC_DDL}"


@dataclass
class Packed(InputPartition):
    """The paths of one partition."""

    paths: list[str]


def pack(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Paths in groups of at most ``most`` bytes, openings counted, in order of size; a file of more is a group by itself."""
    groups: list[list[str]] = []
    room = -1
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        cost = size + OPEN_BYTES
        if cost > room:
            groups.append([])
            room = most
        groups[-1].append(path)
        room -= cost
    return groups


class Folder:
    """The files below a path whose names fit a pattern, on any file system that Arrow knows by the path's scheme."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        path = self.options.get("path")
        if not path:
            raise ValueError("a path must be given")
        self.path, self.pattern = path, self.options.get("pathglobfilter", self.options.get("pathGlobFilter", "*"))
        self.most = int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION_BYTES)))

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[fs.FileInfo]:
        system, root = self.system()
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_"))]

    def packed(self, files: list[fs.FileInfo]) -> list[Packed]:
        return [Packed(paths) for paths in pack([(f.path, f.size or 0) for f in files], self.most)]

    def read(self, paths: list[str]) -> Iterator[pa.RecordBatch]:
        system, _ = self.system()
        held: list[tuple[str, bytes]] = []
        for path in paths:
            with system.open_input_stream(path) as stream:
                held.append((path, stream.read()))
            if sum(len(content) for _, content in held) >= BATCH_BYTES:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    contents = [content for _, content in held]
    named = {"nome_arquivo": [path.rsplit("/", 1)[-1] for path, _ in held], "caminho_arquivo": [path for path, _ in held], "hash": [hashlib.sha256(c).hexdigest() for c in contents], "bytes": [len(c) for c in contents]}
    return pa.record_batch({c: pa.array(v) for c, v in named.items()} | xml.found(contents))


class FolderReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Packed]:
        return self.folder.packed(self.folder.files())

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition.paths)


class FolderStreamReader(DataSourceStreamReader):
    """New files by the time and path they were last written at; a file must not be given an earlier time once others are read."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(((f.mtime_ns or 0, f.path) for f in self.folder.files()), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Packed]:
        after, until = (start["time"], start["path"]), (end["time"], end["path"])
        return self.folder.packed([f for f in self.folder.files() if after < (f.mtime_ns or 0, f.path) <= until])

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition.paths)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class FiscalXml(DataSource):
    """Options: path, pathGlobFilter, partitionBytes. Columns: nome_arquivo, caminho_arquivo, hash, bytes, and those of xml.parse."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(Folder(self.options))

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FiscalXml)
