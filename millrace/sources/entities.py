"""Recordings as pairs of files: an index of fixed records and a file of blobs, read and written through Spark's Python data sources.

A record of the index is three unsigned little-endian 64-bit numbers: when an entity was logged, its size, and where it begins in
the file of blobs. The files are opened by path on driver and executors, so they lie in a folder that all of them mount.

    spark.dataSource.register(EntityRecording)
    spark.read.format("entities").option("path", "/recordings/one").load()
    df.write.format("entities").mode("append").option("path", "/recordings/two").save()   # columns log_time, data
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = struct.Struct("<QQQ")
SUFFIXES = (".index", ".entities")


@dataclass
class Range(InputPartition):
    base: str
    first: int
    past: int


@dataclass
class Written(WriterCommitMessage):
    base: str


class EntityRecording(DataSource):
    """(log_time, data_size, data_offset, data): a row an entity, in the order of the index inside a partition.

    ``path`` is a folder of pairs or one pair's name without suffix. ``data`` is null where the blob file ends before the entity
    does. Options: ``rows`` (entities of a partition, 4096), ``index_suffix``, ``entities_suffix``.
    """

    @classmethod
    def name(cls) -> str:
        return "entities"

    def schema(self) -> str:
        return "log_time long, data_size long, data_offset long, data binary"

    def _suffixes(self) -> tuple[str, str]:
        return self.options.get("index_suffix", SUFFIXES[0]), self.options.get("entities_suffix", SUFFIXES[1])

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("the option path is missing")
        return path.removeprefix("file://")

    def reader(self, schema: StructType) -> DataSourceReader:
        return EntityReader(self._path(), int(self.options.get("rows", "4096")), *self._suffixes())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("recordings are appended to")
        return EntityWriter(self._path(), *self._suffixes())


class EntityReader(DataSourceReader):
    def __init__(self, path: str, rows: int, index: str, entities: str):
        self.path, self.rows, self.index, self.entities = path, rows, index, entities

    def partitions(self) -> list[Range]:
        bases = [self.path] if os.path.exists(self.path + self.index) else sorted(f.removesuffix(self.index) for f in glob.glob(f"{glob.escape(self.path)}/*{self.index}"))
        if not bases and not os.path.isdir(self.path):
            raise FileNotFoundError(self.path + self.index)
        sizes = [(b, os.path.getsize(b + self.index) // RECORD.size) for b in bases]
        return [Range(b, k, min(k + self.rows, n)) for b, n in sizes for k in range(0, n, self.rows)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.base:
            return
        with open(partition.base + self.index, "rb") as index, open(partition.base + self.entities, "rb") as blobs:
            index.seek(partition.first * RECORD.size)
            for at, size, offset in RECORD.iter_unpack(index.read((partition.past - partition.first) * RECORD.size)):
                blobs.seek(offset)
                data = blobs.read(size)
                yield at, size, offset, data if len(data) == size else None


class EntityWriter(DataSourceWriter):
    """Each task writes a pair under a hidden name; the pairs get their names when all tasks have succeeded."""

    def __init__(self, path: str, index: str, entities: str):
        self.path, self.index, self.entities = path, index, entities

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        base, offset = f"part-{uuid.uuid4().hex}", 0
        with open(f"{self.path}/.{base}{self.index}", "wb") as index, open(f"{self.path}/.{base}{self.entities}", "wb") as blobs:
            for row in rows:
                data = bytes(row["data"] or b"")
                index.write(RECORD.pack(row["log_time"], len(data), offset))
                blobs.write(data)
                offset += len(data)
        return Written(base)

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for suffix in (self.entities, self.index):  # a pair is there once its index is
                os.rename(f"{self.path}/.{m.base}{suffix}", f"{self.path}/{m.base}{suffix}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for suffix in (self.entities, self.index):
                os.remove(f"{self.path}/.{m.base}{suffix}")
