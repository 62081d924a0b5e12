"""Binary files of records as Spark data sources: each task reads a range of records at its offset, so no file is held whole by anyone.

Spark lists the files and their sizes; tasks open them by pyarrow's file systems (local, hdfs, s3, gs, abfs). For paths that those can't open, files() says so,
and readers take Spark's binaryFile, of up to 2 GB a file.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tabiya.session import ship

#: Bytes of records that a task reads, and that it holds at a time.
TASK_BYTES, HELD_BYTES = 32 << 20, 1 << 20
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """Paths and sizes of the files at paths, as Spark lists them."""
    return [(r.path, r.length) for r in ship(spark).read.format("binaryFile").load(paths).select("path", "length").collect()]


def opened(files: list[tuple[str, int]]) -> bool:
    """Whether tasks can open all of them at offsets."""
    return all(p.split(":", 1)[0] in OPENED if "://" in p or p.startswith("file:") else True for p, _ in files)


def plain(path: str) -> str:
    """A local path without its scheme, as other readers show it."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


class Bytes:
    """A file's bytes by slices, read where they are asked for; what was read last is kept with what follows it."""

    def __init__(self, path: str, ahead: int = HELD_BYTES):
        from pyarrow import fs

        system, inside = (fs.LocalFileSystem(), plain(path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        self.file = system.open_input_file(inside)
        self.size, self.ahead, self.at, self.held = self.file.size(), ahead, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice | int) -> bytes | int:
        if isinstance(part, int):
            return self[part : part + 1][0]
        lo, hi, _ = part.indices(self.size)
        if hi <= lo:
            return b""
        if not self.at <= lo <= hi <= self.at + len(self.held):
            self.at, self.held = lo, self.file.read_at(min(max(hi - lo, self.ahead), self.size - lo), lo)
        return self.held[lo - self.at : hi - self.at]

    def close(self) -> None:
        self.file.close()


@dataclass
class Range(InputPartition):
    """Records first to last (not included) of a file or set."""

    of: int
    first: int
    last: int


class RecordReader(DataSourceReader):
    """path, seq and data of the records of `size` bytes that follow `header` bytes; `per` of them in a row, whose seq is the first's."""

    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.size, self.header, self.per, self.task = (int(options[k]) for k in ("size", "header", "per", "task"))
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[Range]:
        out = []
        for k, (_, length) in enumerate(self.files):
            low, high = self.low, min(self.high, max(0, length - self.header) // self.size)
            step = max(1, self.task // (self.size * self.per)) * self.per
            out += [Range(k, at, min(at + step, high)) for at in range(low, high, step)]
        return out or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        path = self.files[partition.of][0]
        data = Bytes(path, 0)
        step = max(1, HELD_BYTES // (self.size * self.per)) * self.per
        for at in range(partition.first, partition.last, step):
            end = min(at + step, partition.last)
            block = data[self.header + at * self.size : self.header + end * self.size]
            seqs = list(range(at, end, self.per))
            rows = [block[(s - at) * self.size : (s - at + self.per) * self.size] for s in seqs]
            yield pa.RecordBatch.from_arrays([pa.array([plain(path)] * len(seqs), pa.string()), pa.array(seqs, pa.int64()), pa.array(rows, pa.binary())], ["path", "seq", "data"])
        data.close()


class PushedReader(RecordReader):
    """Takes bounds of seq from the query's filters."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("seq",) or self.per > 1 or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = f.value
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, v + (not isinstance(f, LessThan)))
            else:
                yield f


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabiya_records"

    def schema(self) -> str:
        return "path string, seq long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushed") == "true" else RecordReader)(self.options)


def read_records(spark: SparkSession, files: list[tuple[str, int]], size: int, header: int = 0, per: int = 1, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of RecordReader, of the records first to last (not included) of each file; filters on seq reach the files if the session lets Python sources have them."""
    spark.dataSource.register(Records)
    pushed = str(spark.conf.get(PUSHDOWN, "false")).lower()
    reader = spark.read.format("tabiya_records").options(files=json.dumps(files), size=size, header=header, per=per, task=TASK_BYTES, first=first, pushed=pushed)
    return (reader if last is None else reader.option("last", last)).load()


class SetReader(DataSourceReader):
    """Rows that parse(path, files, first, last) yields for ranges of the records of each set's main file."""

    def __init__(self, options: dict):
        self.sets = json.loads(options["sets"])
        self.kinds, self.names, self.record, self.long, self.parse = pickle.loads(base64.b64decode(options["how"]))

    def partitions(self) -> list[Range]:
        out = []
        for k, (_, length, _, _) in enumerate(self.sets):
            step = max(1, TASK_BYTES // 8 // self.record)  # a record's game is larger than the record
            n = max(2, -(-length // self.record))  # a damaged length is found by the first task
            out += [Range(k, at, min(at + step, n)) for at in range(1, n, step)]
        return out or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        path, _, side, lost = self.sets[partition.of]
        files = {} if lost else {ext: Bytes(p, HELD_BYTES if ext in self.long else 8192) for ext, p in side.items()}
        rows = []
        for row in self.parse(plain(path), files, partition.first, partition.last, lost):
            rows.append(row)
            if len(rows) >= 1000:
                yield self.batch(rows)
                rows = []
        yield self.batch(rows)
        for f in files.values():
            f.close()

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(self.kinds)], self.names)


class Sets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabiya_sets"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return SetReader(self.options)


def read_sets(spark: SparkSession, sets: list[tuple], columns: str, how: tuple) -> DataFrame:
    """sets: (path, size, {ext: path}, missing side files) each; how: Arrow types, names, bytes of a record, extensions of files that are read from start to end, parse."""
    spark.dataSource.register(Sets)
    return spark.read.format("tabiya_sets").options(sets=json.dumps(sets), columns=columns, how=base64.b64encode(pickle.dumps(how)).decode()).load()


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content, for files that tasks can't open at offsets."""
    return ship(spark).read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
