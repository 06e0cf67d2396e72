"""Lines of raw files, read in parts: a data source for tables and for streams.

A row is (path, start, value, ended): the line's first byte in its file, its bytes without the line feed, and whether a line
feed ended it, which only a file's last line may lack. A carriage return is part of the line. Files are cut at
any byte; a part has the lines that begin in it, so a file of any size is read by many tasks, and
none holds more than a chunk and its longest line.

As a stream, a batch takes at most batchBytes of the files in order of their time and path, parts of files too. What
has been planned is noted in the folder `progress`, by which a restarted query goes on. Files must be complete when
they appear, and not older than those read before.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, value binary, ended boolean"
ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("value", pa.binary()), ("ended", pa.bool_())])
NAME, SPLIT, BATCH, CHUNK = "wordloom_lines", 64 << 20, 256 << 20, 4 << 20


@dataclasses.dataclass
class Part(InputPartition):
    path: str
    low: int
    high: int


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def files(uri: str) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of a file, or of a folder's files but those that begin with _ or a point; in order."""
    fs, root = opened(uri)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "_.")


def batch_of(path: str, starts: np.ndarray, data: np.ndarray, ends: np.ndarray, ended: bool) -> pa.RecordBatch:
    """Lines of data, which end at `ends`, with their starts in the file."""
    sizes = np.diff(ends, prepend=-1) - 1 if ended else ends
    keep = np.ones(len(data), np.bool_)
    keep[ends[ends < len(data)]] = False
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    value = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())])
    return pa.record_batch([pa.array([path] * len(sizes), pa.string()), pa.array(starts, pa.int64()), value, pa.array([ended] * len(sizes))], schema=ARROW)


def lines_of(source, path: str, low: int, high: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The lines that begin from byte low on, before high."""
    begin = low
    if low:  # the line that holds the byte before is another part's
        source.seek(low - 1)
        begin = low - 1
        while data := source.read(min(chunk, 1 << 16)):
            at = data.find(b"\n")
            if at >= 0:
                begin += at + 1
                break
            begin += len(data)
        else:
            return
    source.seek(begin)
    held: list[bytes] = []
    while begin < high:
        data = source.read(chunk)
        if not data:
            rest = np.frombuffer(b"".join(held), np.uint8)
            if len(rest):
                yield batch_of(path, np.array([begin]), rest, np.array([len(rest)]), False)
            return
        last = data.rfind(b"\n")
        if last < 0:
            held.append(data)
            continue
        flat = np.frombuffer(b"".join([*held, data[: last + 1]]), np.uint8)
        ends = np.flatnonzero(flat == 10)
        starts = begin + np.concatenate([[0], ends[:-1] + 1])
        n = int(np.searchsorted(starts, high))
        if n:
            yield batch_of(path, starts[:n], flat[: ends[n - 1] + 1], ends[:n], True)
        begin += len(flat)
        held = [data[last + 1 :]] if last + 1 < len(data) else []


class _Reading:
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.split = int(options.get("splitbytes", SPLIT))

    def parts(self, path: str, low: int, high: int) -> list[Part]:
        return [Part(path, x, min(high, x + self.split)) for x in range(low, high, self.split)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with opened(self.uri)[0].open_input_file(partition.path) as source:
            yield from lines_of(source, partition.path, partition.low, partition.high)


class LinesReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [p for _, path, size in files(self.uri) for p in self.parts(path, 0, size)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)


class LinesStream(_Reading, DataSourceStreamReader):
    """An offset is (time, path, bytes): files before it in order are read whole, this one up to the byte."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.most, self.progress = int(options.get("batchbytes", BATCH)), options.get("progress")
        self.now = (0, "", 0)
        if self.progress:
            fs, root = opened(self.progress)
            fs.create_dir(root, recursive=True)
            if fs.get_file_info(f"{root}/planned.json").type == pafs.FileType.File:
                with fs.open_input_file(f"{root}/planned.json") as f:
                    self.now = tuple(json.loads(f.read()))

    @staticmethod
    def _said(offset: tuple) -> dict:
        return dict(zip(("time", "path", "bytes"), offset))

    def _left(self, after: tuple) -> Iterator[tuple[int, str, int, int]]:
        """(time, path, first byte, bytes) of what is behind an offset."""
        for time, path, size in files(self.uri):
            if (time, path) > after[:2]:
                yield time, path, 0, size
            elif (time, path) == after[:2] and size > after[2]:
                yield time, path, after[2], size

    def initialOffset(self) -> dict:
        return self._said((0, "", 0))

    def latestOffset(self) -> dict:
        room, upto = self.most, self.now
        for time, path, low, size in self._left(self.now):
            if room <= 0:
                break
            upto = (time, path, min(size, low + room))
            room -= upto[2] - low
        return self._said(upto)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, upto = ((int(x["time"]), x["path"], int(x["bytes"])) for x in (start, end))
        self.now = max(self.now, upto)
        if self.progress:
            fs, root = opened(self.progress)
            new = f"{root}/{uuid.uuid4().hex}"
            with fs.open_output_stream(new) as f:
                f.write(json.dumps(self.now).encode())
            fs.move(new, f"{root}/planned.json")
        out = []
        for time, path, low, size in self._left(after):
            if (time, path) < upto[:2]:
                out += self.parts(path, low, size)
            elif (time, path) == upto[:2]:
                out += self.parts(path, low, upto[2])
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """spark.read.format('wordloom_lines') with path, splitBytes; as a stream also batchBytes and progress."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LinesStream:
        return LinesStream({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(path, start, value, ended) of a file's or a folder's lines."""
    spark.dataSource.register(Lines)
    return spark.read.format(NAME).option("path", path).option("splitBytes", split_bytes).load()


def stream(spark: SparkSession, path: str, progress: str | None = None, batch_bytes: int = BATCH, split_bytes: int = SPLIT) -> DataFrame:
    """The same as a stream. Without `progress`, a folder of the query's own, it can't be restarted."""
    spark.dataSource.register(Lines)
    source = spark.readStream.format(NAME).option("path", path).option("splitBytes", split_bytes).option("batchBytes", batch_bytes)
    return (source.option("progress", progress) if progress else source).load()
