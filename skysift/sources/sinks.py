"""Sinks that appear as a whole or not at all: logs of chunks, and images.

``df.write.format("chunk_logs").mode("append").save(folder)`` takes rows (block,
chunk, line) and leaves a log for each block and chunk; ``log_lines()`` deals and
sorts them.  Tasks write beside the folder's own files under names that nobody
reads; only when all tasks are done does the driver give the logs their names,
and a failed job takes its files away.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from skysift.sources.files import write_files
from skysift.sources.raw import open_file

# The columns of a log of delegates, and a log's name.
COLUMNS = ["N", "t, bin", "t, sec", "dedisp", "width", "SNR", "num"]
NAME = "output_{}_ {}.log"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


@dataclass
class Written(WriterCommitMessage):
    """Logs of a task: names, and where they are until the job is done."""

    files: list[tuple[str, str]]


class _LogWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.header = options["path"], overwrite, options.get("header", "true") == "true"
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _store(self.path)
        task = TaskContext.get()
        folder = f"{root}/{self.job}/{task.taskAttemptId() if task else 0}"
        fs.create_dir(folder)
        done: dict[tuple[int, int], str] = {}
        now, out = None, None
        try:
            for r in rows:
                if (r.block, r.chunk) != now:
                    if out:
                        out.close()
                    now = (r.block, r.chunk)
                    if now in done:
                        raise ValueError(f"the lines of block {now[0]} and chunk {now[1]} do not stand together")
                    done[now] = f"{folder}/{NAME.format(*now)}"
                    out = fs.open_output_stream(done[now])
                    if self.header:
                        out.write(("".join(c.rjust(10) for c in COLUMNS) + "\n").encode())
                out.write((r.line + "\n").encode())
        finally:
            if out:
                out.close()
        return Written([(NAME.format(*k), f) for k, f in done.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        moved = [f for m in messages if m for f in m.files]
        if len({n for n, _ in moved}) < len(moved):
            self.abort(messages)
            raise ValueError("the lines of a block and chunk are in several tasks")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(".log"):
                    fs.delete_file(f.path)
        for name, at in moved:
            fs.move(at, f"{root}/{name}")
        fs.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class ChunkLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_logs"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"block", "chunk", "line"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return _LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkLogs)


def log_lines(found: DataFrame, line: Column, order: list[str]) -> DataFrame:
    """(block, chunk, line), each chunk's together and in order."""
    keys = ["block", "chunk"]
    rows = found.select(*keys, *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], line.alias("line"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_{i}" for i in range(len(order))]).select(*keys, "line")


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(levels: np.ndarray) -> bytes:
    """A grey picture of 8 bits as a PNG file; levels: (row, column), whose magnitude counts."""
    rows, columns = levels.shape
    data = np.zeros((rows, columns + 1), np.uint8)  # a row begins with the number of its filter: none
    data[:, 1:] = np.abs(levels)
    return b"\x89PNG\r\n\x1a\n" + _part(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(data.tobytes())) + _part(b"IEND", b"")


def decoded(data: bytes) -> np.ndarray:
    """(row, column) of a picture as encoded() makes it; a damaged one is an error."""
    at, size, raw = 8, None, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a part of the picture is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        raw += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size[1], size[0] + 1)[:, 1:]


def write_images(levels: DataFrame, folder: str, side: int = 1024) -> None:
    """Levels (r, c, level) as pictures of at most ``side`` rows and columns each, r<row>_c<column>.png by their upper left corner.

    A tile is a task's; cells it lacks are 0.
    """

    def run(group: pa.Table) -> pa.Table:
        r, c = group.column("r").to_numpy(), group.column("c").to_numpy()
        top, left = int(group.column("top")[0].as_py()), int(group.column("left")[0].as_py())
        tile = np.zeros((int(r.max()) - top + 1, int(c.max()) - left + 1), np.int64)
        tile[r - top, c - left] = group.column("level").to_numpy()
        return pa.table({"name": [f"r{top}_c{left}.png"], "content": [encoded(tile)]})

    corner = lambda x: (F.floor(F.col(x) / side) * side).cast("long")
    rows = levels.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("level").cast("long").alias("level"), corner("r").alias("top"), corner("c").alias("left"))
    write_files(rows.groupBy("top", "left").applyInArrow(run, "name string, content binary"), folder)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(r, c, level) of write_images()'s pictures; levels have lost their sign."""
    fs, root = _store(folder)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".png")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with open_file(f"{folder}/{name}") as f:
                    tile = decoded(f.read_at(f.size(), 0))
                top, left = (int(x[1:]) for x in name[:-4].split("_"))
                r, c = np.indices(tile.shape)
                yield pa.RecordBatch.from_arrays([pa.array((r + top).ravel()), pa.array((c + left).ravel()), pa.array(tile.ravel().astype(np.int64))], names=["r", "c", "level"])

    return spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names))).mapInArrow(run, "r long, c long, level long")
