"""Arrays in files, read in ranges: one large file is many tasks.

A header tells an array's shape, order and numbers; what a task reads is a range
of the file, and it works out where in the array its numbers belong, by rows or
by columns.  Files of 32-bit floats without a header are arrays of one axis.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.lineage import cut
from skysift.sources.raw import files_of, open_file, tasks_of

MAGIC = b"\x93NUMPY"
#: Numbers of a range.
EACH = 1 << 20
INDEX = "path string, kind string, by_columns boolean, shape array<long>, offset long, n long"


def header_of(path: str) -> tuple[str, bool, list[int], int, int]:
    """(kind of numbers, whether columns come first, shape, first byte, numbers) of an array file; a cut one is an error."""
    with open_file(path) as f:
        head = f.read_at(min(12, f.size()), 0)
        if head[:6] != MAGIC:
            raise ValueError(f"{path} holds no array")
        wide = head[6] > 1
        size = struct.unpack("<I" if wide else "<H", head[8 : 12 if wide else 10])[0]
        at = (12 if wide else 10) + size
        said = ast.literal_eval(f.read_at(size, at - size).decode("latin-1"))
        kind = np.dtype(said["descr"])
        if kind.hasobject or kind.fields:
            raise ValueError(f"{path} does not hold plain numbers")
        shape = [int(x) for x in said["shape"]]
        n = int(np.prod(shape, dtype=np.int64))
        if f.size() < at + n * kind.itemsize:
            raise ValueError(f"{path} is cut short")
    return kind.str, bool(said["fortran_order"]), shape, at, n


def _floats(path: str) -> tuple[str, bool, list[int], int, int]:
    with open_file(path) as f:
        n = f.size() // 4
    return "<f4", False, [n], 0, n


def _ranges(spark: SparkSession, path: str, of, each: int) -> DataFrame:
    """INDEX of the files with the first number of each range; headers are read in tasks."""
    paths = files_of(path)
    names = ["path", "kind", "by_columns", "shape", "offset", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(names, (p, *of(p)), strict=True)) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("kind", pa.string()), ("by_columns", pa.bool_()), ("shape", pa.list_(pa.int64())), ("offset", pa.int64()), ("n", pa.int64())]))

    found = cut(spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks_of(spark, len(paths), 0)).mapInArrow(run, INDEX))
    rows = found.where("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(each).cast("long"))))
    total = found.agg(F.sum("n")).first()[0] or 0
    return rows.repartition(tasks_of(spark, rows.count(), min(100_000, total // EACH)))  # short ranges share a task


def _numbers(ranges: DataFrame, each: int) -> DataFrame:
    """(path, shape, i, x): numbers and their places counted by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind, n = np.dtype(r["kind"]), min(each, r["n"] - r["first"])
                with open_file(r["path"]) as f:
                    x = np.frombuffer(f.read_at(n * kind.itemsize, r["offset"] + r["first"] * kind.itemsize), kind).astype(float)
                at = np.arange(r["first"], r["first"] + n)
                if r["by_columns"] and len(r["shape"]) > 1:
                    at = np.ravel_multi_index(np.unravel_index(at, r["shape"], order="F"), r["shape"])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(r["path"]), n), pa.array([r["shape"]] * n, pa.list_(pa.int64())), pa.array(at), pa.array(x)], names=["path", "shape", "i", "x"])

    return ranges.mapInArrow(run, "path string, shape array<long>, i long, x double")


def read_arrays(spark: SparkSession, path: str, each: int = EACH) -> DataFrame:
    """(path, shape, i, x) of an array file, or of all in a folder; i counts by rows however the file is ordered."""
    return _numbers(_ranges(spark, path, header_of, each), each)


def read_matrix(spark: SparkSession, path: str, each: int = EACH) -> DataFrame:
    """(path, r, c, x) of arrays of two axes."""
    columns = F.col("shape")[1]
    return read_arrays(spark, path, each).select("path", F.floor(F.col("i") / columns).cast("long").alias("r"), (F.col("i") % columns).alias("c"), "x")


def read_dump(spark: SparkSession, path: str, each: int = EACH) -> DataFrame:
    """(path, i, x) of files of 32-bit floats."""
    return _numbers(_ranges(spark, path, _floats, each), each).drop("shape")
