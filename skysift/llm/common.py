"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words is the six ASCII characters.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows handled at once in a Python worker, so that long texts stay bounded in memory.
ROWS = 256
#: A table of at most so many rows of a few numbers is sent to every executor (tens of MB); beyond it, joins shuffle.
BROADCAST_ROWS = 500_000


#: Folders made since the innermost passing() began, and those outside it.
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which all executors see.

    Only where that is unset, as in tests on one machine, a local temporary
    folder takes its place.  The folder goes when the driver ends.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = f"file://{tempfile.mkdtemp(prefix='skysift-')}"
        sc.setCheckpointDir(root)
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    uri = str(fs.makeQualified(path).toString()).replace("file:/", "file:///", 1).replace("file://///", "file:///")
    if _SCOPES:
        _SCOPES[-1].append(uri)
    return uri


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Folders made within go when it ends, but for the tables written by the function that it gives."""
    own: list[str] = []
    _SCOPES.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        own.pop()  # written() made its folder last
        return out

    try:
        yield keep
    finally:
        _SCOPES.remove(own)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: computed once, and safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession, name)}/table"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its partitions and their order kept, in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; it should be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lowered(text: Column) -> Column:
    """The text with A-Z alone lower-cased; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo m; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % m


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, ddl: str, rows: int = ROWS) -> DataFrame:
    """fn over the columns of every few rows, as Python lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def gapless(df: DataFrame, group: str, order: list[str], name: str, rows_each: int = 100_000) -> DataFrame:
    """Adds a column that numbers each group's rows from 0 without gaps.

    A group may hold most rows, so it is dealt into buckets by a hash of the
    order columns: buckets are numbered on their own and start after those
    before them.  df is read twice and must not change in between.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_each))
    bucket, key, b, first, at = (free(df, x) for x in ("_bucket", "_group", "_b", "_first", "_at"))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, bucket).agg(F.count("*").alias(at))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias(key), F.col(bucket).alias(b), F.coalesce(F.sum(at).over(before), F.lit(0)).alias(first))
    place = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order)) - 1
    return (
        df.withColumn(at, place)
        .join(small(starts), F.col(group).eqNullSafe(F.col(key)) & (F.col(bucket) == F.col(b)), "left")
        .withColumn(name, (F.col(first) + F.col(at)).cast("long"))
        .drop(bucket, key, b, first, at)
    )
