"""Cutting long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names and all executors see; one of its own only where none is named, as in tests on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='skysift-')}")
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder; it goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")
