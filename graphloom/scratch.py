"""Shared scratch tables: the way every iterative plan here cuts its lineage.

Intermediate results are written as Parquet below the folder named by ``spark.checkpoint.dir``, which all
executors share, so losing an executor loses nothing that was written. Only where that setting is absent and the
master is local (tests, notebooks) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors; raises ValueError on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_BASES: list[list[str]] = [[]]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete the scratch tables made since the innermost ``freed`` began, once the results that read them are written."""
    while _BASES[-1]:
        _delete(spark, _BASES[-1].pop())


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the scratch tables that are made inside, and no others; inside, the caller writes the results."""
    _BASES.append([])
    try:
        yield
    finally:
        clear(spark)
        _BASES.pop()


class Scratch:
    """One run's scratch tables; ``cut`` writes a table and reads it back, ``drop`` frees one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _BASES[-1].append(self.base)

    def cut(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """``df`` written and read back; with ``partition_by`` in a folder for each value of that column."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def cut_state(self, df: DataFrame, *columns: str) -> tuple[DataFrame, tuple]:
        """``cut``, and with the same job the number of rows and checksums over the columns, to tell equal tables by."""
        h, seen = F.xxhash64(*columns), Observation()
        out = self.cut(df.observe(seen, F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"), F.bit_xor(h).alias("x")))
        return out, (seen.get["n"], seen.get["s"], seen.get["x"])

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and "_scratch" in vars(df):
            _delete(self.spark, vars(df).pop("_scratch"))
