"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is spark.checkpoint.dir where the session names one. Where it is
    unset, a folder of this machine is taken if the executors are threads of it, as in tests; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="filingdelta-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Jobs that write inside leave no shuffle files behind: what they wrote replaces them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage, outlives a lost executor, and the shuffle
    files that it took are freed at once."""
    path = new_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Scratch:
    """Tables in the shared folder that one operator needs for a while: all are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.paths):
            self.drop(name)

    def path(self, name: str) -> str:
        """A path for a table of that name."""
        self.paths[name] = new_path(self.spark, name)
        return self.paths[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """materialize, until the block ends or the name is dropped."""
        path = self.path(name)
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.paths.pop(name))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
