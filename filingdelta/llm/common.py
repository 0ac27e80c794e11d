"""Helpers that the operators of this subpackage share: Arrow maps, shared-folder tables, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingdelta.session import ship
from filingdelta.storage import Scratch, delete_path, freed_shuffles, materialize, new_path, small, work_folder  # noqa: F401

#: Translation that lower-cases A-Z and leaves every other byte alone; for UTF-8 it touches ASCII letters only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: glibc's way to give freed memory back; None where the system has none.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Objects of this worker that hold tables made for one operator; another operator's task frees them.
HOLDERS: list = []


def release() -> None:
    """Give memory that this worker has freed back to the system: idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def free_tables(but=None) -> None:
    """Drop the tables of other operators."""
    for holder in [h for h in HOLDERS if h is not but]:
        holder.free()
        HOLDERS.remove(holder)
    release()


def share(spark: SparkSession, value):
    """Broadcast a Python value of bounded size to the workers."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches cut small, as texts are long: a worker holds the Python objects of one at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def map_columns(df: DataFrame, fn: Callable[..., Iterator[tuple]] | Callable, schema: T.StructType | str, keep_tables: bool = False) -> DataFrame:
    """Run fn over Arrow batches. fn() is called once a task and returns a function of the batch's columns, as lists
    (strings as UTF-8 bytes, which costs no decoding), that returns the output's columns as lists."""
    ship(df.sparkSession)
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(spark_schema)
        if not keep_tables:
            free_tables()
        body = fn()
        for batch in parts_of(batches):
            columns = [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in batch.columns]
            found = body(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, out, strict=True)], schema=out)
        body = columns = found = None
        release()

    return df.mapInArrow(run, spark_schema)


def whole_row(df: DataFrame, *columns: Column) -> DataFrame:
    """Pack all of df's columns in one struct, so that names the operator adds cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns)


def unpack(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label being the component's smallest node.

    Each round points every node to its smallest neighbour. Those pointers run in no cycle but of two nodes, whose smaller
    one becomes a root; pointer jumping then takes every node to its root, and the edges are contracted, of which only those
    between different nodes go on. A tree has two nodes at least, so a round leaves at most half of the nodes.
    Every round is cut by checkpoint(), never kept on one executor alone. Only nodes that have an edge to another one
    appear. Raises RuntimeError if max_rounds do not suffice."""
    work_folder(edges.sparkSession)
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    rounds = []
    for _ in range(max_rounds):
        both = left.select(F.col("a").alias("node"), F.col("a").alias("low")).union(left.select(F.col("b"), F.col("a")))
        up = both.groupBy("node").agg(F.min("low").alias("root")).checkpoint()
        first = True
        while True:
            top = up.select(F.col("node").alias("n"), F.col("root").alias("top"))
            here = F.when((F.col("top") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root")) if first else F.col("top")
            up = up.join(top, F.col("root") == F.col("n")).select("node", here.alias("root"), (F.lit(first) | (F.col("top") != F.col("root"))).alias("moved")).checkpoint()
            if up.filter("moved").isEmpty():
                break
            up, first = up.select("node", "root"), False
        up = up.select("node", "root")
        rounds.append(up)
        first = left.join(up.select("node", F.col("root").alias("ra")), F.col("a") == F.col("node")).select("ra", "b")
        second = first.join(up.select("node", F.col("root").alias("rb")), F.col("b") == F.col("node")).filter("ra <> rb")
        left = second.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().checkpoint()
        if left.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    label = rounds[0].withColumnRenamed("root", "label")
    for up in rounds[1:]:
        step = up.select(F.col("node").alias("n"), "root")
        label = label.join(step, F.col("label") == F.col("n"), "left").select("node", F.coalesce("root", "label").alias("label"))
    return label.checkpoint()
