"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "filingdelta", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; master and memory come from spark-submit or the caller's environment."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a context, so that Python workers can import it wherever they run. Arrow
    batches are kept small for the session, unless it was built with sizes of its own: texts are long, and both sides hold
    a batch at a time."""
    context = spark.sparkContext
    if getattr(context, "_filingdelta_shipped", False):
        return
    built = context.getConf()
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if not built.contains(name):
            spark.conf.set(name, value)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="filingdelta-"), "filingdelta_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._filingdelta_shipped = True
