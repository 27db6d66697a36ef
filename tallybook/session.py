"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table whose rows take at most this many bytes, as counted, is broadcast.
BROADCAST_BYTES = 8 << 20


def build_session(app: str = "tallybook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tallybook-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, because
    executors of a cluster cannot see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_root()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that no other run uses."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    Cuts the lineage, so that what was worked out stays the same for all readers and survives lost executors, and
    tells the planner its true size: only a table that is small then is broadcast. What was shuffled for it leaves the disk.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    free_shuffles(frame.sparkSession)
    stored = frame.sparkSession.read.schema(frame.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what :func:`staged` wrote, once nothing is left that reads it."""
    for frame in stored:
        delete_path(frame.sparkSession, frame.scratch)


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished plan once the driver has collected its garbage, which may be never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table given in code. Built from Arrow, so the optimizer knows its exact size."""
    names = schema.fieldNames()
    columns = {n: [row[i] for row in rows] for i, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema)


def as_lookup(table: DataFrame) -> DataFrame:
    """The right side of a join on the key the table was grouped by.

    A grouped table already sits where the join wants it, so it would be joined without
    a shuffle whose size the adaptive planner could measure. Rebalancing it first lets
    the planner broadcast it when it is small and split hot keys of the other side
    when it is not.
    """
    return table.hint("rebalance")


def never_broadcast(table: DataFrame) -> DataFrame:
    """One side of a join of two tables that grow with the data.

    The planner takes the size of compressed files for that of their rows and does not count what ``explode`` adds, so it
    would gather millions of rows on the driver; the adaptive planner does not take such a choice back.
    """
    return table.hint("merge")


def sized_lookup(table: DataFrame, name: str) -> DataFrame:
    """The right side of a join, staged and counted: broadcast if its rows are few and short, else sorted and merged."""
    stored = staged(table, name)
    texts = [f.name for f in stored.schema if isinstance(f.dataType, T.StringType)]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16 * len(stored.columns)))
    size = stored.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(stored) if size <= BROADCAST_BYTES else never_broadcast(as_lookup(stored))
