"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.session import scratch_path

# The words of every contract of this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    Cuts the lineage: what was written survives the loss of executors, and several
    consumers share one computation. The driver's garbage is collected afterwards, because Spark
    frees the shuffle files of the finished plan only then.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete frames that :func:`materialize` wrote, once nothing is left that reads them."""
    for frame in stored:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries run inside, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def bucketed(frame: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write a frame as a warehouse table dealt by ``key``, so that later steps by this key move no row of it."""
    full = f"{name}_{uuid.uuid4().hex[:12]}"
    frame.repartition(buckets, key).write.bucketBy(buckets, key).saveAsTable(full)
    frame.sparkSession.sparkContext._jvm.System.gc()
    return frame.sparkSession.table(full)


def parts(total: int | None, each: int) -> int:
    """How many parts of about ``each`` units hold ``total`` units, one at least."""
    return max(1, math.ceil((total or 0) / each))


def packed(name: str, *fields: tuple[str, T.DataType]) -> T.StructType:
    """A struct type from (name, type) pairs; ``name`` only documents the use."""
    return T.StructType([T.StructField(n, t) for n, t in fields])


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
