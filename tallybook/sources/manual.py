"""Manual entries: JSON documents that hold one array per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.scalars import parse_date

ENTRY = "data_dict"
FIELDS = ["txn_date", "booking_date", "description", "amount", "file", "owner"]
DOCUMENT = T.StructType([
    T.StructField(ENTRY, T.StructType([
        T.StructField(f, T.ArrayType(T.DoubleType() if f == "amount" else T.StringType())) for f in FIELDS
    ]))
])


def read_manual_documents(spark: SparkSession, path: str | list[str], one_per_file: bool = False) -> DataFrame:
    """JSON documents, one per line or (``one_per_file``) one per file over many lines."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=one_per_file)


def _unusable():
    """Whether a document lacks an array, or its entry altogether; then no row can be made of it."""
    return F.array_contains(F.array(*[F.col(f"{ENTRY}.{f}").isNull() for f in FIELDS]), True)


def manual_violations(documents: DataFrame) -> DataFrame:
    """Documents that give no rows or uneven ones: how long each array is, null where it is missing or unreadable."""
    sizes = [F.when(F.col(f"{ENTRY}.{f}").isNotNull(), F.size(f"{ENTRY}.{f}")).alias(f) for f in FIELDS]
    uneven = F.size(F.array_distinct(F.array(*FIELDS))) > 1
    return documents.filter(_unusable()).select(*sizes).unionByName(documents.filter(~_unusable()).select(*sizes).filter(uneven))


def manual_entries(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Raw ledger rows: the i-th elements of all arrays form row i.

    A document without one of the arrays gives no rows and is listed by ``manual_violations``; ``strict`` fails on it.
    """
    zipped = F.arrays_zip(*[F.col(f"{ENTRY}.{f}").alias(f) for f in FIELDS])
    if strict:
        zipped = F.when(_unusable(), F.raise_error(F.lit("a manual document lacks an array")).cast("array<struct<" + ",".join(
            f"{f}:{'double' if f == 'amount' else 'string'}" for f in FIELDS) + ">>")).otherwise(zipped)
    return documents.select(F.inline(zipped)).select(
        parse_date("txn_date", strict=strict).alias("txn_date"),
        parse_date("booking_date", strict=strict).alias("booking_date"),
        "description",
        F.col("amount").cast("double").alias("amount"),
        F.col("file").alias("source_file"),
        "owner",
    )
