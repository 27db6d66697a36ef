"""The rule table: JSON documents in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.schema import RULE_FIELDS, RULES
from tallybook.session import as_lookup, small_table


def with_defaults(rules: DataFrame, *further: str) -> DataFrame:
    """Missing optional fields take their defaults; ``further`` columns are kept as they are."""
    return rules.select(
        "rule_ord",
        "name",
        "classification",
        F.coalesce("descriptions", F.array().cast("array<string>")).alias("descriptions"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("update_exception", "web")],
        *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("essential", "recurrent", "product_service")],
        *further,
    )


def scan_rules(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rules from JSON lines that carry ``rule_ord``; missing fields get their defaults.

    A rule without ``rule_ord`` fails the scan, since tags go by that order; without ``strict``
    it stays, for ``invalid_rules`` to list. ``scan_rules_ordered`` numbers rules by where they stand instead.
    """
    rules = with_defaults(spark.read.schema(RULES).json(path))
    if not strict:
        return rules
    missing = F.raise_error(F.concat(F.lit("rule without rule_ord: "), F.coalesce("name", F.lit("?")))).cast(rules.schema["rule_ord"].dataType)
    return rules.withColumn("rule_ord", F.when(F.col("rule_ord").isNull(), missing).otherwise(F.col("rule_ord")))


def with_document_order(records: DataFrame, name: str = "rule_ord") -> DataFrame:
    """Number records ``(path, split, pos, ...)`` from 1 in document order: by file, then by place in the file.

    ``pos`` counts up within a split and need not start at 0. Only the number of records of each split is
    brought together; the records themselves move to no other task if the splits are few enough to broadcast.
    """
    splits = records.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    # One row per split, not per record, reaches this window.
    earlier = Window.orderBy("path", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = records.join(as_lookup(starts), ["path", "split"])
    number = F.col("before") + F.col("pos") - F.col("first") + 1
    return placed.withColumn(name, number.cast("int")).drop("path", "split", "pos", "first", "before")


def scan_rules_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines without ``rule_ord``, in one or more files: numbered as they stand, files by name.

    A large file is read in splits; blank lines do not count. Lines that are no JSON object stay, for ``invalid_rules`` to list.
    """
    documents = spark.read.schema(RULE_FIELDS).option("mode", "PERMISSIVE").json(path).select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return with_defaults(with_document_order(documents))


def scan_rules_document(spark: SparkSession, path: str, collection: str = "standardized_descriptions") -> DataFrame:
    """Rules from a document store kept as one JSON object: the collection's documents by number, in the order they stand in."""
    documents = T.StructType([T.StructField(collection, T.MapType(T.StringType(), RULE_FIELDS))])
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", documents)[collection].alias("held"))
    listed = whole.select(F.posexplode(F.map_values("held")).alias("pos", "rule"))
    return with_defaults(listed.select((F.col("pos") + 1).cast("int").alias("rule_ord"), "rule.*"))


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules without a name, a classification or a place in the order."""
    return rules.filter("name is null or classification is null or rule_ord is null")


def rules_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A rule table from tuples in document order, without the order number."""
    numbered = [(i, *row) for i, row in enumerate(rows, start=1)]
    return small_table(spark, numbered, RULES)

