"""Row filters on the ledger."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.dates import check_range, to_date
from tallybook.schema import PERSONAL_FILE
from tallybook.session import as_lookup, small_table, staged

BLOCK_STARTS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType())])


def exclude_personal(ledger: DataFrame, label: str = PERSONAL_FILE, file: str = "source_file") -> DataFrame:
    """Drop personal expenses; rows without a file stay."""
    return ledger.filter(~F.col(file).eqNullSafe(F.lit(label)))


def in_range(ledger: DataFrame, start: str | date, end: str | date, day: str = "txn_date") -> DataFrame:
    """Rows of the closed range ``[start, end]``."""
    return ledger.filter(F.col(day).between(F.lit(to_date(start)), F.lit(to_date(end))))


def period_bounds(end_base: str | date, end_eval: str | date) -> tuple[date, date, date]:
    """The day before the base period, its last day, and the last day of the evaluation period, which is as long."""
    end_base, end_eval = check_range(end_base, end_eval)
    return end_base - timedelta(days=(end_eval - end_base).days), end_base, end_eval


def split_periods(ledger: DataFrame, end_base: str | date, end_eval: str | date, day: str = "txn_date") -> DataFrame:
    """Label the two adjacent half-open periods of equal length and drop all other rows.

    eval is ``(end_base, end_eval]``, base is as many days before, ``(start, end_base]``.
    """
    start, end_base, end_eval = period_bounds(end_base, end_eval)
    when = F.col(day)
    return ledger.filter((when > F.lit(start)) & (when <= F.lit(end_eval))).withColumn(
        "period", F.when(when <= F.lit(end_base), F.lit("base")).otherwise(F.lit("eval"))
    )


def drop_exceptions(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop rows whose standard name belongs to an update-exception rule."""
    names = rules.filter("update_exception").select(F.col("name").alias("std_description")).distinct()
    return ledger.join(as_lookup(names), "std_description", "left_anti").select(*ledger.columns)


def _ranged_values(ledger: DataFrame, column: str, day: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The distinct values sorted into ranges, latest first, ties by value, and each range with its size and the values before it."""
    latest = ledger.filter(F.col(column).isNotNull()).groupBy(column).agg(F.max(day).alias("latest"))
    ranged = latest.repartitionByRange(F.desc("latest"), F.asc(column)).withColumn("block", F.spark_partition_id())
    values = staged(ranged.withColumnRenamed(column, "value"), "slices")
    blocks, before = [], 0
    # One row per range comes back, not one per value.
    for block, n in sorted(tuple(r) for r in values.groupBy("block").count().collect()):
        blocks.append((block, n, before))
        before += n
    return values, blocks


def _place_in_block() -> Column:
    return F.row_number().over(Window.partitionBy("block").orderBy(F.desc("latest"), F.asc("value")))


def slice_values(ledger: DataFrame, column: str = "classification", day: str = "txn_date") -> DataFrame:
    """Enumerate the values of a column, latest first, ties by value: ``(slice_no, value)``."""
    values, blocks = _ranged_values(ledger, column, day)
    found = [(b, before) for b, _, before in blocks]
    starts = small_table(ledger.sparkSession, found, BLOCK_STARTS) if found else ledger.sparkSession.createDataFrame([], BLOCK_STARTS)
    return values.withColumn("place", _place_in_block()).join(starts, "block").select((F.col("place") + F.col("before")).cast("int").alias("slice_no"), "value")


def slice_value(ledger: DataFrame, k: int, column: str = "classification", day: str = "txn_date"):
    """The k-th value, or None. Only the range that holds it is sorted."""
    values, blocks = _ranged_values(ledger, column, day)
    held = [(b, k - before) for b, n, before in blocks if before < k <= before + n]
    if not held:
        return None
    block, place = held[0]
    return values.filter(F.col("block") == block).withColumn("place", _place_in_block()).filter(F.col("place") == place).first()["value"]


def slice_by_index(ledger: DataFrame, k: int, column: str = "classification", day: str = "txn_date") -> DataFrame:
    """Rows of the k-th value; 0 or an unknown index keeps all rows. The value is looked up first, so the filter reaches the scan."""
    value = slice_value(ledger, k, column, day) if k else None
    return ledger if value is None else ledger.filter(F.col(column) == F.lit(value))


def rules_by_flag(rules: DataFrame, status: bool = True) -> DataFrame:
    return rules.filter(F.col("update_exception") == F.lit(status))


def search_rules(rules: DataFrame, text: str) -> DataFrame:
    """Rules whose name contains the text, ignoring case."""
    return rules.filter(F.lower("name").contains(text.lower()))
