"""Calendar series: resampling, gap filling, trends and forecasts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.dates import to_date
from tallybook.functions.scalars import money, total, zero, zero_if_null

# grain -> (first day of the bucket, step between buckets, label of the bucket)
GRAINS = {
    "D": (lambda d: d.cast("date"), "1 day", lambda b: b),
    "W": (lambda d: F.trunc(d, "week"), "7 days", lambda b: F.date_add(b, 6)),
    "M": (lambda d: F.trunc(d, "month"), "1 month", lambda b: F.last_day(b)),
}


def _step(grain: str) -> Column:
    return F.expr(f"interval {GRAINS[grain][1]}")


def bucket_start(day: str | Column, grain: str) -> Column:
    return GRAINS[grain][0](F.col(day) if isinstance(day, str) else day)


def bucket_label(start: str | Column, grain: str) -> Column:
    """Days are labelled by themselves, weeks by their Sunday, months by their last day."""
    return GRAINS[grain][2](F.col(start) if isinstance(start, str) else start)


def fill_gaps(buckets: DataFrame, grain: str, value: str = "value", bucket: str = "bucket", by: list[str] | None = None) -> DataFrame:
    """Add the empty buckets between the first and the last, with value 0.

    Each bucket row also emits the empty ones up to its successor. The input has one
    row per bucket, so its size is bounded by the calendar and not by the ledger.
    """
    by = by or []
    nxt = F.lead(bucket).over(Window.partitionBy(*by).orderBy(bucket))
    spans = buckets.withColumn("last_own", F.coalesce(nxt - _step(grain), F.col(bucket)).cast("date"))
    days = F.sequence(F.col(bucket), F.col("last_own"), _step(grain))
    nothing = F.lit(0).cast(buckets.schema[value].dataType)
    return spans.select(*by, value, F.posexplode(days).alias("gap", bucket)).select(
        *by, bucket, F.when(F.col("gap") == 0, F.col(value)).otherwise(nothing).alias(value)
    )


def resample(
    ledger: DataFrame, grain: str = "M", value: str = "amount", by: list[str] | None = None, day: str = "txn_date", name: str = "total"
) -> DataFrame:
    """Sums per calendar bucket and group, empty buckets 0: ``(*by, bucket, total)``."""
    by = by or []
    sums = (
        ledger.filter(F.col(day).isNotNull())
        .groupBy(*by, bucket_start(day, grain).alias("bucket"))
        .agg(F.coalesce(total(value), zero()).alias(name))
    )
    filled = fill_gaps(sums, grain, name, by=by)
    return filled.select(*by, bucket_label("bucket", grain).alias("bucket"), F.col(name).cast("double").alias(name))


def month_ends_within(start: str | date, end: str | date) -> Column:
    """Array of the month ends in ``[start, end]``; a final partial month has none."""
    start, end = F.lit(to_date(start)), F.lit(to_date(end))
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, lambda m: F.last_day(m)), lambda m: m <= end)


def with_position(series: DataFrame, by: list[str], bucket: str = "bucket") -> DataFrame:
    return series.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(bucket)) - 1)


def trend_and_mean(series: DataFrame, by: list[str], value: str = "total", bucket: str = "bucket", digits: int = 4) -> DataFrame:
    """Least squares of the value on its position: slope, intercept and fitted value per row, mean per group."""
    whole = Window.partitionBy(*by)
    slope = F.regr_slope(value, "position").over(whole)
    intercept = F.regr_intercept(value, "position").over(whole)
    return with_position(series, by, bucket).select(
        *by,
        bucket,
        value,
        F.round(slope, digits).alias("slope"),
        F.round(intercept, digits).alias("intercept"),
        F.round(intercept + slope * F.col("position"), digits).alias("fitted"),
        F.bround(F.avg(money(value)).over(whole), 0).cast("double").alias("mean"),
    )


def forecast_months(series: DataFrame, periods: int = 3, by: list[str] | None = None, value: str = "total", bucket: str = "bucket") -> DataFrame:
    """The next month ends of each series: linear trend plus calendar-month effect.

    The effect of a month is its mean residual around the trend, 0 for months never
    seen. A series too short for a trend continues at its mean.
    """
    by = by or ["series"]
    placed = with_position(series, by, bucket)
    whole = Window.partitionBy(*by)
    slope = F.coalesce(F.regr_slope(value, "position").over(whole), F.lit(0.0))
    level = F.coalesce(F.regr_intercept(value, "position").over(whole), F.avg(value).over(whole))
    residuals = placed.select(
        *by,
        bucket,
        "position",
        slope.alias("slope"),
        level.alias("level"),
        (F.col(value) - (level + slope * F.col("position"))).alias("residual"),
    )
    fits = residuals.groupBy(*by).agg(
        F.max(bucket).alias("last_bucket"),
        (F.max("position") + 1).alias("n"),
        F.max("slope").alias("slope"),
        F.max("level").alias("level"),
    )
    effects = residuals.groupBy(*by, F.month(bucket).alias("month")).agg(F.avg("residual").alias("effect"))
    # An empty array for periods = 0 gives no rows.
    steps = F.array(*[F.lit(k) for k in range(1, periods + 1)]) if periods else F.array().cast("array<int>")
    future = fits.select(*by, "slope", "level", "n", "last_bucket", F.explode(steps).alias("step")).select(
        *by,
        F.last_day(F.add_months(F.trunc("last_bucket", "month"), F.col("step"))).alias(bucket),
        (F.col("level") + F.col("slope") * (F.col("n") + F.col("step") - 1)).alias("trend"),
    ).withColumn("month", F.month(bucket))
    return future.join(effects, [*by, "month"], "left").select(
        *by, bucket, (F.col("trend") + zero_if_null("effect")).alias(value)
    )
