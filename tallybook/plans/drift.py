"""Base-versus-evaluation drift of a ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.dates import AsOf
from tallybook.functions.scalars import money, total
from tallybook.operators.filters import period_bounds, slice_value, split_periods
from tallybook.operators.series import resample
from tallybook.session import staged

PROFILE = ["mode", "median", "mean", "skewness", "count", "std", "min", "25%", "50%", "75%", "max"]
CATEGORICAL = ["classification", "std_description"]


def new_values(ledger: DataFrame, end_base: str | date, end_eval: str | date, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Values seen in the evaluation period but not in the base: ``(column_name, value)``.

    One pass: each value remembers the periods it was seen in.
    """
    rows = split_periods(ledger, end_base, end_eval)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    distinct = rows.groupBy("period", *columns).count().select("period", F.explode(pairs).alias("p"))
    seen = distinct.groupBy("p.column_name", "p.value").agg(F.max(F.col("period") == "base").alias("in_base"))
    return seen.filter(~F.col("in_base")).select("column_name", "value").orderBy("column_name", "value")


def _skewness(value: str) -> Column:
    """Bias-corrected skewness: null below three values, 0 without variance."""
    n = F.count(value)
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(corrected, F.lit(0.0)))


def numeric_profile(series: DataFrame, by: list[str], value: str = "total", digits: int = 4) -> DataFrame:
    """Statistics of each group's values, one row per group; the mode is the largest of the most frequent."""
    mode = (
        series.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count("*").alias("n"))
        .groupBy(*by)
        .agg(F.max(F.struct("n", value)).getField(value).alias("mode"))
    )
    stats = series.groupBy(*by).agg(
        F.percentile(value, 0.5).alias("median"),
        F.avg(money(value)).cast("double").alias("mean"),
        _skewness(value).alias("skewness"),
        F.count(value).cast("double").alias("count"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.percentile(value, 0.25).alias("25%"),
        F.percentile(value, 0.5).alias("50%"),
        F.percentile(value, 0.75).alias("75%"),
        F.max(value).alias("max"),
    )
    return stats.join(mode, by, "left").select(*by, *[F.round(f"`{s}`", digits).alias(s) for s in PROFILE])


def drift_series(ledger: DataFrame, end_base: str | date, end_eval: str | date, sampling: str = "D", value: str = "amount") -> DataFrame:
    """The values compared: day (``D``) or month (``M``) sums of both periods."""
    return resample(split_periods(ledger, end_base, end_eval), sampling, value, by=["period"])


def drift_numeric(series: DataFrame) -> DataFrame:
    """Statistics side by side: ``(statistic, base, eval, diff_pct)``; a base of 0 gives a difference of 0."""
    profile = numeric_profile(series, ["period"], digits=9).unpivot("period", PROFILE, "statistic", "value")
    wide = profile.groupBy("statistic").pivot("period", ["base", "eval"]).agg(F.first("value"))
    change = F.try_divide(F.col("eval") - F.col("base"), F.col("base"))
    diff = F.when(F.col("base") == 0, F.lit(0.0)).otherwise(F.bround(F.bround(change, 2) * 100, 2))
    return wide.select("statistic", F.bround("base", 2).alias("base"), F.bround("eval", 2).alias("eval"), diff.alias("diff_pct"))


def drift_histogram(series: DataFrame, bins: int = 20, digits: int = 6) -> DataFrame:
    """Counts in equal bins between each period's own minimum and maximum, the last bin closed.

    A period with a single value gets bins of half a unit to both sides.
    """
    limits = series.groupBy("period").agg(F.min("total").alias("lo"), F.max("total").alias("hi")).filter("lo is not null")
    widened = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    limits = limits.select("period", (F.col("lo") - widened).alias("lo"), (F.col("hi") + widened).alias("hi"))
    placed = series.filter("total is not null").join(limits, "period").groupBy(
        "period", F.least(F.lit(bins), F.width_bucket("total", "lo", "hi", F.lit(bins))).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))
    every = limits.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(placed, ["period", "bin"], "left").select(
        "period",
        "bin",
        F.round(F.col("lo") + width * (F.col("bin") - 1), digits).alias("bin_from"),
        F.round(F.col("lo") + width * F.col("bin"), digits).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def drift_summary(ledger: DataFrame, end_base: str | date, end_eval: str | date) -> DataFrame:
    """All that the drift check needs of the ledger, read once: sums by day and class, and by period and value.

    ``txn_date`` is the last date of a group, so a group falls into the same period as its rows.
    """
    start_base, end_base, end_eval = period_bounds(end_base, end_eval)
    day = F.col("txn_date")
    period = F.when((day > F.lit(start_base)) & (day <= F.lit(end_base)), "base").when((day > F.lit(end_base)) & (day <= F.lit(end_eval)), "eval")
    rows = ledger.withColumns({"day": day, "period": period})
    sets = [["day", "classification"], ["period", "classification", "std_description"]]
    return rows.groupingSets(sets, "day", "period", "classification", "std_description").agg(
        F.grouping("day").alias("by_value"), F.max("txn_date").alias("txn_date"), total("amount").alias("amount")
    ).drop("day", "period")


def validation_bundle(
    ledger: DataFrame,
    as_of: AsOf | str | date | None = None,
    sampling: str = "D",
    slice_index: int = 0,
    end_base: str | date | None = None,
    end_eval: str | date | None = None,
) -> dict[str, DataFrame]:
    """New values, statistics and histograms over one staged summary; by default the last 3 months against as many days before.

    A ``slice_index`` limits them to the class of that number, the one with the latest rows first; 0 or an unknown one takes all.
    """
    if end_base is None or end_eval is None:
        ends = AsOf.of(as_of).drift_ends
        end_base, end_eval = end_base or ends[0], end_eval or ends[1]
    summary = staged(drift_summary(ledger, end_base, end_eval), "drift")
    days, values = summary.filter("by_value = 0"), summary.filter("by_value = 1")
    chosen = slice_value(days, slice_index) if slice_index else None
    if chosen is not None:
        days, values = (f.filter(F.col("classification") == F.lit(chosen)) for f in (days, values))
    series = drift_series(days, end_base, end_eval, sampling)
    return {
        "new_values": new_values(values, end_base, end_eval),
        "numeric": drift_numeric(series),
        "histogram": drift_histogram(series),
    }


def validate_long(ledger: DataFrame, end_base: str | date, end_eval: str | date, sampling: str = "D", slice_index: int = 0) -> DataFrame:
    """The drift check as one table ``(section, item, base, eval, diff_pct)``."""
    parts = validation_bundle(ledger, sampling=sampling, slice_index=slice_index, end_base=end_base, end_eval=end_eval)
    blank = F.lit(None).cast("double")
    news = parts["new_values"].select(
        F.concat(F.lit("new:"), F.col("column_name")).alias("section"),
        F.col("value").alias("item"),
        blank.alias("base"),
        blank.alias("eval"),
        blank.alias("diff_pct"),
    )
    numeric = parts["numeric"].select(F.lit("numeric").alias("section"), F.col("statistic").alias("item"), "base", "eval", "diff_pct")
    bins = parts["histogram"].groupBy("bin").pivot("period", ["base", "eval"]).agg(F.sum("n")).select(
        F.lit("histogram").alias("section"),
        F.col("bin").cast("string").alias("item"),
        F.col("base").cast("double").alias("base"),
        F.col("eval").cast("double").alias("eval"),
        blank.alias("diff_pct"),
    )
    return news.unionByName(numeric).unionByName(bins)
