"""The tables behind the dashboard charts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.dates import AsOf, check_range, to_date
from tallybook.functions.scalars import money, month_name, null_if_zero, short_label, total, zero
from tallybook.operators.filters import in_range
from tallybook.operators.series import month_ends_within, resample, trend_and_mean
from tallybook.schema import CHANNEL_SHOP, CHANNEL_WEB
from tallybook.session import small_table, staged


def _sums() -> list[Column]:
    """All sums and counts that rankings and shares are made of. A plan works out only those it uses."""
    essential, recurrent = F.col("essential"), F.col("recurrent")
    flags = [f(c).alias(f"{n}_{c}") for c in ("product", "essential", "recurrent") for n, f in (("sum", F.sum), ("n", F.count))]
    return [
        total("amount").alias("amount"), F.count("amount").alias("n_amounts"), F.count("*").alias("n_rows"), *flags,
        F.count_if((essential == 1) & (recurrent == 1)).alias("n_both"), F.count_if((essential == 0) & (recurrent == 0)).alias("n_neither"),
    ]


def _share(part: str, whole: str, digits: int) -> Column:
    """Percent of two counts, each added up over the groups of a summary."""
    return F.round(F.try_divide(F.sum(part), F.sum(whole)) * 100, digits)


def _top_vendors(sums: DataFrame, n: int, digits: int) -> DataFrame:
    top = sums.orderBy(F.desc("amount"), "std_description").limit(n)
    exact = F.col("amount").cast("double")
    return top.select("std_description", short_label("std_description").alias("label"), exact.alias("total"), F.round(exact / F.col("n_amounts"), digits).alias("mean"))


def top_vendors(ledger: DataFrame, n: int = 10, digits: int = 4) -> DataFrame:
    """The n standard names with the largest sums; ties by name, fewer rows if there are fewer names."""
    return _top_vendors(ledger.groupBy("std_description").agg(*_sums()), n, digits)


def channel_share(ledger: DataFrame, channels: tuple[str, ...] = (CHANNEL_SHOP, CHANNEL_WEB), digits: int = 6) -> DataFrame:
    """Share of the amount by channel in percent; listed channels are always present."""
    sums = ledger.groupBy("channel").agg(total("amount").alias("amount"))
    listed = small_table(ledger.sparkSession, [(c,) for c in channels], T.StructType([T.StructField("channel", T.StringType())]))
    padded = sums.unionByName(listed.withColumn("amount", zero())).groupBy("channel").agg(
        F.sum("amount").cast("double").alias("total")
    )
    # One row per channel is left.
    share = F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())) * 100
    return padded.select("channel", "total", F.round(F.coalesce(share, F.lit(0.0)), digits).alias("share_pct"))


def _product_share(sums: DataFrame, digits: int) -> DataFrame:
    shares = sums.agg((F.try_divide(F.sum("sum_product"), F.sum("n_product")) * 100).alias("prodotti"))
    both = shares.select(F.round("prodotti", digits).alias("prodotti"), F.round(100 - F.col("prodotti"), digits).alias("servizi"))
    return both.unpivot([], ["prodotti", "servizi"], "kind", "share_pct")


def product_share(ledger: DataFrame, digits: int = 6) -> DataFrame:
    """Share of rows that are products, and its complement: ``(kind, share_pct)``."""
    return _product_share(ledger.agg(*_sums()), digits)


def _flag_shares(sums: DataFrame, digits: int) -> DataFrame:
    shares = sums.agg(
        _share("sum_recurrent", "n_recurrent", digits).alias("recurrent"),
        _share("sum_essential", "n_essential", digits).alias("essential"),
        _share("n_both", "n_rows", digits).alias("essential_and_recurrent"),
        _share("n_neither", "n_rows", digits).alias("neither"),
    )
    return shares.unpivot([], shares.columns, "kind", "share_pct")


def flag_shares(ledger: DataFrame, digits: int = 6) -> DataFrame:
    """Shares of rows by spending type: ``(kind, share_pct)``."""
    return _flag_shares(ledger.agg(*_sums()), digits)


def _flag_trend(sums: DataFrame, digits: int) -> DataFrame:
    return sums.groupBy("month_start").agg(
        _share("sum_essential", "n_essential", digits).alias("essential_pct"), _share("sum_recurrent", "n_recurrent", digits).alias("recurrent_pct")
    )


def flag_trend(ledger: DataFrame, digits: int = 6) -> DataFrame:
    """Share of essential and of recurrent rows per month with data."""
    return _flag_trend(ledger.groupBy(F.trunc("txn_date", "month").alias("month_start")).agg(*_sums()), digits)


def class_series(ledger: DataFrame, start: str | date, end: str | date, digits: int = 6) -> DataFrame:
    """Month sums per classification on the month ends within the range, missing months 0.

    ``class_total`` adds up the months shown, ``share_pct`` relates it to all rows of the
    range, and ``class_rank`` orders the classes by their sum over all rows of the range.
    """
    check_range(start, end)
    sums = (
        in_range(ledger, start, end)
        .groupBy("classification", F.last_day("txn_date").alias("bucket"))
        .agg(total("amount").alias("amount"))
    )
    # From here on there is one row per class and month at most.
    classes = sums.groupBy("classification").agg(F.coalesce(F.sum("amount"), zero()).alias("in_range"))
    ranked = classes.select(
        "classification",
        F.sum("in_range").over(Window.partitionBy()).cast("double").alias("range_total"),
        F.row_number().over(Window.orderBy(F.desc("in_range"), "classification")).alias("class_rank"),
    )
    blank = classes.select("classification", F.explode(month_ends_within(start, end)).alias("bucket"), zero().alias("amount"))
    shown = sums.filter(F.col("bucket") <= F.lit(to_date(end))).unionByName(blank).groupBy("classification", "bucket").agg(
        F.sum("amount").cast("double").alias("total")
    )
    with_totals = shown.withColumn("class_total", F.sum(money("total")).over(Window.partitionBy("classification")).cast("double"))
    share = F.try_divide(F.col("class_total"), F.col("range_total")) * 100
    return with_totals.join(ranked, "classification").select(
        "classification", "bucket", "total", "class_total", F.round(share, digits).alias("share_pct"), "class_rank"
    )


def class_cumsum(series: DataFrame) -> DataFrame:
    """Running total of each classification."""
    so_far = Window.partitionBy("classification").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.select(
        "classification", "bucket", "total", F.sum(money("total")).over(so_far).cast("double").alias("running_total")
    )


def class_trend(series: DataFrame) -> DataFrame:
    """Trend line and mean of each classification."""
    return trend_and_mean(series, ["classification"])


def year_months(ledger: DataFrame, start: str | date, end: str | date, classification: str | None = None) -> DataFrame:
    """Month sums from 365 days before the range to its end, zero as null: ``(year, month_no, month, total)``."""
    start, end = check_range(start, end)
    rows = in_range(ledger, start - timedelta(days=365), end)
    if classification is not None:
        rows = rows.filter(F.col("classification") == classification)
    return resample(rows, "M").select(
        F.year("bucket").alias("year"), F.month("bucket").alias("month_no"), month_name("bucket").alias("month"), null_if_zero("total").alias("total")
    )


def year_compare(ledger: DataFrame, start: str | date, end: str | date, classification: str | None = None) -> DataFrame:
    """Calendar month by year, in calendar order: ``(month_no, month, y<year>...)``."""
    years = range((to_date(start) - timedelta(days=365)).year, to_date(end).year + 1)
    wide = year_months(ledger, start, end, classification).groupBy("month_no", "month").pivot("year", list(years)).agg(F.sum("total"))
    return wide.select("month_no", "month", *[F.col(f"`{y}`").alias(f"y{y}") for y in years]).orderBy("month_no")


def year_cumsum(ledger: DataFrame, start: str | date, end: str | date, classification: str | None = None) -> DataFrame:
    """Running total within each year; null where the month itself is null."""
    so_far = Window.partitionBy("year").orderBy("month_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(money("total")).over(so_far).cast("double")
    return year_months(ledger, start, end, classification).select(
        "year", "month_no", "total", F.when(F.col("total").isNotNull(), running).alias("running_total")
    )


def year_stats(ledger: DataFrame, start: str | date, end: str | date, classification: str | None = None, digits: int = 4) -> DataFrame:
    """Mean of the non-zero months per year and its change against the year before in percent."""
    means = year_months(ledger, start, end, classification).groupBy("year").agg(F.avg("total").alias("mean"))
    before = F.lag("mean").over(Window.orderBy("year"))
    return means.select(
        "year", F.round("mean", digits).alias("mean"), F.round((F.try_divide(F.col("mean"), before) - 1) * 100, 6).alias("change_pct")
    )


GROUPED = ["inside", "month_start", "classification", "std_description", "channel"]
BY_CLASS, BY_NAME, BY_CHANNEL = ["inside", "month_start", "classification"], ["inside", "std_description"], ["inside", "channel"]


def _set_number(columns: list[str]) -> int:
    """What ``grouping_id`` says for a grouping set: a bit for each column that is not in it."""
    return sum(1 << (len(GROUPED) - 1 - i) for i, c in enumerate(GROUPED) if c not in columns)


def dashboard_summary(ledger: DataFrame, start: str | date, end: str | date) -> DataFrame:
    """All that the dashboard needs of the ledger, read once: sums by class and month, by name, and by channel.

    ``inside`` marks the range itself, as months are compared with those of the 365 days before it. ``txn_date`` is the last date
    of a group, so a group falls into the same ranges and months as its rows.
    """
    start, end = check_range(start, end)
    rows = in_range(ledger, start - timedelta(days=365), end).withColumns({
        "inside": F.col("txn_date") >= F.lit(start), "month_start": F.trunc("txn_date", "month"),
    })
    return rows.groupingSets([BY_CLASS, BY_NAME, BY_CHANNEL], *GROUPED).agg(
        F.grouping_id().cast("int").alias("grouping"), F.max("txn_date").alias("txn_date"), *_sums()
    )


def dashboard_bundle(
    ledger: DataFrame,
    as_of: AsOf | str | date | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    classification: str | None = None,
    n_vendors: int = 10,
) -> dict[str, DataFrame]:
    """All dashboard tables over one staged summary, by default over the 24 months before the reference month."""
    if start is None or end is None:
        window = AsOf.of(as_of).dashboard_window
        start, end = start or window[0], end or window[1]
    check_range(start, end)
    summary = staged(dashboard_summary(ledger, start, end), "dashboard")
    by_class, by_name, by_channel = (summary.filter(F.col("grouping") == _set_number(s)) for s in (BY_CLASS, BY_NAME, BY_CHANNEL))
    shown = by_class.filter("inside")
    series = class_series(by_class, start, end)
    return {
        "class_series": series,
        "class_cumsum": class_cumsum(series),
        "class_trend": class_trend(series),
        "year_compare": year_compare(by_class, start, end, classification),
        "year_cumsum": year_cumsum(by_class, start, end, classification),
        "year_stats": year_stats(by_class, start, end, classification),
        "top_vendors": _top_vendors(by_name.filter("inside"), n_vendors, 4),
        "channel_share": channel_share(by_channel.filter("inside")),
        "product_share": _product_share(shown, 6),
        "flag_shares": _flag_shares(shown, 6),
        "flag_trend": _flag_trend(shown, 6),
    }


# The columns that name a row of each dashboard table.
DASHBOARD_KEYS = {
    "class_series": ["classification", "bucket"], "class_cumsum": ["classification", "bucket"], "class_trend": ["classification", "bucket"],
    "year_compare": ["month_no"], "year_cumsum": ["year", "month_no"], "year_stats": ["year"], "top_vendors": ["std_description"],
    "channel_share": ["channel"], "product_share": ["kind"], "flag_shares": ["kind"], "flag_trend": ["month_start"],
}


def dashboard_long(ledger: DataFrame, as_of: AsOf | str | date | None = None, **options) -> DataFrame:
    """The whole dashboard in one table ``(section, item, field, value)``, values as numbers; key columns of an item are joined by a bar."""
    out = None
    for section, table in dashboard_bundle(ledger, as_of, **options).items():
        keys = DASHBOARD_KEYS[section]
        numbers = [f.name for f in table.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]
        named = table.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("item"), *[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
        long = named.unpivot("item", numbers, "field", "value").select(F.lit(section).alias("section"), "item", "field", F.round("value", 6).alias("value"))
        out = long if out is None else out.unionByName(long)
    return out
