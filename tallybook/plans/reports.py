"""The report tables: series statistics, expense matrix and budget."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import AsOf, check_range
from tallybook.functions.scalars import CELL, money, month_name, percent_text, total, zero, zero_if_null
from tallybook.operators.filters import in_range
from tallybook.operators.rules import groups_table, map_category
from tallybook.operators.series import bucket_label, bucket_start, fill_gaps, forecast_months, resample
from tallybook.schema import CATEGORY_GROUPS, MEAN_LABEL, MONTH_NAMES_IT, TOTAL_LABEL
from tallybook.session import staged

STATISTICS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
UNMAPPED = "(unmapped)"


def daily_totals(ledger: DataFrame) -> DataFrame:
    """Sums by day and classification, all that the reports need.

    Its size is bounded by the calendar and the classifications, so a bundle of reports
    over it reads the ledger once.
    """
    return ledger.groupBy("txn_date", "classification").agg(total("amount").alias("amount"))


def describe_columns(value: str) -> list[Column]:
    """Count, mean, sample deviation, minimum, quartiles and maximum."""
    quartiles = {f"{int(q * 100)}%": F.percentile(value, q) for q in (0.25, 0.5, 0.75)}
    return [
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        *[c.alias(n) for n, c in quartiles.items()],
        F.max(value).alias("max"),
    ]


def describe_series(ledger: DataFrame, as_of: AsOf | str | date, digits: int = 4) -> DataFrame:
    """Statistics of the daily, weekly and monthly sums side by side: ``(statistic, day, week, month)``."""
    rows = in_range(ledger, *AsOf.of(as_of).report_window)
    daily = rows.groupBy("txn_date").agg(total("amount").alias("amount"))
    series = None
    for grain, label in (("D", "day"), ("W", "week"), ("M", "month")):
        one = resample(daily, grain).select(F.lit(label).alias("grain"), "total")
        series = one if series is None else series.unionByName(one)
    stats = series.groupBy("grain").agg(*describe_columns("total"))
    long = stats.unpivot("grain", STATISTICS, "statistic", "value")
    return long.groupBy("statistic").pivot("grain", ["day", "week", "month"]).agg(F.round(F.first("value"), digits))


def monthly_totals(ledger: DataFrame, as_of: AsOf | str | date) -> DataFrame:
    """Month sums of the report window, newest first."""
    months = resample(in_range(ledger, *AsOf.of(as_of).report_window), "M")
    return months.select("bucket", month_name("bucket").alias("month"), "total").orderBy(F.desc("bucket"))


def _sum_between(start: date, end: date) -> Column:
    inside = F.col("txn_date").between(F.lit(start), F.lit(end))
    return F.coalesce(F.sum(F.when(inside, money("amount"))), zero())


def change_percent(current: Column, previous: Column) -> Column:
    """Change in percent; null where there is nothing to compare with."""
    return F.try_divide((current - previous).cast("double"), previous.cast("double")) * 100


def class_summary(ledger: DataFrame, as_of: AsOf | str | date, digits: int = 6) -> DataFrame:
    """Per classification of the whole ledger: last month's total and the year-to-date change in percent.

    All sums come from one pass; classes without rows in a window count 0.
    """
    ctx = AsOf.of(as_of)
    sums = ledger.groupBy("classification").agg(
        _sum_between(ctx.prev_month_start, ctx.prev_month_end).alias("month_sum"),
        _sum_between(ctx.year_start, ctx.prev_month_end).alias("this_year"),
        _sum_between(ctx.prev_year_start, ctx.prev_month_end_1y_ago).alias("last_year"),
    )
    return sums.select(
        "classification",
        F.col("month_sum").cast("double").alias("total"),
        F.round(change_percent(F.col("this_year"), F.col("last_year")), digits).alias("delta_pct"),
    ).orderBy(F.desc("total"), "classification")


def class_totals_prev_month(ledger: DataFrame, as_of: AsOf | str | date) -> DataFrame:
    return class_summary(ledger, as_of).select("classification", "total").orderBy(F.desc("total"), "classification")


def class_delta_ytd(ledger: DataFrame, as_of: AsOf | str | date) -> DataFrame:
    return class_summary(ledger, as_of).select("classification", "delta_pct").orderBy(
        F.desc_nulls_last("delta_pct"), "classification"
    )


def expense_matrix(
    ledger: DataFrame,
    as_of: AsOf | str | date | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    groups: dict[str, list[str]] = CATEGORY_GROUPS,
) -> DataFrame:
    """Month sums, one column per group and ``Totale``, newest first: ``(bucket, *groups, Totale)``.

    The months shown are those between the first and the last of any group; what a
    group lacks is 0. A classification may belong to several groups.
    """
    if start is None or end is None:
        window = AsOf.of(as_of).report_window
        start, end = start or window[0], end or window[1]
    check_range(start, end)
    sums = (
        in_range(ledger, start, end)
        .groupBy("classification", bucket_start("txn_date", "M").alias("bucket"))
        .agg(total("amount").alias("amount"))
    )
    mapping = groups_table(ledger.sparkSession, groups).select("grp", "classification").distinct()
    by_group = sums.join(mapping, "classification").groupBy("grp", "bucket").agg(
        F.coalesce(F.sum("amount"), zero()).alias("amount")
    )
    months = fill_gaps(by_group, "M", "amount", by=["grp"]).withColumn("bucket", bucket_label("bucket", "M"))
    cells = months.groupBy("bucket").pivot("grp", list(groups)).agg(F.sum("amount"))
    parts = [F.coalesce(F.col(f"`{g}`"), zero()).cast(CELL) for g in groups]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return cells.select(
        "bucket", *[p.cast("double").alias(g) for p, g in zip(parts, groups)], whole.cast("double").alias(TOTAL_LABEL)
    ).orderBy(F.desc("bucket"))


def melt_matrix(matrix: DataFrame) -> DataFrame:
    return matrix.unpivot("bucket", [c for c in matrix.columns if c != "bucket"], "series", "total")


def forecast_matrix(matrix: DataFrame, periods: int = 3) -> DataFrame:
    """Forecast rows in the shape of the matrix; every column, the total too, has its own fit."""
    future = forecast_months(melt_matrix(matrix), periods, ["series"])
    columns = [c for c in matrix.columns if c != "bucket"]
    return future.groupBy("bucket").pivot("series", columns).agg(F.first("total"))


def with_mean_row(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """Months as text plus a footer row with the column means, all values rounded half even."""
    columns = [c for c in matrix.columns if c != "bucket"]
    # Decimal means, because a mean of doubles depends on row order where it ties.
    means = [F.bround(F.avg(money(f"`{c}`")), digits).cast("double").alias(c) for c in columns]
    footer = matrix.agg(*means).withColumn("bucket", F.lit(MEAN_LABEL))
    shown = matrix.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), *[F.bround(f"`{c}`", digits).alias(c) for c in columns])
    return shown.unionByName(footer)


def expense_report(
    ledger: DataFrame,
    as_of: AsOf | str | date | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    groups: dict[str, list[str]] = CATEGORY_GROUPS,
    forecast: bool = False,
    periods: int = 3,
) -> DataFrame:
    """The expense matrix with optional forecast rows and the mean footer."""
    matrix = expense_matrix(ledger, as_of, start, end, groups)
    if forecast:
        matrix = matrix.unionByName(forecast_matrix(matrix, periods))
    return with_mean_row(matrix)


def _year_rows(ledger: DataFrame, year: int, groups: dict[str, list[str]], months: int = 12) -> DataFrame:
    """Sums of one year by category and month; a plain date range, so it prunes the scan."""
    rows = ledger.filter(F.col("txn_date").between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))
    sums = rows.groupBy("classification", F.month("txn_date").alias("month_no")).agg(total("amount").alias("amount"))
    mapped = map_category(sums, groups_table(ledger.sparkSession, groups))
    return mapped.filter(F.col("month_no") <= months).groupBy(
        F.coalesce("category", F.lit(UNMAPPED)).alias("category"), "month_no"
    ).agg(F.sum("amount").alias("amount"))


def unmapped_classes(ledger: DataFrame, groups: dict[str, list[str]] = CATEGORY_GROUPS) -> DataFrame:
    """Classifications that no group holds."""
    known = groups_table(ledger.sparkSession, groups).select("classification").distinct()
    return ledger.select("classification").distinct().join(known, "classification", "left_anti")


def budget_cube(ledger: DataFrame, as_of: AsOf | str | date, year: int | None = None, groups: dict[str, list[str]] = CATEGORY_GROUPS, consistent_ytd: bool = False) -> DataFrame:
    """Category by month sums of a year with all margins, in long form: ``(category, month_no, month, total)``.

    ``month_no`` is 0 on the yearly total. In the reference year the current month
    shows 0; ``consistent_ytd`` also leaves it out of the totals.
    """
    ctx = AsOf.of(as_of)
    year = year or ctx.day.year
    current = year == ctx.day.year
    sums = _year_rows(ledger, year, groups, ctx.day.month - 1 if current and consistent_ytd else 12)
    cube = sums.cube("category", "month_no").agg(
        F.sum("amount").cast("double").alias("amount"),
        F.grouping("category").alias("all_categories"),
        F.grouping("month_no").alias("all_months"),
    )
    shown = F.when(F.col("month_no") == ctx.day.month, F.lit(0.0)).otherwise(F.col("amount")) if current else F.col("amount")
    names = F.array(*[F.lit(m) for m in MONTH_NAMES_IT])
    return cube.select(
        F.when(F.col("all_categories") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("category")).alias("category"),
        F.coalesce("month_no", F.lit(0)).alias("month_no"),
        F.when(F.col("all_months") == 1, F.lit(TOTAL_LABEL)).otherwise(F.get(names, F.col("month_no") - 1)).alias("month"),
        shown.alias("total"),
    )


def budget_pivot(ledger: DataFrame, as_of: AsOf | str | date, year: int | None = None, groups: dict[str, list[str]] = CATEGORY_GROUPS, consistent_ytd: bool = False) -> DataFrame:
    """The cube as a table: one row per category and ``Totale``, one column per month and ``Totale``."""
    cube = budget_cube(ledger, as_of, year, groups, consistent_ytd)
    columns = [*MONTH_NAMES_IT, TOTAL_LABEL]
    wide = cube.groupBy("category").pivot("month", columns).agg(F.sum("total"))
    return wide.select("category", *[zero_if_null(c).alias(c) for c in columns])


def budget_delta(ledger: DataFrame, as_of: AsOf | str | date, year: int | None = None, groups: dict[str, list[str]] = CATEGORY_GROUPS, consistent_ytd: bool = False, digits: int = 6) -> DataFrame:
    """Yearly totals against the year before by category and overall: ``(category, this_year, last_year, delta_pct)``.

    For the reference year the year before stops at the month before the current one.
    """
    ctx = AsOf.of(as_of)
    year = year or ctx.day.year
    cut = ctx.day.month - 1 if year == ctx.day.year else 12
    rows = ledger.filter(F.col("txn_date").between(F.lit(date(year - 1, 1, 1)), F.lit(date(year, 12, 31))))
    is_now = F.year("txn_date") == year
    before_cut = F.month("txn_date") <= cut
    kept = rows.filter(before_cut if consistent_ytd else is_now | before_cut)
    amount = money("amount")
    sums = kept.groupBy("classification").agg(
        F.sum(F.when(is_now, amount)).alias("now"), F.sum(F.when(~is_now, amount)).alias("before")
    )
    mapped = map_category(sums, groups_table(ledger.sparkSession, groups)).withColumn("category", F.coalesce("category", F.lit(UNMAPPED)))
    rolled = mapped.rollup("category").agg(
        F.coalesce(F.sum("now"), zero()).alias("now"), F.coalesce(F.sum("before"), zero()).alias("before"), F.grouping("category").alias("overall")
    )
    return rolled.select(
        F.when(F.col("overall") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("category")).alias("category"),
        F.col("now").cast("double").alias("this_year"),
        F.col("before").cast("double").alias("last_year"),
        F.round(change_percent(F.col("now"), F.col("before")), digits).alias("delta_pct"),
    )


def budget_table(ledger: DataFrame, as_of: AsOf | str | date, year: int | None = None, groups: dict[str, list[str]] = CATEGORY_GROUPS) -> DataFrame:
    """Budget pivot with the change column; a category known only from the year before has its own row of zeros."""
    pivot = budget_pivot(ledger, as_of, year, groups)
    delta = budget_delta(ledger, as_of, year, groups).select("category", percent_text("delta_pct").alias("delta_text"))
    months = [*MONTH_NAMES_IT, TOTAL_LABEL]
    both = pivot.join(delta, "category", "full_outer")
    return both.select("category", *[zero_if_null(m).alias(m) for m in months], F.coalesce("delta_text", F.lit("-")).alias("delta_text"))


def report_bundle(ledger: DataFrame, as_of: AsOf | str | date, forecast: bool = False, periods: int = 3, groups: dict[str, list[str]] = CATEGORY_GROUPS) -> dict[str, DataFrame]:
    """All report tables over one staged daily summary of the ledger, which is read once."""
    ctx = AsOf.of(as_of)
    daily = staged(daily_totals(ledger), "daily")
    return {
        "statistics": describe_series(daily, ctx),
        "monthly": monthly_totals(daily, ctx),
        "classes": class_summary(daily, ctx),
        "expenses": expense_report(daily, ctx, groups=groups, forecast=forecast, periods=periods),
        "budget": budget_table(daily, ctx, ctx.day.year, groups),
        "budget_previous": budget_table(daily, ctx, ctx.day.year - 1, groups),
    }


def report_long(ledger: DataFrame, as_of: AsOf | str | date, forecast: bool = False, periods: int = 3, groups: dict[str, list[str]] = CATEGORY_GROUPS) -> DataFrame:
    """The whole report in one table ``(section, item, field, value)``, values as numbers."""
    ctx = AsOf.of(as_of)
    daily = staged(daily_totals(ledger), "daily")
    sections = [
        ("statistics", "statistic", describe_series(daily, ctx)),
        ("monthly", "bucket", monthly_totals(daily, ctx).select(F.col("bucket").cast("string").alias("bucket"), "total")),
        ("classes", "classification", class_summary(daily, ctx)),
        ("expenses", "bucket", expense_report(daily, ctx, groups=groups, forecast=forecast, periods=periods)),
    ]
    for name, year in (("budget", ctx.day.year), ("budget_previous", ctx.day.year - 1)):
        sections.append((name, "category", budget_pivot(daily, ctx, year, groups)))
        sections.append((name, "category", budget_delta(daily, ctx, year, groups).select("category", "delta_pct")))
    out = None
    for section, item, table in sections:
        fields = [c for c in table.columns if c != item]
        long = table.unpivot(item, fields, "field", "value").select(
            F.lit(section).alias("section"), F.col(item).alias("item"), "field", F.round("value", 6).alias("value")
        )
        out = long if out is None else out.unionByName(long)
    return out
