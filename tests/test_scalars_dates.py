import datetime

import pytest
from pyspark.sql import functions as F

from tallybook.functions import scalars as S
from tallybook.functions.dates import AsOf, check_range, date_context, shift_months
from tests.conftest import d


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr).first()[0]


@pytest.mark.parametrize("text,want", [
    ("3,60", 3.6), ("3,60-", -3.6), ("-3,60", -3.6), ("- 3,60", -3.6), ("1.234,56", 1234.56), ("12", 12.0),
    ("", None), ("abc", None), ("nan", None), ("1,5d", None), ("--3,60", -3.6),
])
def test_parse_amount(spark, text, want):
    assert one(spark, text, S.parse_amount("v")) == want


def test_format_amount_is_the_inverse(spark):
    for value in ("1234.5", "-0.07", "1000000.0"):
        text = F.col("v").cast("double")
        assert one(spark, value, S.parse_amount(S.format_amount(text))) == float(value)


def test_dates_of_three_formats(spark):
    assert one(spark, "29/02/2024", S.parse_date("v", "dd/MM/yyyy")) == d("2024-02-29")
    assert one(spark, "31/02/2001", S.parse_date("v", "dd/MM/yyyy")) is None
    assert one(spark, "31/03/22", S.parse_date("v", "dd/MM/yy")) == d("2022-03-31")
    with pytest.raises(Exception):
        one(spark, "2001-02-30", S.parse_date("v", strict=True))


def test_rounding_labels_and_null_text(spark):
    assert one(spark, "0.125", S.round_even(F.col("v").cast("double"))) == 0.12
    assert one(spark, "2.5", S.round_even(F.col("v").cast("double"), 0)) == 2.0
    assert one(spark, "x", S.percent_text(F.lit(None).cast("double"))) == "-"
    assert one(spark, "-12.5", S.percent_text(F.col("v").cast("double"))) == "-12.50%"
    assert one(spark, "\t PANE \n", S.trim_all("v")) == "PANE"
    assert one(spark, "SUPERMERCATO ROSSI", S.short_label("v")) == "supermerca"
    assert one(spark, "2001-08-01", S.month_name(F.to_date("v"))) == "Agosto"
    assert S.normalise_header("Causale / Descrizione") == "causale_descrizione"


def test_as_of_in_january_and_on_leap_days():
    ctx = AsOf.of("2024-01-15")
    assert (ctx.prev_month_start, ctx.prev_month_end) == (d("2023-12-01"), d("2023-12-31"))
    assert (ctx.prev_month_name, ctx.prev_month_year) == ("Dicembre", "2023")
    assert AsOf.of("2024-03-31").prev_month_end_1y_ago == d("2023-02-28")
    assert AsOf.of("2024-03-31").end_3_months_before == d("2023-11-30")
    assert shift_months(d("2024-02-29"), -12) == d("2023-02-28")
    with pytest.raises(ValueError):
        check_range("2024-01-01", "2024-01-01")


def test_columns_agree_with_as_of(spark):
    days = spark.sql("select explode(sequence(date'2023-12-28', date'2025-03-05')) as day")
    for row in days.select("day", *[c.alias(n) for n, c in date_context("day").items()]).collect():
        ctx = AsOf.of(row["day"])
        for name in row.asDict():
            if name not in ("day", "report_start", "report_end"):
                assert row[name] == getattr(ctx, name), (name, row["day"])
        assert (row["report_start"], row["report_end"]) == ctx.report_window


def test_amount_is_worked_out_once(spark):
    frame = spark.createDataFrame([("- 3,60",), ("",), ("n.d.",), (None,)], "v string")
    parsed = frame.select(S.parse_amount(F.upper("v")).alias("a"))
    assert [r.a for r in parsed.collect()] == [-3.6, None, None, None]
    assert parsed._jdf.queryExecution().analyzed().toString().count("upper(") <= 3
