import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallybook.facade import Ledger, Report, Rules
from tallybook.functions.scalars import money_problem
from tallybook.operators import series as S
from tallybook.operators.filters import in_range, slice_by_index
from tallybook.plans import dashboard as D, drift, reports as R
from tallybook.schema import CATEGORY_GROUPS, MONTH_NAMES_IT
from tests.conftest import d, rows_of

CLASSES = ["spesa", "auto", "casa", "utenze", "viaggi"]


def random_ledger(tagged, n=150, seed=0, start="2023-01-01", days=560):
    rng = random.Random(seed)
    base = pd.Timestamp(start)
    rows = []
    for _ in range(n):
        day = (base + pd.Timedelta(days=rng.randrange(days))).date().isoformat()
        name = rng.choice("PQRST")
        rows.append((day, name, round(rng.uniform(1, 500), 2), rng.choice(CLASSES), rng.randint(0, 1), rng.randint(0, 1), rng.choice(["online", "negozio"]), rng.randint(0, 1)))
    return tagged(rows)


def as_series(led, **where):
    frame = led.toPandas()
    for k, v in where.items():
        frame = frame[frame[k] == v]
    return frame.assign(txn_date=pd.to_datetime(frame["txn_date"])).set_index("txn_date")["amount"]


@pytest.mark.parametrize("grain,rule", [("D", "D"), ("W", "W"), ("M", "ME")])
def test_resample_equals_pandas(tagged, grain, rule):
    led = random_ledger(tagged, 40)
    want = as_series(led).resample(rule).sum().round(2)
    got = S.resample(led, grain).toPandas().sort_values("bucket")
    assert list(pd.to_datetime(got["bucket"])) == list(want.index)
    assert np.allclose(got["total"], want.values)


def test_series_of_nothing_and_of_one_row(tagged):
    assert S.resample(tagged([]), "M").count() == 0
    assert rows_of(S.resample(tagged([("2024-02-29", "X", 5, "casa")]), "M")) == [(d("2024-02-29"), 5.0)]


def test_describe_equals_pandas(tagged):
    led = random_ledger(tagged)
    rows = as_series(led)
    rows = rows[(rows.index >= "2023-06-01") & (rows.index <= "2024-05-31")]
    got = R.describe_series(led, "2024-06-10").toPandas().set_index("statistic")
    for column, rule in (("day", "D"), ("week", "W"), ("month", "ME")):
        want = rows.resample(rule).sum().describe()
        for stat in R.STATISTICS:
            assert got.loc[stat, column] == pytest.approx(want[stat], abs=1e-3), (column, stat)


def test_trend_equals_polyfit(tagged):
    led = random_ledger(tagged)
    series = S.resample(led, "M", by=["classification"])
    got = S.trend_and_mean(series, ["classification"]).toPandas().sort_values(["classification", "bucket"])
    for _, g in got.groupby("classification"):
        fit = np.polyfit(np.arange(len(g)), g["total"], 1)
        assert np.allclose(np.polyval(fit, np.arange(len(g))), g["fitted"], atol=1e-2)
        assert g["mean"].iloc[0] == np.round(g["total"].mean(), 0)


def test_forecast_continues_a_line_and_allows_zero_periods(tagged):
    led = tagged([(f"2023-{m:02d}-15", "X", 100 + 10 * m, "casa") for m in range(1, 13)])
    series = S.resample(led, "M").withColumn("series", F.lit("x"))
    got = sorted(rows_of(S.forecast_months(series, 2, ["series"]), "bucket", "total"))
    assert [g[0] for g in got] == [d("2024-01-31"), d("2024-02-29")]
    assert [g[1] for g in got] == pytest.approx([230.0, 240.0])
    assert S.forecast_months(series, 0, ["series"]).count() == 0
    one = series.limit(1)
    assert [t for _, t in rows_of(S.forecast_months(one, 2, ["series"]), "bucket", "total")] == [one.first()["total"]] * 2


def test_matrix_rows_add_up_and_gaps_are_zero(tagged):
    led = tagged([("2023-11-05", "X", 5, "casa"), ("2024-02-05", "X", 7, "casa"), ("2024-01-10", "Y", 3, "spesa")])
    got = R.expense_matrix(led, start="2023-10-01", end="2024-03-31").collect()
    assert [r["bucket"] for r in got] == [d("2024-02-29"), d("2024-01-31"), d("2023-12-31"), d("2023-11-30")]
    assert all(r["Totale"] == sum(r[g] for g in CATEGORY_GROUPS) for r in got)
    assert [r["per_auto"] for r in got] == [0.0] * 4 and got[1]["per_vivere"] == 3.0
    overlapping = R.expense_matrix(led, start="2023-10-01", end="2024-03-31", groups={"g1": ["casa"], "g2": ["casa", "spesa"]})
    assert overlapping.first()["Totale"] == 14.0


def test_expense_report_has_forecast_rows_inside_its_mean(tagged):
    led = random_ledger(tagged)
    plain = R.expense_report(led, "2024-06-10").toPandas()
    longer = R.expense_report(led, "2024-06-10", forecast=True, periods=3).toPandas()
    assert len(longer) == len(plain) + 3 and list(longer["bucket"])[-1] == "Mean"
    body = longer[longer["bucket"] != "Mean"]
    assert longer[longer["bucket"] == "Mean"]["Totale"].iloc[0] == pytest.approx(body["Totale"].mean(), abs=0.02)


def test_budget_margins_and_as_of_month(tagged):
    led = random_ledger(tagged)
    rows = {r["category"]: r.asDict() for r in R.budget_pivot(led, "2024-06-10", 2023).collect()}
    for r in rows.values():
        assert r["Totale"] == pytest.approx(sum(r[m] for m in MONTH_NAMES_IT))
    for m in [*MONTH_NAMES_IT, "Totale"]:
        assert rows["Totale"][m] == pytest.approx(sum(r[m] for c, r in rows.items() if c != "Totale"))
    current = {r["category"]: r.asDict() for r in R.budget_pivot(led, "2024-06-10").collect()}
    assert all(r["Giugno"] == 0 for r in current.values())
    june = as_series(led)
    june = june[(june.index.year == 2024)].sum()
    assert current["Totale"]["Totale"] == pytest.approx(june)
    cut = {r["category"]: r.asDict() for r in R.budget_pivot(led, "2024-06-10", consistent_ytd=True).collect()}
    assert cut["Totale"]["Totale"] == pytest.approx(sum(current["Totale"][m] for m in MONTH_NAMES_IT if m not in ("Giugno", "Luglio")))


def test_budget_keeps_last_years_category_and_avoids_zero_division(tagged):
    led = tagged([("2023-02-01", "X", 10, "casa"), ("2023-12-01", "X", 99, "casa"), ("2024-03-01", "Y", 30, "auto"), ("2024-03-01", "Z", 1, "boh")])
    delta = {r["category"]: tuple(r)[1:] for r in R.budget_delta(led, "2024-06-10").collect()}
    assert delta == {"per_casa": (0.0, 10.0, -100.0), "per_auto": (30.0, 0.0, None), "(unmapped)": (1.0, 0.0, None), "Totale": (31.0, 10.0, 210.0)}
    table = {r["category"]: r.asDict() for r in R.budget_table(led, "2024-06-10").collect()}
    assert table["per_casa"]["Totale"] == 0 and table["per_casa"]["delta_text"] == "-100.00%" and table["per_auto"]["delta_text"] == "-"
    assert rows_of(R.unmapped_classes(led)) == [("boh",)]


def test_january_compares_nothing(tagged):
    led = tagged([("2023-12-05", "X", 5, "casa"), ("2023-01-05", "X", 5, "casa")])
    assert rows_of(R.class_summary(led, "2024-01-20")) == [("casa", 5.0, None)]


def test_class_summary_keeps_every_class(tagged):
    led = tagged([("2024-05-05", "X", 5, "casa"), ("2023-05-05", "X", 4, "casa"), ("2020-01-01", "Y", 1, "auto")])
    assert rows_of(R.class_summary(led, "2024-06-10")) == [("casa", 5.0, 25.0), ("auto", 0.0, None)]


def test_report_on_the_daily_summary_equals_the_parts(tagged):
    led = random_ledger(tagged)
    parts = Report.report(led, "2024-06-10")
    assert sorted(rows_of(parts["expenses"])) == sorted(rows_of(R.expense_report(led, "2024-06-10")))
    assert sorted(rows_of(parts["statistics"])) == sorted(rows_of(R.describe_series(led, "2024-06-10")))
    long = R.report_long(led, "2024-06-10")
    assert {r[0] for r in rows_of(long.select("section").distinct())} == {"statistics", "monthly", "classes", "expenses", "budget", "budget_previous"}
    assert Ledger and Rules


def test_shares_add_to_100(tagged):
    led = random_ledger(tagged)
    assert sum(r["share_pct"] for r in D.channel_share(led).collect()) == pytest.approx(100, abs=1e-5)
    assert sum(r["share_pct"] for r in D.product_share(led).collect()) == pytest.approx(100, abs=1e-5)
    shop = led.filter("channel = 'negozio'")
    assert sorted(rows_of(D.channel_share(shop), "channel", "share_pct")) == [("negozio", 100.0), ("online", 0.0)]
    frame = led.toPandas()
    got = dict(rows_of(D.flag_shares(led)))
    assert got["neither"] == pytest.approx(((frame.essential == 0) & (frame.recurrent == 0)).mean() * 100, abs=1e-5)


def test_class_series_with_a_partial_last_month(tagged):
    led = tagged([("2024-01-10", "X", 10, "casa"), ("2024-03-10", "X", 30, "casa"), ("2024-02-10", "Y", 60, "auto")])
    got = rows_of(D.class_series(led, "2024-01-01", "2024-03-15").orderBy("class_rank", "bucket"))
    assert got == [
        ("auto", d("2024-01-31"), 0.0, 60.0, 60.0, 1), ("auto", d("2024-02-29"), 60.0, 60.0, 60.0, 1),
        ("casa", d("2024-01-31"), 10.0, 10.0, 10.0, 2), ("casa", d("2024-02-29"), 0.0, 10.0, 10.0, 2),
    ]
    running = rows_of(D.class_cumsum(D.class_series(led, "2024-01-01", "2024-03-15")).orderBy("classification", "bucket"), "running_total")
    assert running == [(0.0,), (60.0,), (10.0,), (10.0,)]


def test_years_compared(tagged):
    led = tagged([("2023-02-10", "X", 10, "casa"), ("2023-04-10", "X", 30, "casa"), ("2024-02-10", "X", 40, "casa"), ("2024-03-01", "Y", 9, "auto")])
    wide = rows_of(D.year_compare(led, "2024-01-01", "2024-03-31", "casa"))
    assert (2, "Febbraio", 10.0, 40.0) in wide and (3, "Marzo", None, None) in wide and len(wide) == 12
    stats = rows_of(D.year_stats(led, "2024-01-01", "2024-03-31", "casa").orderBy("year"))
    assert stats == [(2023, 20.0, None), (2024, 40.0, 100.0)]
    running = rows_of(D.year_cumsum(led, "2024-01-01", "2024-03-31", "casa").orderBy("year", "month_no"), "year", "month_no", "running_total")
    assert (2023, 3, None) in running and (2023, 4, 40.0) in running


def test_top_vendors_with_fewer_than_n(tagged):
    led = tagged([("2024-01-01", "Supermercato", 2, "spesa"), ("2024-01-02", "Supermercato", 4, "spesa"), ("2024-01-01", "Bar", 6, "spesa")])
    assert rows_of(D.top_vendors(led, 10)) == [("Bar", "bar", 6.0, 6.0), ("Supermercato", "supermerca", 6.0, 3.0)]


def test_dashboard_bundle_is_complete(tagged):
    parts = Report.dashboard(random_ledger(tagged), "2024-06-10")
    assert len(parts) == 11 and all(len(p.columns) > 1 for p in parts.values())
    assert parts["flag_trend"].count() > 0


def test_sums_are_exact_whatever_the_order_and_size(spark):
    day = "date'2024-01-01' as txn_date"
    small = spark.range(1000).selectExpr(day, "0.004D as amount")
    assert rows_of(S.resample(small, "D"), "total") == [(4.0,)]
    large = spark.range(3).selectExpr(day, "1e16D as amount").unionByName(spark.range(5).selectExpr(day, "0.004D as amount"))
    assert rows_of(S.resample(large, "D"), "total") == [(3e16,)]
    cancel = spark.createDataFrame([(1e16,), (0.25,), (-1e16,), (1e-9,)] * 3, "amount double").selectExpr(day, "amount")
    for frame in (cancel, cancel.orderBy("amount"), cancel.orderBy(F.desc("amount")).coalesce(1)):
        assert rows_of(S.resample(frame, "D"), "total") == [(0.750000003,)]
    assert rows_of(S.resample(spark.range(1).selectExpr(day, "double('nan') as amount"), "D"), "total") == [(0.0,)]
    with pytest.raises(Exception):
        S.resample(spark.range(1).selectExpr(day, "1e27D as amount"), "D").collect()


def test_amounts_that_are_not_kept_are_named(spark):
    frame = spark.createDataFrame([(1.5,), (1e-13,), (1e27,), (float("inf"),), (float("nan"),), (None,), (0.1 + 0.2,), (-1e25,)], "amount double")
    got = [r[0] for r in rows_of(frame.select(money_problem("amount")))]
    assert got == [None, "more than 12 decimals", "too large", "too large", "no number", None, "more than 12 decimals", None]


def test_reports_keep_fractions_of_a_cent(tagged):
    led = tagged([(f"2024-05-{1 + i % 28:02d}", "X", 0.004, "casa") for i in range(500)] + [("2024-05-03", "Y", 1e16, "auto")])
    got = dict(rows_of(R.class_summary(led, "2024-06-10"), "classification", "total"))
    assert got == {"casa": 2.0, "auto": 1e16}
    daily = R.daily_totals(led)
    assert rows_of(R.expense_matrix(daily, "2024-06-10"), "per_casa", "Totale") == [(2.0, 1e16 + 2)]
    assert rows_of(R.budget_delta(daily, "2024-06-10").filter("category = 'per_casa'"), "this_year") == [(2.0,)]
    assert {r[0]: r[1] for r in rows_of(D.class_cumsum(D.class_series(led, "2024-05-01", "2024-05-31")), "classification", "running_total")} == {"casa": 2.0, "auto": 1e16}


def test_bundles_read_the_ledger_once(spark, tagged, tmp_path):
    path = str(tmp_path / "ledger")
    random_ledger(tagged).write.parquet(path)
    led = spark.read.parquet(path)
    tables = {**Report.report(led, "2024-06-10", forecast=True), **Report.dashboard(led, "2024-06-10"), **Report.validate(led, "2024-06-10", slice_index=1)}
    for name, table in tables.items():
        # only the staged summary is read, which was written in one pass
        assert len({f.rsplit("/", 1)[0] for f in table.inputFiles()}) == 1 and not any("/ledger/" in f for f in table.inputFiles()), name
    for summary in (R.daily_totals(led), D.dashboard_summary(led, "2023-06-01", "2024-05-31"), drift.drift_summary(led, "2024-02-29", "2024-05-31")):
        assert summary._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_dashboard_tables_of_the_summary_equal_those_of_the_ledger(tagged):
    led = random_ledger(tagged)
    start, end = "2023-08-10", "2024-05-20"
    bundle = D.dashboard_bundle(led, start=start, end=end, classification="casa", n_vendors=3)
    rows = in_range(led, start, end)
    plain = {
        "class_series": D.class_series(led, start, end), "year_compare": D.year_compare(led, start, end, "casa"), "year_cumsum": D.year_cumsum(led, start, end, "casa"),
        "year_stats": D.year_stats(led, start, end, "casa"), "top_vendors": D.top_vendors(rows, 3), "channel_share": D.channel_share(rows),
        "product_share": D.product_share(rows), "flag_shares": D.flag_shares(rows), "flag_trend": D.flag_trend(rows),
    }
    for name, table in plain.items():
        assert sorted(map(str, table.collect())) == sorted(map(str, bundle[name].collect())), name
    long = D.dashboard_long(led, start=start, end=end)
    assert {r[0] for r in rows_of(long.select("section").distinct())} == set(D.DASHBOARD_KEYS)


def test_a_sliced_validation_equals_that_of_the_slice(tagged):
    led = random_ledger(tagged)
    for k in (1, 2, 99):
        whole = drift.validate_long(led, "2024-02-29", "2024-05-31", slice_index=k)
        part = drift.validate_long(slice_by_index(led, k), "2024-02-29", "2024-05-31")
        assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))
