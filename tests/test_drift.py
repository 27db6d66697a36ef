import random

import numpy as np
import pandas as pd
import pytest

from tallybook.plans import drift as D
from tests.conftest import rows_of


def days(n, seed):
    rng = random.Random(seed)
    return [(f"2001-01-{1 + i % 28:02d}", rng.choice("XYZ"), round(rng.uniform(1, 9), 1), rng.choice(["casa", "auto"])) for i in range(n)]


def test_profile_equals_pandas(spark):
    rng = random.Random(4)
    values = [("a", float(rng.randint(1, 9))) for _ in range(41)] + [("b", 2.0)] * 5 + [("c", 1.0), ("c", 4.0)]
    got = D.numeric_profile(spark.createDataFrame(values, "g string, total double"), ["g"]).toPandas().set_index("g")
    for g, frame in pd.DataFrame(values, columns=["g", "total"]).groupby("g"):
        s = frame["total"]
        want = {**s.describe().to_dict(), "mode": s.mode().max(), "median": s.median(), "skewness": s.skew()}
        for stat in D.PROFILE:
            if pd.isna(want[stat]):
                assert pd.isna(got.loc[g, stat])
            else:
                assert got.loc[g, stat] == pytest.approx(want[stat], abs=1e-3), (g, stat)


def test_drift_table_rounds_and_guards_zero(tagged):
    led = tagged([("2001-01-01", "X", 4, "casa"), ("2001-01-02", "X", 4, "casa"), ("2001-01-03", "X", 5, "casa"), ("2001-01-04", "X", 6, "casa")])
    got = {r["statistic"]: tuple(r)[1:] for r in D.drift_numeric(D.drift_series(led, "2001-01-02", "2001-01-04")).collect()}
    assert got["mean"] == (4.0, 5.5, 38.0) and got["std"] == (0.0, 0.71, 0.0) and got["skewness"] == (None, None, None)


def test_an_empty_period_gives_nulls(tagged):
    led = tagged([("2001-01-01", "X", 4, "casa")])
    got = {r["statistic"]: tuple(r)[1:] for r in D.drift_numeric(D.drift_series(led, "2001-01-01", "2001-01-04")).collect()}
    assert got["mean"] == (4.0, None, None)


def test_histogram_equals_numpy(tagged):
    series = D.drift_series(tagged(days(200, 1)), "2001-01-10", "2001-01-19")
    got = D.drift_histogram(series).toPandas().sort_values(["period", "bin"])
    for period, values in series.toPandas().groupby("period")["total"]:
        counts, edges = np.histogram(values, bins=20)
        mine = got[got["period"] == period]
        assert list(mine["n"]) == list(counts) and np.allclose(mine["bin_from"], edges[:-1], atol=1e-5)


def test_histogram_of_a_constant(spark):
    series = spark.createDataFrame([("base", 3.0)] * 4, "period string, total double")
    got = {b: n for b, n in rows_of(D.drift_histogram(series), "bin", "n")}
    want, _ = np.histogram([3.0] * 4, bins=20)
    assert [got[i] for i in range(1, 21)] == list(want)


def test_new_values(tagged):
    led = tagged([("2001-01-01", "X", 1, "casa"), ("2001-01-02", "Y", 1, "casa"), ("2001-01-02", "X", 1, "auto")])
    assert rows_of(D.new_values(led, "2001-01-01", "2001-01-02")) == [("classification", "auto"), ("std_description", "Y")]
    assert {r[0] for r in rows_of(D.validate_long(led, "2001-01-01", "2001-01-02"), "section")} == {"new:classification", "new:std_description", "numeric", "histogram"}
    assert set(D.validation_bundle(led, "2001-03-10", slice_index=1)) == {"new_values", "numeric", "histogram"}
