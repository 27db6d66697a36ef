import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallybook.catalog.oracles import ORACLES
from tallybook.catalog.queries import REGISTRY

SF = "/root/testdata/sf0.001"
SMOKE = ["expense_matrix", "classify", "pair_amounts", "dedup_suffix", "drift_numeric", "rule_overlaps"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SMOKE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got = queries()[name](spark, SF)
    want = db.execute(oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(c[0] for c in want.description) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    text = lambda v: repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    left = sorted(tuple(text(v) for v in r) for r in got.select(*columns).collect())
    assert left == sorted(tuple(text(r[i]) for i in order) for r in want.fetchall())


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


def test_the_load_keeps_no_joined_tables_and_equals_its_sql(spark, monkeypatch):
    """The joined tables leave the disk once the tagged rows are staged; what is returned does not read them."""
    from tallybook.catalog import queries as catalog

    made, stage = [], catalog.staged
    monkeypatch.setattr(catalog, "staged", lambda frame, name: made.append(stage(frame, name)) or made[-1])
    loaded = REGISTRY["load_ledger"](spark, SF)
    assert len(made) == 1 and not spark._jvm.java.io.File(made[0].scratch).exists()
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = db.execute(f"SELECT description, std_description, source_file, amount FROM ({ORACLES['load_ledger']})").fetchall()
    assert sorted(map(tuple, loaded.select("description", "std_description", "source_file", "amount").collect())) == sorted(want)
