import datetime

import pytest

from tallybook.session import build_session, small_table
from tallybook.schema import LEDGER, RAW_LEDGER
from tallybook.sources.rule_store import rules_from_rows


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")), "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def d(text):
    return datetime.date.fromisoformat(text)


@pytest.fixture
def raw(spark):
    """Raw ledger rows from (txn_date, description, amount[, source_file, owner, booking_date])."""

    def build(rows):
        full = []
        for day, text, amount, *rest in rows:
            file, owner, booking = (list(rest) + ["f1", "owner_a", day][len(rest):])[:3]
            full.append((d(day), d(booking), text, float(amount), file, owner))
        return small_table(spark, full, RAW_LEDGER) if full else spark.createDataFrame([], RAW_LEDGER)

    return build


@pytest.fixture
def tagged(spark):
    """Tagged ledger rows from (txn_date, std_description, amount, classification[, essential, recurrent, channel, product])."""

    def build(rows):
        full = []
        for day, std, amount, cls, *rest in rows:
            essential, recurrent, channel, product = (list(rest) + [0, 0, "negozio", 1][len(rest):])[:4]
            full.append((d(day), d(day), std.lower(), float(amount), "f1", "owner_a", std, cls, channel, False, essential, recurrent, product))
        return small_table(spark, full, LEDGER) if full else spark.createDataFrame([], LEDGER)

    return build


@pytest.fixture
def rules(spark):
    """Rule table from (name, classification, terms[, flags])."""

    def build(rows):
        return rules_from_rows(spark, [(*r[:3], *(list(r[3:]) + [False, False, 0, 0, 0][len(r) - 3:])) for r in rows])

    return build


def rows_of(frame, *columns):
    return [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]
