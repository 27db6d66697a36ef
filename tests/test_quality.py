import random

import pandas as pd
from pyspark.sql import functions as F

from tallybook.operators import filters, quality as Q
from tallybook.schema import COPY_KEY, LEDGER
from tallybook.session import small_table
from tests.conftest import d, rows_of


def ledger_with_copies(spark, seed=0, n=200):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = rng.choice([d("2001-01-01"), d("2001-01-02"), None])
        rows.append((
            day, rng.choice([d("2001-01-03"), d("2001-01-04")]), rng.choice(["a", "b", "c"]), rng.choice([1.0, 2.5]), rng.choice(["f1", "f2"]),
            rng.choice(["owner_a", None]), "S", "casa", "negozio", False, 1, 0, 1,
        ))
    return small_table(spark, rows, LEDGER)


def test_duplicates_mark_what_pandas_marks(spark):
    led = ledger_with_copies(spark)
    frame = led.toPandas()
    assert Q.duplicate_count(led).first()[0] == frame.duplicated(subset=COPY_KEY).sum()
    repeats = Q.duplicates(led).toPandas()
    # Both keep exactly one row per key; ours keeps the first by file and booking date.
    rest = frame.sort_values(["source_file", "booking_date"], kind="stable")
    want = rest[rest.duplicated(subset=COPY_KEY)]
    columns = list(frame.columns)
    text = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert text(repeats) == text(want)


def test_suffixes_count_within_the_group(spark):
    led = ledger_with_copies(spark, 1)
    frame = led.toPandas()
    done = Q.dedup_suffix(led).toPandas()
    assert len(done) == len(frame)
    # As pandas would do it: copies by the key, counter over all columns but the description.
    hit = frame[frame.duplicated(subset=COPY_KEY, keep=False)]
    others = [c for c in frame.columns if c != "description"]
    sizes = hit.groupby(others, dropna=False).size().sort_values().tolist()
    suffixed = done[done["description"].str.contains("_")]
    got = suffixed.groupby(others, dropna=False)["description"].agg(lambda s: sorted(int(x.split("_")[1]) for x in s))
    assert sorted(len(g) for g in got) == sizes
    assert all(g == list(range(1, len(g) + 1)) for g in got)


def test_suffixes_follow_file_booking_date_and_description(raw, spark):
    rows = [("2001-01-01", "b", 1, f, "owner_a", day) for f in ("f2", "f1") for day in ("2001-01-09", "2001-01-03")] + [("2001-01-01", "c", 1)]
    led = raw(rows)
    done = Q.dedup_suffix(led, key=["txn_date", "amount", "owner", "description"], counter_by="subset")
    got = sorted(rows_of(done, "source_file", "booking_date", "description"))
    assert got == [("f1", d("2001-01-01"), "c"), ("f1", d("2001-01-03"), "b_1"), ("f1", d("2001-01-09"), "b_2"), ("f2", d("2001-01-03"), "b_3"), ("f2", d("2001-01-09"), "b_4")]
    # within one file and date, the counter of equal other columns follows the description
    names = raw([("2001-01-01", t, 1) for t in ("z", "a", "z", "a", "m", "m", "m")])
    got = sorted(rows_of(Q.dedup_suffix(names, key=["txn_date", "description"]), "description"))
    assert got == [("a_1",), ("a_2",), ("m_3",), ("m_4",), ("m_5",), ("z_6",), ("z_7",)]


def test_suffixes_over_many_ranges(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        led = spark.range(500).selectExpr("date'2001-01-01' as txn_date", "concat('d', lpad(id % 250, 3, '0')) as description", "1.0 as amount")
        done = rows_of(Q.dedup_suffix(led, key=["txn_date", "description"]), "description")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(done) == sorted((f"d{i:03d}_{2 * i + k}",) for i in range(250) for k in (1, 2))


def test_only_copies_leave_the_straight_path(spark, raw):
    led = raw([("2001-01-01", f"t{i}", i) for i in range(50)] + [("2001-01-01", "t1", 1)])
    few, many = Q.split_repeats(led, ["txn_date", "description", "amount"])
    assert few.count() == 49 and many.count() == 2
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert Q.duplicates(raw([("2001-01-01", "a", 1)]), ["description"]).count() == 0


def test_digests_tell_values_apart(spark):
    frame = spark.createDataFrame([("a", "1:b"), ("a1:", "b"), (None, "b"), ("-", "b"), ("", "b"), ("b", None), ("b", "")], "x string, y string")
    assert frame.select(Q._digest(["x", "y"]).alias("k")).distinct().count() == 7


def test_a_row_with_very_many_copies_is_sorted_in_blocks(spark, raw, monkeypatch):
    monkeypatch.setattr(Q, "COPIES_PER_TASK", 4)
    led = raw([("2001-01-02", "a", 1)] * 11 + [("2001-01-03", "b", 2)] * 3 + [("2001-01-01", "c", 3)])
    assert rows_of(Q.newest_first(led), "description") == [("b",)] * 3 + [("a",)] * 11 + [("c",)]


def test_suffix_by_key_makes_every_row_distinct(spark):
    done = Q.dedup_suffix(ledger_with_copies(spark, 2), counter_by="subset")
    assert Q.duplicate_count(done).first()[0] == 0


def test_a_copy_in_two_files_keeps_equal_suffixes_by_default(tagged):
    one = tagged([("2001-01-01", "X", 1, "casa")])
    both = one.unionByName(one.withColumn("source_file", F.lit("f2")))
    assert rows_of(Q.dedup_suffix(both), "description") == [("x_1",), ("x_1",)]
    assert sorted(rows_of(Q.dedup_suffix(both, counter_by="subset"), "description")) == [("x_1",), ("x_2",)]


def test_copies_in_small_blocks(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1), ("c", 0)], "k string, n bigint")
    got = sorted(rows_of(Q.expand_copies(rows, "n", per_task=3)))
    assert got == [("a", i) for i in range(1, 11)] + [("b", 1)]


def test_newest_first_keeps_copies(spark):
    led = ledger_with_copies(spark, 3)
    done = rows_of(Q.newest_first(led), "txn_date")
    assert len(done) == led.count()
    known = [r[0] for r in done if r[0] is not None]
    assert known == sorted(known, reverse=True)


def test_stamp_duty_bounds_are_strict(raw):
    led = raw([
        ("2025-03-01", "a", 100, "on_the_day"), ("2025-03-02", "a", 77.47, "at_the_limit"),
        ("2025-03-05", "a", 70, "due"), ("2025-03-04", "b", 7.48, "due"),
    ])
    fees = Q.add_stamp_duty(led).filter("description = 'imposta di bollo'")
    assert rows_of(fees, "txn_date", "booking_date", "amount", "source_file") == [(d("2025-03-04"), d("2025-03-04"), 2.0, "due")]


def test_violations_list_each_failed_expectation(spark):
    frame = spark.createDataFrame(
        [(1, "2001-01-01", "f", "owner_a", "casa"), (2, "2001-13-01", "g", None, "boh")], "k int, txn_date string, source_file string, owner string, classification string"
    )
    got = Q.ledger_violations(frame, ["k"], files=["f"], owners=["owner_a"], classifications=["casa"], dates=["txn_date"])
    assert sorted(rows_of(got), key=str) == sorted([
        (2, "date_format:txn_date", "2001-13-01"), (2, "file_label", "g"), (2, "owner", None), (2, "classification", "boh"),
    ], key=str)
    documents = spark.sql("select 1 as k, struct(array(1, 2) as a, array(1) as b) as e union all select 2, struct(array(1), array(1))")
    assert rows_of(Q.uneven_arrays(documents, "e", ["a", "b"], ["k"])) == [(1, "equal_lengths", "2,1")]


def test_slices_and_periods(tagged):
    led = tagged([("2001-01-01", "X", 1, "casa"), ("2001-02-01", "Y", 1, "auto"), ("2001-02-01", "Z", 1, "spesa")])
    assert rows_of(filters.slice_values(led).orderBy("slice_no")) == [(1, "auto"), (2, "spesa"), (3, "casa")]
    assert filters.slice_by_index(led, 3).count() == 1
    assert filters.slice_by_index(led, 0).count() == filters.slice_by_index(led, 9).count() == 3
    days = tagged([(f"2001-01-{i:02d}", "X", 1, "casa") for i in range(1, 11)])
    split = filters.split_periods(days, "2001-01-05", "2001-01-08")
    assert sorted(rows_of(split.groupBy("period").agg(F.min("txn_date"), F.max("txn_date")))) == [
        ("base", d("2001-01-03"), d("2001-01-05")), ("eval", d("2001-01-06"), d("2001-01-08"))
    ]


def test_missing_columns_become_null(tagged, raw):
    both = Q.union_sources(tagged([("2001-01-01", "X", 1, "casa")]), raw([("2001-01-01", "x", 1)]))
    assert sorted(map(str, rows_of(both, "classification"))) == ["('casa',)", "(None,)"]
    assert isinstance(both.toPandas(), pd.DataFrame)


def test_slices_of_very_many_values(spark):
    led = spark.range(100_000).selectExpr("date_add(date'2001-01-01', cast(id % 5000 as int)) as txn_date", "concat('c', lpad(id, 6, '0')) as classification")
    numbered = filters.slice_values(led)
    # 20 values share each day; the latest day holds 4999, 9999, ...
    assert rows_of(numbered.filter("slice_no in (1, 2, 21, 100000)").orderBy("slice_no"), "value") == [("c004999",), ("c009999",), ("c004998",), ("c095000",)]
    assert numbered.count() == numbered.select("slice_no").distinct().count() == 100_000
    assert rows_of(filters.slice_by_index(led, 99_999), "classification") == [("c090000",)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
    none = led.limit(0)
    assert filters.slice_values(none).count() == 0 and filters.slice_by_index(led, 100_001).count() == 100_000


def test_a_split_moves_no_row_and_few_copies_stay_in_place(spark, tmp_path, monkeypatch):
    """However many fingerprints are repeated: only the rows counted for the marks, and the copies, are shuffled."""
    monkeypatch.setattr(Q, "MARK_BITS", 1 << 11)
    spark.range(4000).selectExpr("id div 2 as x", "cast(null as string) as y").union(
        spark.range(10_000, 14_000).selectExpr("id as x", "'one' as y")
    ).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    unique, copies = Q.split_repeats(rows, ["x", "y"])
    for part in (unique, copies):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" not in plan and "LeftAnti" not in plan and "strategy=broadcast" in plan
    # No copy is taken for a single row, though bits are shared; every row is in one part.
    assert unique.groupBy("x", "y").count().filter("count > 1").isEmpty() and unique.filter("x < 10000").isEmpty()
    assert sorted(rows_of(unique.unionByName(copies), "x")) == sorted(rows_of(rows, "x"))


def test_suffixes_of_few_and_of_many_copies(spark):
    many = Q.COPIES_IN_PLACE * 3
    rows = spark.range(many + 3).selectExpr("case when id < 3 then 'few' else 'many' end as description", "1 as amount")
    got = sorted(rows_of(Q.dedup_suffix(rows, key=["description", "amount"], counter_by="subset"), "description"))
    assert got == sorted([(f"few_{i}",) for i in range(1, 4)] + [(f"many_{i}",) for i in range(1, many + 1)])


def test_ledger_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    from tallybook.catalog import inputs

    assert "Broadcast" not in inputs.raw_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_copies_are_moved_once_after_they_are_collapsed(spark, monkeypatch):
    """Copy groups and counter groups are found in one arrangement; groups too large for a task in ranges, with the same rows."""
    led = ledger_with_copies(spark, 4, 400)
    exchanges = {}
    for limit in (Q.ROWS_IN_GROUP, 1):
        monkeypatch.setattr(Q, "ROWS_IN_GROUP", limit)
        for counter_by in ("all", "subset"):
            done = Q.dedup_suffix(led, counter_by=counter_by)
            plan = done._jdf.queryExecution().optimizedPlan().toString()
            exchanges[counter_by, limit] = (sorted(map(str, done.collect())), plan)
    for counter_by in ("all", "subset"):
        (few, plan), (ranged, _) = exchanges[counter_by, 1_000_000], exchanges[counter_by, 1]
        assert few == ranged and len(few) == 400
        assert "Join Inner" not in plan
        executed = Q._count_in_groups(*_counted(led, counter_by))[1]._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Exchange ") == 1 and "rangepartitioning(txn_date" in executed


def _counted(led, counter_by):
    counter = [c for c in led.columns if c != "description"] if counter_by == "all" else list(COPY_KEY)
    order = [c for c in ("source_file", "booking_date", "description") if c not in counter]
    order += [c for c in led.columns if c not in counter and c not in order]
    return Q.collapse_copies(led).localCheckpoint(), COPY_KEY, counter, order, [c for c in COPY_KEY if c in counter]


def test_rows_without_a_copy_are_not_counted(raw, spark, monkeypatch):
    """A row that only shares its mark with a copy keeps its text and takes no number."""
    monkeypatch.setattr(Q, "MARK_BITS", 1 << 10)
    led = raw([("2001-01-01", f"t{i:04d}", i % 3) for i in range(3000)] + [("2001-01-01", "t2999", 2999 % 3)])
    done = Q.dedup_suffix(led, key=["txn_date", "description", "amount", "owner"])
    assert sorted(r[0] for r in rows_of(done, "description") if "_" in r[0]) == ["t2999_1", "t2999_2"] and done.count() == 3001


def test_what_was_staged_can_go(spark):
    from tallybook.session import discard, staged

    stored = staged(spark.range(3), "gone")
    assert stored.count() == 3
    discard(stored)
    assert not spark._jvm.java.io.File(stored.scratch).exists()


def test_the_stored_ledger_joins_its_tables_once(spark, monkeypatch):
    from tallybook.catalog import inputs

    made, joined = [], inputs.raw_ledger
    monkeypatch.setattr(inputs, "staged", lambda frame, name: made.append(inputs_staged(frame, name)) or made[-1])
    inputs_staged = __import__("tallybook.session", fromlist=["staged"]).staged
    monkeypatch.setattr(inputs, "_stored", {})
    assert inputs.stored_ledger(spark, "/root/testdata/sf0.001").count() == joined(spark, "/root/testdata/sf0.001").count()
    assert len(made) == 2 and not any(spark._jvm.java.io.File(m.scratch).exists() for m in made)
