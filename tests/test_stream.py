import pytest
from pyspark.sql import functions as F

from tallybook.sources import statements
from tallybook.streaming import ingest as G
from tests.conftest import d, rows_of

HEADER = "txn_date,booking_date,description,amount,source_file,owner\n"


def put(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(HEADER + "".join(",".join(r) + "\n" for r in rows))


def row(day, text, amount, file="f1"):
    return (day, day, text, str(amount), file, "owner_a")


def test_files_are_read_once_and_repeats_marked(spark, rules, tmp_path):
    source, target = tmp_path / "in" / "bank", str(tmp_path / "ledger")
    table = rules([("PANE", "spesa", ["pane"])])
    run = lambda: G.ingest(spark, str(tmp_path / "in" / "*"), target, str(tmp_path / "state"), table, archive=str(tmp_path / "done"), max_files=1)
    put(source, "a.csv", row("2001-01-01", "pane", 1), row("2001-01-02", "pane", 2), row("2001-01-02", "pane", 2))
    run()
    run()
    put(source, "b.csv", row("2001-01-01", "pane", 1, "f2"), row("2001-01-03", "latte", 3))
    put(source, "c.csv", row("2001-01-03", "latte", 3, "f3"))
    run()
    got = sorted(rows_of(G.ledger_so_far(spark, target), "txn_date", "std_description", "amount", "status"))
    assert got == [
        (d("2001-01-01"), "PANE", 1.0, "new"), (d("2001-01-01"), "PANE", 1.0, "repeat"),
        (d("2001-01-02"), "PANE", 2.0, "new"), (d("2001-01-02"), "PANE", 2.0, "new"),
        (d("2001-01-03"), "latte", 3.0, "new"), (d("2001-01-03"), "latte", 3.0, "repeat"),
    ]
    again = G.retag_history(spark, target, rules([("MILK", "spesa", ["latte"])]))
    assert sorted({r[0] for r in rows_of(again, "std_description")}) == ["MILK", "pane"]


def test_a_replayed_batch_changes_nothing(spark, raw, rules, tmp_path):
    table = rules([("PANE", "spesa", ["pane"])])
    target = str(tmp_path / "ledger")
    first, second = raw([("2001-01-01", "pane", 1)]), raw([("2001-01-01", "pane", 1, "f2"), ("2001-01-05", "pane", 1)])
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        G.write_batch(batch, number, table, target)
    assert sorted(rows_of(G.ledger_so_far(spark, target), "batch_id", "status")) == [(0, "new"), (1, "new"), (1, "repeat")]
    assert rows_of(G.ledger_so_far(spark, str(tmp_path / "none"))) == []


def test_a_second_stream_keeps_the_rows_of_the_first(spark, rules, tmp_path):
    table, target = rules([("PANE", "spesa", ["pane"])]), str(tmp_path / "ledger")
    put(tmp_path / "one" / "bank", "a.csv", row("2001-01-01", "pane", 1), row("2001-01-01", "pane", 1))
    put(tmp_path / "two" / "bank", "b.csv", row("2001-01-01", "pane", 1, "f2"), row("2001-01-04", "pane", 4, "f2"))
    for name in ("one", "two"):
        G.ingest(spark, str(tmp_path / name / "*"), target, str(tmp_path / f"state-{name}"), table)
    assert sorted(rows_of(G.ledger_so_far(spark, target), "amount", "status")) == [(1.0, "new"), (1.0, "new"), (1.0, "repeat"), (4.0, "new")]


def test_statements_of_all_kinds_come_out_as_in_a_plain_load(spark, rules, tmp_path):
    table, target = rules([("PANE", "spesa", ["pane"])]), str(tmp_path / "ledger")
    text, bank, card = (tmp_path / n / "owner_a" for n in ("text", "bank", "card"))
    for folder in (text, bank, card):
        folder.mkdir(parents=True)
    (text / "a.txt").write_text("01/02/2001 02/02/2001 pane uno\n1,50\n03/02/2001 03/02/2001 latte\n2.000,00\n")
    (text / "b.txt").write_text("05/02/2001 05/02/2001 pane due\n7,00-\n")
    (bank / "b.csv").write_text("Data Contabile,Data Valuta,Causale / Descrizione,Importo,Canale,Divisa\n01/02/2001,03/02/2001,luce,-40.25,W,EUR\n01/02/2001,03/02/2001,paga,9,W,EUR\n")
    (card / "c.csv").write_text("Data Operazione,Data Registrazione,Descrizione Operazione,Importo (€)\n01/02/2001,03/02/2001,pane tre,1.5\n,,Totale,3.5\n")
    kinds = {"card_text": text, "bank_csv": bank, "card_csv": card}
    G.ingest_statements(spark, {k: str(f) for k, f in kinds.items()}, target, str(tmp_path / "state"), table)
    G.ingest_statements(spark, {k: str(f) for k, f in kinds.items()}, target, str(tmp_path / "state"), table)
    plain = statements.parse_card_text(statements.read_statement_lines(spark, str(text)))
    plain = plain.unionByName(statements.load_bank_table(spark, str(bank))).unionByName(statements.load_card_table(spark, str(card)))
    got = G.ledger_so_far(spark, target)
    assert sorted(rows_of(got, *plain.columns), key=str) == sorted(rows_of(plain), key=str) and got.count() == 5
    assert {r[0] for r in rows_of(got, "status")} == {"new"}
    loaded = G.load_ingested(spark, target, rules([("PANE", "spesa", ["pane"], True)]))
    assert sorted(rows_of(loaded, "description")) == [("latte",), ("luce",)]


def test_one_wrong_date_reads_one_more_month(spark, raw, rules, tmp_path):
    table, target = rules([("PANE", "spesa", ["pane"])]), str(tmp_path / "ledger")
    G.write_batch(raw([(f"{y}-{m:02d}-05", "pane", y + m) for y in range(1999, 2004) for m in range(1, 13)]), 0, table, target)
    G.write_batch(raw([("2003-12-05", "pane", 2015, "f2"), ("1999-01-05", "pane", 2000, "f2"), ("2003-12-06", "pane", 2015, "f2")]), 1, table, target)
    assert sorted(rows_of(G.ledger_so_far(spark, target).filter("batch_id = 1"), "amount", "status")) == [(2000.0, "repeat"), (2015.0, "new"), (2015.0, "repeat")]
    two = G.store(spark, target).rows([199901, 200312])
    assert len(two.inputFiles()) >= 60 and "month#" in (plan := two._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: [" in plan
    assert {f.split("month=")[1][:6] for f in (r[0] for r in two.select(F.input_file_name()).distinct().collect())} == {"199901", "200312"}


def test_rows_without_a_date_are_kept_and_compared(spark, raw, rules, tmp_path):
    table, target = rules([]), str(tmp_path / "ledger")
    undated = raw([("2001-01-01", "pane", 1)]).withColumn("txn_date", F.lit(None).cast("date"))
    G.write_batch(undated, 0, table, target)
    G.write_batch(undated.withColumn("source_file", F.lit("f2")), 1, table, target)
    assert sorted(rows_of(G.ledger_so_far(spark, target), "batch_id", "status")) == [(0, "new"), (1, "repeat")]


def test_compaction_changes_no_row_and_keeps_what_may_be_replayed(spark, raw, rules, tmp_path):
    table, target = rules([("PANE", "spesa", ["pane"])]), str(tmp_path / "ledger")
    batches = [raw([(f"2001-0{1 + i % 3}-0{1 + i}", "pane", i), ("2001-01-01", "pane", 99, f"f{i}")]) for i in range(5)]
    for i, batch in enumerate(batches):
        G.write_batch(batch, i, table, target)
    at = G.store(spark, target)
    before, reader = sorted(map(str, at.rows().collect())), at.rows()
    assert at.compact() and len(at.current()[1]) == 2 and not at.compact()
    assert sorted(map(str, at.rows().collect())) == before == sorted(map(str, reader.collect()))
    G.write_batch(batches[4], 4, table, target)
    assert sorted(map(str, at.rows().collect())) == before
    G.write_batch(raw([("2001-01-01", "pane", 99, "f9")]), 5, table, target)
    assert rows_of(at.rows().filter("batch_id = 5"), "status") == [("repeat",)]
    assert at.compact() and at.vacuum() > 0 and len(at.current()[1]) == 2
    assert sorted(map(str, at.rows().filter("batch_id < 5").collect())) == before
    assert sum(f.is_dir() and f.name.startswith("batch=") for f in (tmp_path / "ledger").iterdir()) == 2


def test_of_two_writers_both_are_listed(spark, raw, rules, tmp_path):
    target = str(tmp_path / "ledger")
    one, other = G.store(spark, target), G.store(spark, target)
    seen, current = [], one.current

    def slow():
        found = current()
        if not seen:
            seen.append(1)
            G.write_batch(raw([("2001-01-02", "b", 2)]), 0, rules([]), target, "other")
        return found

    one.current = slow
    row = other.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in G.STORED])
    one.put(row, "one", 0)
    assert sorted(e["source_id"] for e in other.current()[1]) == ["one", "other"]


def test_a_failed_batch_leaves_the_store_as_it_was(spark, raw, rules, tmp_path):
    target = str(tmp_path / "ledger")
    G.write_batch(raw([("2001-01-02", "b", 2)]), 0, rules([]), target)
    with pytest.raises(Exception, match="broken"):
        G.write_batch(raw([("2001-01-03", "c", 2)]).withColumn("amount", F.raise_error(F.lit("broken")).cast("double")), 1, rules([]), target)
    assert rows_of(G.ledger_so_far(spark, target), "description") == [("b",)]


def test_repeats_are_found_in_one_move_and_by_joins_alike(spark, raw, rules, tmp_path, monkeypatch):
    """Equal rows of one file and of others, with and without history: the same whether groups fit into a task or not."""
    from tallybook.operators import quality as Q
    from tallybook.operators.rules import tag_ledger

    table = rules([("PANE", "spesa", ["pane"])])
    batch = tag_ledger(raw([("2001-01-0" + str(1 + i % 3), "pane", i % 4, f"f{i % 5}") for i in range(60)] + [("2001-01-01", "pane", 7, "f9")] * 20), table)
    history = tag_ledger(raw([("2001-01-01", "pane", 0), ("2001-01-01", "pane", 0), ("2001-02-01", "x", 1)]), table)
    moved = {}
    for limit in (Q.ROWS_IN_GROUP, 1):
        monkeypatch.setattr(Q, "ROWS_IN_GROUP", limit)
        moved[limit] = sorted(rows_of(G.mark_repeats(batch, history), "txn_date", "amount", "source_file", "status"))
    assert moved[1] == moved[1_000_000] and len(moved[1]) == 80
    assert {r[3] for r in moved[1] if r[:2] == (d("2001-01-01"), 0.0)} == {"repeat"} and sum(r[1] == 7.0 and r[3] == "new" for r in moved[1]) == 20
    new = {(r[0], r[1], r[2]) for r in moved[1] if r[3] == "new"}
    assert len({(day, amount) for day, amount, _ in new}) == len(new)


def test_a_batch_is_stored_from_where_it_is(spark, raw, rules, tmp_path, monkeypatch):
    """Rows are gathered by month once, when the batch is staged; the store does not move them again."""
    seen, write = [], G.Batches._write
    monkeypatch.setattr(G.Batches, "_write", lambda self, rows, gathered=False: seen.append((gathered, rows._jdf.queryExecution().optimizedPlan().toString())) or write(self, rows, gathered))
    G.write_batch(raw([(f"2001-0{1 + i % 9}-05", f"t{i}", i) for i in range(90)]), 0, rules([]), str(tmp_path / "ledger"))
    assert len(seen) == 1 and seen[0][0] and "RebalancePartitions" not in seen[0][1]
    assert G.ledger_so_far(spark, str(tmp_path / "ledger")).count() == 90
