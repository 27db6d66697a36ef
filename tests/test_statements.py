import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tallybook.sources import manual, statements as st, tables
from tests.conftest import d, rows_of


# line, description of the transaction on it, amount on it
KINDS = [
    ("01/02/2001 02/02/2001 pane {i}", "pane {i}", None),
    ("01/02/2001 02/02/2001 latte {i},20-", "latte {i},20-", "{i},20-"),
    ("{i},10", None, "{i},10"),
    ("totale 1.0{i:02d},30", None, "1.0{i:02d},30"),
    ("saldo", None, None),
    ("via 3/4", None, None),
]


def random_statement(rng, n):
    """A statement, and the rows it stands for: an amount goes to the earliest transaction still without one."""
    lines, rows, waiting = [], [], deque()
    for _ in range(n):
        line, description, amount = (x and x.format(i=i) for i in [rng.randint(0, 89)] for x in rng.choice(KINDS))
        lines.append(line)
        if description:
            rows.append([len(rows) + 1, description, None])
            waiting.append(rows[-1])
        if amount and waiting:
            waiting.popleft()[2] = amount
    return "\n".join(lines), [tuple(r) for r in rows]


WRITTEN = [
    ("5,00\n01/02/2001 02/02/2001 pane\n6,00\n7,00", [(1, "pane", "6,00")]),
    ("01/02/2001 02/02/2001 a\n01/02/2001 02/02/2001 b\n1,00 2,00\n3,00-\n4,00", [(1, "a", "1,00"), (2, "b", "3,00-")]),
    ("01/02/2001 02/02/2001 a 1,00\n01/02/2001 02/02/2001 b\nsaldo", [(1, "a 1,00", "1,00"), (2, "b", None)]),
    ("saldo 1,00", []),
]


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_written_statements(spark, block):
    documents = spark.createDataFrame([(f"/in/owner_a/{i}.txt", text) for i, (text, _) in enumerate(WRITTEN)], "path string, text string")
    got = rows_of(st.pair_amounts(st.lines_of(documents, lines_per_block=block)), "path", "k", "description", "amount_text")
    for i, (_, rows) in enumerate(WRITTEN):
        assert sorted(r[1:] for r in got if r[0] == f"/in/owner_a/{i}.txt") == rows


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_pairing_gives_what_was_written_whatever_the_blocks(spark, block):
    rng = random.Random(block)
    known = {f"/in/owner_a/f{i}.txt": random_statement(rng, rng.randint(1, 60)) for i in range(25)}
    documents = spark.createDataFrame([(path, text) for path, (text, _) in known.items()], "path string, text string")
    got = st.pair_amounts(st.lines_of(documents, lines_per_block=block))
    by_path = {}
    for path, k, text, value in rows_of(got, "path", "k", "description", "amount_text"):
        by_path.setdefault(path, []).append((k, text, value))
    for path, (_, rows) in known.items():
        assert sorted(by_path.get(path, [])) == rows, path
    short = {path for path, (_, rows) in known.items() if any(value is None for _, _, value in rows)}
    assert {r["path"] for r in st.unpaired_files(got).collect()} == short


def test_a_file_in_many_splits_keeps_its_line_order(spark, tmp_path):
    folder = tmp_path / "owner_b"
    folder.mkdir()
    text, rows = random_statement(random.Random(5), 4000)
    (folder / "big.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = st.read_statement_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        got = st.pair_amounts(lines)
        assert sorted(rows_of(got, "k", "description", "amount_text")) == rows
        parsed = st.parse_card_text(lines)
        assert rows_of(parsed.select("owner", "source_file").distinct()) == [("owner_b", "big.txt")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_legacy_amounts_lose_their_thousands(spark):
    documents = spark.createDataFrame([("/a/b/c", "01/02/2001 02/02/2001 x\n1.234,56")], "path string, text string")
    lines = st.lines_of(documents)
    assert st.parse_card_text(lines).first()["amount"] == 1234.56
    assert st.parse_card_text(lines, legacy=True).first()["amount"] == 234.56


def test_card_and_bank_tables(spark, tmp_path):
    card, bank = tmp_path / "owner_a", tmp_path / "conto"
    card.mkdir(), bank.mkdir()
    (card / "c.csv").write_text(
        "Data Operazione,Data Registrazione,Descrizione Operazione,Importo (€)\n"
        "01/02/2001,03/02/2001,pane,1.5\n31/02/2001,03/02/2001,latte,2\n,,Totale,3.5\n"
    )
    (bank / "b.csv").write_text(
        "Data Contabile,Data Valuta,Causale / Descrizione,Importo,Canale,Divisa\n"
        "01/02/2001,03/02/2001,luce,-40.25,W,EUR\n01/02/2001,03/02/2001,stipendio,1000,W,EUR\n"
    )
    assert sorted(rows_of(st.load_card_table(spark, str(card))), key=str) == sorted(
        [(d("2001-02-01"), d("2001-02-03"), "pane", 1.5, "c.csv", "owner_a"), (None, d("2001-02-03"), "latte", 2.0, "c.csv", "owner_a")], key=str
    )
    assert rows_of(st.load_bank_table(spark, str(bank))) == [(d("2001-02-01"), d("2001-02-03"), "luce", 40.25, "b.csv", "conto")]


def test_bank_pages(spark):
    cells = [
        (1, 0, ["x", "", "", "", ""]), (1, 1, ["DATA", "VALUTA", "ENTRATE", "USCITE", "CAUSALE"]),
        (1, 2, ["01/03/22", "02/03/22", "", "- 5,00", "pane"]), (1, 3, ["01/03/22", "02/03/22", "", "", "vuoto"]),
        (1, 4, ["", "", "", "-", "bollo"]), (1, 5, ["01/03/22", "02/03/22", "", "7,00", "entrata"]),
        (1, 6, ["01/03/22", "02/03/22", "", "- 9,00", "CARTIMPRONTA 12"]),
        (2, 0, ["x"]), (2, 1, ["DATA", "ENTRATE"]), (2, 2, ["01/03/22", "8,00"]),
    ]
    frame = spark.createDataFrame([("f.pdf", "conto", *c) for c in cells], "file string, owner string, page int, row_no int, cells array<string>")
    got = sorted(rows_of(st.load_bank_pages(frame), "txn_date", "booking_date", "description", "amount"))
    assert got == [(d("2022-03-02"), d("2022-03-01"), "pane", 5.0), (d("2022-04-01"), d("2022-03-31"), "bollo", 3.6)]


def test_manual_entries_and_provenance(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"data_dict": {"txn_date": ["2001-02-01", "2001-02-02"],\n"booking_date": ["2001-02-01", "2001-02-02"], "description": ["a", "b"],'
        '"amount": [1, 2.5], "file": ["spesa individuale", "spesa condivisa"], "owner": ["owner_a", "owner_b"]}}'
    )
    documents = manual.read_manual_documents(spark, str(tmp_path / "m.json"), one_per_file=True)
    got = sorted(rows_of(manual.manual_entries(documents)))
    assert got[1] == (d("2001-02-02"), d("2001-02-02"), "b", 2.5, "spesa condivisa", "owner_b") and len(got) == 2
    frame = spark.createDataFrame([("file:/x/owner=owner_a/f.txt",)], "path string")
    assert rows_of(tables.add_provenance(frame, "path"), "owner", "source_file") == [("owner_a", "f.txt")]


def test_sinks_refuse_an_empty_ledger(raw, tmp_path, spark):
    for sink in (tables.sink_csv, tables.sink_parquet):
        with pytest.raises(tables.EmptyLedger):
            sink(raw([]), str(tmp_path / "out"))
    tables.sink_csv(raw([("2001-02-01", 'a "b", c', 1.5)]), str(tmp_path / "csv"))
    back = tables.scan_ledger_csv(spark, str(tmp_path / "csv"), raw([]).schema)
    assert back.first()["description"] == 'a "b", c'
    tables.sink_table(raw([("2001-02-01", "x", 1.5)]), "stored_test", text_dates=True)
    assert tables.scan_ledger_table(spark, "stored_test").first()["txn_date"] == "2001-02-01"
    spark.sql("drop table stored_test")


def test_json_records_keep_nulls_and_accents(spark):
    frame = spark.sql("select date'2001-02-03' as txn_date, 'caffè' as description, cast(null as string) as owner")
    assert tables.as_json_records(frame).first()[0] == '{"txn_date":"2001-02-03","description":"caffè","owner":null}'


def test_strict_dates(spark):
    frame = spark.createDataFrame([(1, "2001-02-01"), (2, "2001-02-30")], "k int, day string")
    assert rows_of(tables.type_dates(frame, ["day"]).orderBy("k"), "day") == [(d("2001-02-01"),), (None,)]
    assert rows_of(tables.date_violations(frame, ["day"], ["k"])) == [(2, "day", "2001-02-30")]
    with pytest.raises(Exception):
        tables.type_dates(frame, ["day"], strict=True).collect()


def test_lines_are_moved_once_for_totals_and_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(["01/02/2024 02/02/2024 uno 1,00", "01/02/2024 02/02/2024 due", "2,00-", "saldo 9,00"] * 50))
    paired = st.pair_amounts(st.read_statement_lines(spark, str(tmp_path)))
    assert sorted(rows_of(paired, "k", "amount_text"))[:3] == [(1, "1,00"), (2, "2,00-"), (3, "1,00")]
    paired.collect()
    assert "ReusedExchange" in paired._jdf.queryExecution().executedPlan().toString()
