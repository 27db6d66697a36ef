import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallybook.operators.rule_changes import rename_rules
from tallybook.schema import RAW_LEDGER
from tallybook.sources import manual, rule_store, statements
from tallybook.sources import tables as tb
from tests.conftest import rows_of


def ledgers(spark, tmp_path):
    """Each kind of sink with the scan that reads it back."""
    p = str(tmp_path / "ledger")
    return {
        "parquet": (lambda f: tb.sink_parquet(f, p), lambda: spark.read.parquet(p)),
        "csv": (lambda f: tb.sink_csv(f, p + "_csv"), lambda: spark.read.csv(p + "_csv", header=True, schema="id bigint, a double")),
        "table": (lambda f: tb.sink_table(f, "sink_test"), lambda: spark.table("sink_test")),
    }


@pytest.mark.parametrize("kind", ["parquet", "csv", "table"])
def test_a_ledger_is_updated_in_place_and_survives_a_failed_write(spark, tmp_path, kind):
    write, read = ledgers(spark, tmp_path)[kind]
    frame = spark.range(3).withColumn("a", F.lit(1.5))
    spark.sql("DROP TABLE IF EXISTS sink_test")
    write(frame)
    write(read().unionByName(frame.withColumn("id", F.col("id") + 10)))
    ids = [0, 1, 2, 10, 11, 12]
    assert sorted(r[0] for r in rows_of(read(), "id")) == ids
    with pytest.raises(Exception, match="broken"):
        write(read().withColumn("a", F.raise_error(F.lit("broken")).cast("double")))
    with pytest.raises(tb.EmptyLedger):
        write(read().filter("id < 0"))
    assert sorted(r[0] for r in rows_of(read(), "id")) == ids
    assert not [f for f in tmp_path.iterdir() if ".staged" in f.name or ".old" in f.name]
    spark.sql("DROP TABLE IF EXISTS sink_test")


def test_unreadable_bank_amounts_are_kept_or_fail(spark, tmp_path):
    folder = tmp_path / "conto"
    folder.mkdir()
    head = "Data Contabile,Data Valuta,Causale / Descrizione,Importo,Canale,Divisa\n"
    (folder / "b.csv").write_text(head + '01/02/2001,01/02/2001,luce,"-1.234,56",x,EUR\n01/02/2001,01/02/2001,gas,n.d.,x,EUR\n01/02/2001,01/02/2001,paga,"10,0",x,EUR\n01/02/2001,,acqua,-1.234,x,EUR\n')
    got = {(r[0], r[1]) for r in rows_of(statements.load_bank_table(spark, str(folder), comma=True), "description", "amount")}
    assert got == {("luce", 1234.56), ("gas", None), ("acqua", 1234.0)}
    bad = statements.bank_violations(spark, str(folder), comma=True)
    assert sorted(rows_of(bad), key=str) == [("b.csv", "conto", "amount", "n.d.", "unreadable"), ("b.csv", "conto", "booking_date", None, "missing")]
    plain = {(r[0], r[1]) for r in rows_of(statements.load_bank_table(spark, str(folder)), "description", "amount")}
    assert plain == {("luce", 1234.56), ("gas", None), ("acqua", 1.234)}
    with pytest.raises(Exception, match="cannot read: amount unreadable n.d."):
        statements.load_bank_table(spark, str(folder), strict=True, comma=True).collect()


def test_card_tables_report_what_they_cannot_read(spark, tmp_path):
    folder = tmp_path / "owner_a"
    folder.mkdir()
    (folder / "c.csv").write_text(
        "Data Operazione,Data Registrazione,Descrizione Operazione,Importo (€),Nota\n"
        '01/02/2001,03/02/2001,pane,1.5,x\n01/02/2001,03/02/2001,senza nota,1.5,\n31/02/2001,03/02/2001,latte,2;00,x\n,,Totale,3.5,x\n'
    )
    counted = Observation("card")
    got = statements.load_card_table(spark, str(folder), observation=counted)
    assert sorted(rows_of(got, "description", "amount"), key=str) == [("latte", None), ("pane", 1.5)]
    assert counted.get["rows"] == 2 and counted.get["bad_rows"] == 1 and counted.get["bad_amount"] == counted.get["bad_txn_date"] == 1
    found = sorted(rows_of(statements.card_violations(spark, str(folder)), "column", "value", "problem"))
    assert found == [("amount", "2;00", "unreadable"), ("txn_date", "31/02/2001", "unreadable")]
    with pytest.raises(Exception, match="cannot read"):
        statements.load_card_table(spark, str(folder), strict=True).count()


def test_page_rows_without_a_last_cell_stay(spark):
    cells = [(1, 1, ["DATA", "VALUTA", "NOTE", "USCITE", "CAUSALE"]), (1, 2, ["01/03/22", "02/03/22", "", "- 5,00", None]), (1, 3, ["41/03/22", "02/03/22", "", "boh", "x"])]
    frame = spark.createDataFrame([("f.pdf", "conto", *c) for c in cells], "file string, owner string, page int, row_no int, cells array<string>")
    assert sorted(rows_of(statements.load_bank_pages(frame), "description", "amount"), key=str) == [("x", None), (None, 5.0)]
    assert sorted(rows_of(statements.page_violations(frame), "row_no", "column", "value")) == [(3, "amount", "boh"), (3, "booking_date", "41/03/22")]
    with pytest.raises(Exception, match="cannot read"):
        statements.load_bank_pages(frame, strict=True).collect()


def test_csv_scan_reports_values_and_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "txn_date,booking_date,description,amount,source_file,owner\n2001-02-01,2001-02-01,a,1.5,f,o\n2001-02-30,,b,x,f,o\n2001-02-03,2001-02-03,c\n2001-02-04,2001-02-04,d,2,f,o,more\n"
    )
    counted = Observation("csv")
    rows = tb.scan_ledger_csv(spark, str(tmp_path), RAW_LEDGER, observation=counted)
    assert sorted(rows_of(rows, "description", "amount"), key=str) == [("a", 1.5), ("b", None), ("c", None), ("d", 2.0)]
    assert (counted.get["rows"], counted.get["bad_rows"], counted.get["bad_lines"]) == (4, 3, 2)
    found = sorted(rows_of(tb.csv_violations(spark, str(tmp_path), RAW_LEDGER, ["description"])), key=str)
    assert found == [("b", "amount", "x", "unreadable"), ("b", "txn_date", "2001-02-30", "unreadable"), ("c", None, "2001-02-03,2001-02-03,c", "malformed line"), ("d", None, "2001-02-04,2001-02-04,d,2,f,o,more", "malformed line")]
    with pytest.raises(Exception, match="cannot read"):
        tb.scan_ledger_csv(spark, str(tmp_path), RAW_LEDGER, strict=True).collect()
    plan = tb.scan_ledger_csv(spark, str(tmp_path), RAW_LEDGER).select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<amount:string>" in plan


def test_unusable_manual_documents_are_listed(spark, tmp_path):
    full = '"txn_date":["2001-01-01"],"booking_date":["2001-01-01"],"description":["a"],"file":["f"],"owner":["o"]'
    lines = ['{"data_dict":{%s,"amount":[1.0]}}' % full, '{"data_dict":{%s}}' % full, '{"other":1}', '{bad', '{"data_dict":{%s,"amount":[1.0,2.0]}}' % full]
    (tmp_path / "m.json").write_text("\n".join(lines))
    documents = manual.read_manual_documents(spark, str(tmp_path / "m.json"))
    assert manual.manual_violations(documents).count() == 4
    with pytest.raises(Exception, match="lacks an array"):
        manual.manual_entries(documents, strict=True).collect()


def test_rules_without_an_order_fail_the_scan(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"name":"A","classification":"casa","descriptions":["a"]}')
    with pytest.raises(Exception, match="rule without rule_ord"):
        rule_store.scan_rules(spark, str(tmp_path)).collect()
    assert rule_store.invalid_rules(rule_store.scan_rules(spark, str(tmp_path), strict=False)).count() == 1


def test_the_first_of_two_renames_counts(spark, rules):
    renames = spark.createDataFrame([(1, "A", "Z"), (2, "A", "B")], "seq long, name string, new_name string")
    assert rows_of(rename_rules(rules([("A", "casa", ["a"])]), renames), "name") == [("Z",)]


def test_lines_with_other_blanks_are_read(spark):
    lines = spark.createDataFrame([("o/f.txt", "01/02/2001\u00a001/02/2001\u00a0bar\n3,50")], "path string, text string")
    got = rows_of(statements.parse_card_text(statements.lines_of(lines)), "description", "amount")
    assert got == [("bar", 3.5)]


def test_card_amounts_with_a_decimal_comma_are_read(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Data Operazione,Data Registrazione,Descrizione Operazione,Importo (€)\n01/02/2001,02/02/2001,bar,"12,50"\n')
    assert rows_of(statements.load_card_table(spark, str(tmp_path)), "description", "amount") == [("bar", 12.5)]
