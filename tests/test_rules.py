import random
import re
from collections import Counter

import pytest

from tallybook import session
from tallybook.operators import filters, rules as R
from tallybook.plans.load import LedgerError, load_from_statements, load_ledger
from tallybook.sources import rule_store
from tests.conftest import rows_of


def test_standardize_keeps_unmatched_and_is_case_sensitive(raw, rules):
    led = raw([("2001-01-01", t, 1) for t in ("COOP 12", "coop", "x", "a.b", "axb", "")])
    table = rules([("Coop", "spesa", ["COOP"]), ("Dot", "spesa", ["a.b"]), ("Empty", "spesa", [""])])
    got = dict(rows_of(R.standardize(led, table), "description", "std_description"))
    assert got == {"COOP 12": "Coop", "coop": "coop", "x": "x", "a.b": "Dot", "axb": "axb", "": ""}


def test_terms_match_like_plain_containment(spark, rules):
    rng = random.Random(1)
    alphabet = "ab \\E.è"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, n)))
    terms = sorted({word(7) for _ in range(40)})
    texts = sorted({word(14) for _ in range(80)})
    table = rules([(f"n{i}", "spesa", [t]) for i, t in enumerate(terms)])
    frame = spark.createDataFrame([(t,) for t in texts], "description string")
    got = set(rows_of(R.match_terms(frame, R.rule_terms(table)), "description", "term"))
    assert got == {(x, t) for x in texts for t in terms if t in x}


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_terms_with_one_beginning_meet_few_texts(spark, n):
    texts = spark.range(n).selectExpr("concat('old red rod sku ', id, ' shop') as description")
    terms = spark.range(n).selectExpr("concat('old red rod sku ', id) as term", "concat('n', id) as name")
    anchors = R.term_anchors(terms)
    assert anchors.count() == n
    tried = R.candidates(texts, anchors).count()
    found = R.match_terms(texts, terms)
    # a text holds the terms of its own number and of its beginnings
    want = sum(len(str(i)) for i in range(n))
    assert found.count() == want and want <= tried <= 2 * want


def test_anchors_are_the_rarest_grams_and_long_where_they_can_be(spark):
    terms = spark.createDataFrame([(t,) for t in ("abcd1", "abcd2", "x", "xyz", "", "abcdefgh", "0123456789abcdefg", "0123456789abcdefg")], "term string")
    got = dict(rows_of(R.term_anchors(terms)))
    assert got == {"abcd1": "bcd1", "abcd2": "bcd2", "x": "x", "xyz": "xy", "abcdefgh": "abcdefgh", "0123456789abcdefg": "0123456789abcdef"}


def test_one_term_of_many_rules(raw, rules):
    led = raw([("2001-01-01", "a coop b", 1)])
    table = rules([(f"n{i:04d}", "spesa", ["coop", "coop"]) for i in range(1500)])
    assert rows_of(R.standardize(led, table), "std_description") == [("n0000",)]
    assert [len(names) for _, names in rows_of(R.rule_conflicts(led, table))] == [1500]


def test_no_terms_at_all(raw, rules):
    led = raw([("2001-01-01", "x", 1)])
    assert rows_of(R.standardize(led, rules([("n", "spesa", [])])), "std_description") == [("x",)]


def test_conflict_needs_different_names(raw, rules):
    led = raw([("2001-01-01", t, 1) for t in ("cold old", "cold")])
    table = rules([("A", "spesa", ["old", "cold"]), ("B", "casa", [" old"])])
    assert rows_of(R.rule_conflicts(led, table)) == [("cold old", ["A", "B"])]


def test_class_first_wins_flags_last_win(raw, rules):
    table = rules([
        ("X", "casa", ["x"], False, False, 1, 0, 0), ("Y", "auto", ["y"]), ("X", "auto", ["zz"], True, True, 0, 1, 1),
    ])
    row = rows_of(R.tag_ledger(raw([("2001-01-01", "x", 1)]), table), "classification", "channel", "update_exception", "essential", "recurrent", "product")
    assert row == [("casa", "online", True, 0, 1, 1)]


def test_tagging_in_one_join_equals_the_steps(raw, rules):
    led = raw([("2001-01-01", t, i) for i, t in enumerate(["anvil big", "bolt", "other", "bolt", "ROD"])])
    table = rules([("ANVIL", "casa", ["anvil"], False, True, 1, 1, 1), ("BOLT", "auto", ["bolt"]), ("ROD", "utenze", [])])
    steps = R.tag_attributes(R.classify(R.standardize(led, table), table), table)
    one = R.tag_ledger(led, table)
    assert sorted(rows_of(one), key=str) == sorted(rows_of(steps, *one.columns), key=str)
    assert rows_of(R.unclassified(one, table), "description") == [("other",)]


def test_null_descriptions_stay(spark, raw, rules):
    led = raw([("2001-01-01", "x", 1)]).selectExpr("txn_date", "booking_date", "cast(null as string) as description", "amount", "source_file", "owner")
    assert rows_of(R.tag_ledger(led, rules([("A", "casa", ["x"])])), "std_description", "channel") == [(None, "negozio")]


def test_overlaps_equal_a_regex_loop(rules):
    rng = random.Random(3)
    words = ["rod", "blue rod", "rod-x", "rods", "caffè", "caffè rod", "rod\\Ea", "\\Ea", "a b", "a", "", " rod ", "b a b", "è"]
    table = [(f"n{i}", "spesa", rng.sample(words, 4)) for i in range(8)]
    entries = [(i, p, name, t.strip()) for i, (name, _, terms) in enumerate(table) for p, t in enumerate(terms) if t]
    want = sorted(
        (a[3], a[2], b[3], b[2]) for a in entries for b in entries
        if a[:2] != b[:2] and re.search(r"(^|\W)" + re.escape(a[3]) + r"(\W|$)", b[3])
    )
    got = R.rule_overlaps(rules(table))
    assert sorted(rows_of(got, "term", "entity", "matches_with", "other_entity")) == want and want


def test_rule_listing_and_filters(rules):
    table = rules([("B", "auto", ["b1", "", "b2"]), ("A", "casa", []), ("C", "auto", ["c"], True)])
    assert rows_of(R.rule_counts(table)) == [("auto", 2), ("casa", 1)]
    assert sorted(rows_of(R.rule_terms(table), "name", "term")) == [("B", "b1"), ("B", "b2"), ("C", "c")]
    assert sorted(rows_of(R.rule_names_by_class(table), "class_ord", "classification", "name")) == [(1, "auto", "B"), (1, "auto", "C"), (2, "casa", "A")]
    assert rows_of(filters.rules_by_flag(table, True), "name") == [("C",)]
    assert rows_of(filters.search_rules(table, "b"), "name") == [("B",)]


def test_strict_load_raises_and_plain_load_keeps_rows(raw, rules):
    led = raw([("2001-01-01", "x", 1), ("2001-01-02", "x", 1), ("2001-01-02", "x", 1, "f2")])
    table = rules([("X", "casa", ["x"])])
    assert load_ledger(led, rules=table).count() == 3
    with pytest.raises(LedgerError, match="duplicates"):
        load_ledger(led, rules=table, strict=True)
    assert load_ledger(led, rules=table, strict=True, de_duplicate=True, ordered=True).count() == 3
    with pytest.raises(LedgerError, match="unclassified"):
        load_ledger(led, rules=rules([("Y", "casa", ["y"])]), strict=True)
    with pytest.raises(LedgerError, match="conflicts"):
        load_ledger(led, rules=rules([("X", "casa", ["x"]), ("Y", "casa", ["x"])]), strict=True)


def test_load_filters_history_only_and_drops_exceptions(raw, rules):
    history = raw([("2001-01-01", "x", 1, "spesa individuale"), ("2001-01-02", "x", 2)])
    new = raw([("2001-01-03", "x", 3, "spesa individuale"), ("2001-01-03", "cartimpronta", 3)])
    table = rules([("X", "casa", ["x"]), ("CARTA", "casa", ["cartimpronta"], True)])
    assert sorted(rows_of(load_ledger(history, new, rules=table, include_personal=False), "amount")) == [(2.0,), (3.0,)]


def test_rules_keep_document_order_over_files_and_splits(spark, tmp_path):
    names = []
    for f, n in (("b.json", 700), ("a.json", 900), ("c.json", 1), ("empty.json", 0)):
        (tmp_path / f).write_text("".join('{"name": "%s%04d", "classification": "casa", "descriptions": ["x%d"]}\n%s' % (f, i, i, "\n" * (i % 3 == 0)) for i in range(n)))
        names += [(f, i) for i in range(n)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = rule_store.scan_rules_ordered(spark, str(tmp_path))
        assert rows_of(got.orderBy("rule_ord"), "rule_ord", "name") == [(k, f"{f}{i:04d}") for k, (f, i) in enumerate(sorted(names), start=1)]
        assert got.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rules_of_a_document_store_keep_its_order(spark, tmp_path):
    (tmp_path / "db.json").write_text(
        '{"_default": {}, "standardized_descriptions": {"10": {"name": "B", "classification": "casa", "descriptions": ["b"], "web": true},\n"2": {"name": "A", "classification": "auto"}}}'
    )
    got = rule_store.scan_rules_document(spark, str(tmp_path / "db.json"))
    assert rows_of(got.orderBy("rule_ord"), "rule_ord", "name", "descriptions", "web", "essential") == [(1, "B", ["b"], True, 0), (2, "A", [], False, 0)]


def test_overlaps_of_equal_and_of_very_long_terms(rules, spark):
    many = rules([(f"n{i}", "spesa", ["coop", f"sku {i}"]) for i in range(10_000)])
    found = {(t, m): (n, o, p) for t, m, n, o, p in rows_of(R.overlap_classes(many))}
    assert found == {("coop", "coop"): (10_000, 10_000, 10_000 * 9_999)}
    long = " ".join(f"w{i}" for i in range(2_000))
    table = rules([("L", "spesa", [long]), ("A", "casa", ["w7", "w1999", "w5 w6", "w19", "w6 w5", "5"])])
    assert sorted(rows_of(R.rule_overlaps(table), "term", "other_entity")) == [("w19", "L"), ("w1999", "L"), ("w5 w6", "L"), ("w7", "L")]


def test_overlap_counts_are_those_of_the_pairs(rules):
    rng = random.Random(8)
    words = ["rod", "blue rod", "rod-x", "caffè", "caffè rod", "-", "--", "a - b", "a", " rod ", "è", "x", "x-"]
    table = rules([(f"n{i}", "spesa", rng.sample(words, 4)) for i in range(9)])
    pairs = Counter(rows_of(R.rule_overlaps(table), "term", "matches_with"))
    assert {(t, m): n for t, m, n in rows_of(R.overlap_classes(table), "term", "matches_with", "n_pairs")} == pairs and pairs


def test_load_from_statement_folders(spark, raw, rules, tmp_path):
    card, bank = tmp_path / "card" / "owner_a", tmp_path / "bank" / "conto"
    card.mkdir(parents=True), bank.mkdir(parents=True)
    (card / "due.txt").write_text("05/03/2025 05/03/2025 pane\n80,00\n04/03/2025 05/03/2025 latte\n1,00\n")
    (card / "small.txt").write_text("05/03/2025 05/03/2025 pane\n7,00\n")
    (bank / "b.csv").write_text("Data Contabile,Data Valuta,Causale / Descrizione,Importo,Canale,Divisa\n05/03/2025,05/03/2025,luce,-100,W,EUR\n")
    history = raw([("2025-01-01", "pane", 1, "spesa individuale"), ("2025-01-01", "pane", 2)])
    sources = {"card_text": str(tmp_path / "card"), "bank_csv": str(tmp_path / "bank")}
    table = rules([("PANE", "spesa", ["pane"]), ("LUCE", "casa", ["luce"], True)])
    got = load_from_statements(spark, sources, table, history, include_personal=False)
    assert sorted(rows_of(got, "std_description", "amount", "source_file")) == [
        ("PANE", 2.0, "f1"), ("PANE", 7.0, "small.txt"), ("PANE", 80.0, "due.txt"), ("imposta di bollo", 2.0, "due.txt"), ("latte", 1.0, "due.txt"),
    ]
    assert load_from_statements(spark, sources, table, fees={"after": "2025-04-01"}).count() == 3
    with pytest.raises(ValueError, match="unknown kind"):
        load_from_statements(spark, {"pdf": "x"}, table)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("overlaps", [R.overlap_classes, R.rule_overlaps])
def test_overlaps_gather_no_terms_on_the_driver(spark, tmp_path, overlaps):
    """The file is small, its terms by word may not be: the planner's guess must not make it broadcast them."""
    rows = spark.range(50).selectExpr(
        "cast(id as int) as rule_ord", "concat('N', id) as name", "'spesa' as classification", "array(concat('old rod sku ', id), concat('sku ', id)) as descriptions"
    )
    rows.write.parquet(str(tmp_path / "rules"))
    found = overlaps(spark.read.parquet(str(tmp_path / "rules")))
    assert "Broadcast" not in plan_of(found)
    # Each "sku" term occurs in its own long one.
    assert found.count() == 50


def test_terms_are_broadcast_only_if_counted_to_be_few(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("concat('old rod sku ', id) as term", "concat('n', id) as name").write.parquet(str(tmp_path / "terms"))
    spark.range(300).selectExpr("concat('old rod sku ', id, ' shop') as description").write.parquet(str(tmp_path / "texts"))
    terms, texts = (spark.read.parquet(str(tmp_path / n)) for n in ("terms", "texts"))
    assert "Broadcast" not in plan_of(R.term_anchors(terms))
    few = R.match_terms(texts, terms)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    many = R.match_terms(texts, terms)
    assert "BroadcastHashJoin" in plan_of(few) and "Broadcast" not in plan_of(many)
    assert sorted(rows_of(few)) == sorted(rows_of(many))
    # a text holds the terms of its own number and of its beginnings
    assert many.count() == sum(len(str(i)) for i in range(300))
