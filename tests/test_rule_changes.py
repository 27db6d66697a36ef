import random
import time
from collections import Counter

import pytest

from tallybook.operators import rule_changes as C
from tallybook.session import small_table
from tests.conftest import rows_of

FIELDS = [f.name for f in C.CHANGES.fields]


def change_set(spark, changes):
    return small_table(spark, [tuple(c.get(f) for f in FIELDS) for c in changes], C.CHANGES)


def replay(rules, changes):
    """The change-set one by one."""
    table = {name: dict(cls=cls, terms=list(terms), essential=0) for name, cls, terms in rules}
    for c in sorted(changes, key=lambda c: c["seq"]):
        name, op = c["name"], c["op"]
        if op == "insert":
            table.setdefault(name, dict(cls=c["classification"], terms=list(c.get("descriptions") or []), essential=0))
        elif name in table and op == "remove":
            del table[name]
        elif name in table and op == "update":
            row = table[name]
            row["cls"] = c.get("classification") or row["cls"]
            row["essential"] = row["essential"] if c.get("essential") is None else c["essential"]
            row["terms"] = list(c["descriptions"]) if c.get("descriptions") is not None else row["terms"]
        elif name in table and op == "add_term":
            table[name]["terms"].append(c["term"])
        elif name in table and op == "remove_term" and c["term"] in table[name]["terms"]:
            table[name]["terms"].remove(c["term"])
    return sorted((n, r["cls"], r["terms"], r["essential"]) for n, r in table.items())


def random_changes(rng, n):
    out = []
    for seq in range(n):
        op = rng.choices(C.OPS, [2, 3, 6, 6, 1])[0]
        c = {"seq": seq, "op": op, "name": rng.choice("ABCD")}
        if op == "insert":
            c |= {"classification": rng.choice(["casa", "auto"]), "descriptions": rng.choice([None, ["x"], ["x", "y", "x"]])}
        elif op == "update":
            c |= rng.choice([{"classification": "spesa"}, {"essential": rng.randint(0, 3)}, {"descriptions": ["y", "y"]}])
        elif op != "remove":
            c["term"] = rng.choice("xyz")
        out.append(c)
    return out


def test_change_sets_equal_a_replay(spark, rules, monkeypatch):
    monkeypatch.setattr(C, "SEQ_BLOCK", 4)
    base = [("A", "casa", ["x", "y", "x"]), ("B", "auto", []), ("E", "spesa", ["z"])]
    for seed in range(4):
        changes = random_changes(random.Random(seed), 60)
        got = C.apply_rule_changes(rules(base), change_set(spark, changes))
        assert sorted(rows_of(got, "name", "classification", "descriptions", "essential")) == replay(base, changes), seed


def test_single_operations(spark, rules):
    table = rules([("A", "casa", ["x", "y", "x"]), ("B", "auto", [], True), ("cartimpronta", "auto", [], True)])
    new = spark.sql("select 1L as seq, 'A' as name, 'spesa' as classification union all select 2L, 'N', 'spesa' union all select 3L, 'N', 'auto'")
    assert sorted(rows_of(C.insert_rules(table, new), "name", "classification"))[2:] == [("N", "spesa"), ("cartimpronta", "auto")]
    assert sorted(rows_of(C.rejected_inserts(table, new))) == [(1, "A"), (3, "N")]
    removals = spark.sql("select * from values ('A', 'x'), ('A', 'z'), ('A', 'y'), ('A', 'y') as t(name, term)")
    assert rows_of(C.remove_terms(table, removals).filter("name = 'A'"), "descriptions") == [(["x"],)]
    assert sorted(rows_of(C.missing_terms(table, removals))) == [("A", "y", 2, 1), ("A", "z", 1, 0)]
    adds = spark.sql("select * from values (2L, 'A', 'q'), (1L, 'A', 'x'), (3L, 'ZZ', 'q') as t(seq, name, term)")
    assert rows_of(C.add_terms(table, adds).filter("name = 'A'"), "descriptions") == [(["x", "y", "x", "x", "q"],)]
    renames = spark.sql("select 'A' as name, 'B' as new_name")
    assert rows_of(C.rename_clashes(table, renames)) == [("B", 2)]
    assert rows_of(C.clear_exceptions(table).orderBy("name"), "name") == [("A",), ("cartimpronta",)]
    assert rows_of(C.remove_rules(table, renames), "name") == [("B",), ("cartimpronta",)]


def test_violations_of_a_change_set(spark, rules):
    changes = change_set(spark, [
        {"seq": 1, "op": "rename", "name": "A", "new_name": "Z"}, {"seq": 2, "op": "add_term", "name": "Z", "term": "x"},
        {"seq": 3, "op": "rename", "name": "B", "new_name": "C"}, {"seq": 4, "op": "rename", "name": "B", "new_name": "D"}, {"seq": 5, "op": "boh", "name": "Q"},
    ])
    got = {(n, p) for _, n, p in rows_of(C.change_violations(rules([("A", "casa", []), ("A", "auto", [])]), changes))}
    assert got == {("Z", "renamed and changed later"), ("B", "renamed twice"), ("Q", "unknown operation"), ("A", "name used by several rules")}


def rename_one_by_one(names, renames):
    held = list(names)
    for _, old, new in sorted(renames):
        held = [new if n == old else n for n in held]
    return sorted(held)


def test_renames_follow_each_other(spark, rules):
    rng = random.Random(2)
    for _ in range(4):
        steps = [(seq, rng.choice("ABCDEF"), rng.choice("ABCDEF")) for seq in range(rng.randint(0, 14))]
        table = rules([(n, "casa", []) for n in "ABCDEF"])
        frame = spark.createDataFrame(steps, "seq long, name string, new_name string")
        assert sorted(r[0] for r in rows_of(C.rename_rules(table, frame), "name")) == rename_one_by_one("ABCDEF", steps), steps


def test_a_long_chain_of_renames_takes_few_rounds(spark, rules, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "staged", lambda f, n, staged=C.staged: rounds.append(n) or staged(f, n))
    chain = spark.range(300).selectExpr("id as seq", "concat('n', id) as name", "concat('n', id + 1) as new_name")
    assert rows_of(C.rename_rules(rules([("n0", "casa", []), ("n299", "auto", []), ("x", "auto", [])]), chain).orderBy("rule_ord"), "name") == [("n300",), ("n300",), ("x",)]
    assert len(rounds) <= 11


def test_refused_sets_raise(spark, rules):
    table = rules([("A", "casa", ["x"])])
    late = change_set(spark, [{"seq": 1, "op": "rename", "name": "A", "new_name": "Z"}, {"seq": 2, "op": "add_term", "name": "Z", "term": "y"}])
    with pytest.raises(C.ChangesRefused, match="renamed and changed later"):
        C.apply_rule_changes(table, late, strict=True)
    fine = change_set(spark, [{"seq": 1, "op": "add_term", "name": "A", "term": "y"}, {"seq": 2, "op": "rename", "name": "A", "new_name": "Z"}])
    assert rows_of(C.apply_rule_changes(table, fine, strict=True), "name", "descriptions") == [("Z", ["x", "y"])]


def test_a_rule_with_very_many_terms(spark, rules):
    terms = [f"t{i % 9000}" for i in range(16_000)]
    table = rules([("A", "casa", terms), ("B", "auto", ["t1", "t1"])])
    removals = spark.range(16_000).selectExpr("'A' as name", "concat('t', id % 8000) as term")
    began = time.time()
    got = dict(rows_of(C.remove_terms(table, removals), "name", "descriptions"))
    took = time.time() - began
    left, gone = [], Counter(f"t{i % 8000}" for i in range(16_000))
    for t in terms:
        if gone[t]:
            gone[t] -= 1
        else:
            left.append(t)
    assert got == {"A": left, "B": ["t1", "t1"]}
    changes = change_set(spark, [{"seq": i, "op": "remove_term", "name": "A", "term": t} for i, t in enumerate(terms)] + [{"seq": 99_999, "op": "add_term", "name": "A", "term": "new"}])
    assert dict(rows_of(C.apply_rule_changes(table, changes), "name", "descriptions")) == {"A": ["new"], "B": ["t1", "t1"]}
    assert took < 20


def test_jumps_carry_no_names(spark, monkeypatch):
    from tallybook.operators import rule_changes

    kept, stage = [], rule_changes.staged
    monkeypatch.setattr(rule_changes, "staged", lambda frame, name: kept.append(dict(frame.dtypes)) or stage(frame, name))
    chain = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}") for i in range(20)] + [(30, "x", "y")], "seq long, name string, new_name string")
    got = {r.name: r.new_name for r in rule_changes.resolve_renames(chain).collect()}
    assert got == {f"n{i}": "n20" for i in range(20)} | {"x": "y"}
    assert len(kept) > 2 and all("string" not in types.values() for types in kept[1:])
