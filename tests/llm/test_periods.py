"""Periodic runs against plain search."""

import hashlib
import random

import numpy as np
import pytest

from tallybook.llm import periods, queries


def plain_runs(words, min_exponent=4, min_length=6):
    """Every stretch of every period that no neighbour extends, with its smallest period only."""
    n, found = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(min_length, min_exponent * p):
                found.setdefault((i, length), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "a", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, part = rng.randint(0, len(words)), [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            words[at:at] = part * rng.randint(2, 7) + part[: rng.randint(0, len(part))]
        ids = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, np.int64)
        for exponent, length in ((4, 6), (2, 2), (3, 10), (2, 1)):
            assert periods.find_runs(ids, exponent, length) == plain_runs(words, exponent, max(length, 2)), (words, exponent, length)


def test_shared_lengths_are_those_of_the_suffixes():
    rng = random.Random(1)
    ids = np.array([rng.randint(0, 1) for _ in range(200)])
    levels = periods.rank_levels(ids)
    left, right = np.array([rng.randint(0, 199) for _ in range(300)]), np.array([rng.randint(0, 199) for _ in range(300)])
    other = left != right
    got = periods.common_lengths(levels, left[other], right[other])
    for i, j, shared in zip(left[other], right[other], got):
        k = 0
        while i + k < 200 and j + k < 200 and ids[i + k] == ids[j + k]:
            k += 1
        assert k == shared
    order = np.argsort(levels[-1])
    assert [ids[i:].tolist() for i in order] == sorted(ids[i:].tolist() for i in range(200))


def test_classes_report_new_neighbours_only():
    classes, held = periods.Classes(), {i: {i} for i in range(30)}
    rng = random.Random(4)
    while len(held) > 1:
        a, b = rng.sample(sorted(held), 2)
        whole = sorted(held[a] | held[b])
        want = {(x, y) for x, y in zip(whole, whole[1:]) if (x in held[a]) != (y in held[a])}
        assert set(classes.unite(rng.choice(sorted(held[a])), rng.choice(sorted(held[b])))) == want
        held[a] = held.pop(a) | held.pop(b)


def test_screen_leaves_no_repeat_out():
    rng = random.Random(2)
    ids = [np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 12))], np.int64) for _ in range(300)]
    holds = [len(grams := [tuple(x[i : i + 5]) for i in range(len(x) - 4)]) > len(set(grams)) for x in ids]
    assert periods.repeating(ids, 5).tolist() == holds
    assert periods.repeating([], 5).tolist() == []


def test_long_texts_take_near_linear_time():
    rng = random.Random(0)
    n = 200_000
    for words in (np.zeros(n, np.int64), np.arange(n) % 3, np.arange(n) % 30_000):
        q = len(set(words.tolist()))
        assert periods.find_runs(words) == [(0, n, q)]
    assert periods.find_runs(np.array([rng.randint(0, 1) for _ in range(n // 4)]))


def contract(rows):
    import zlib

    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        out.append((doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_plain_search(spark, corpus, tmp_path):
    rows = [(r[0], r[1]) for r in corpus if r[1] is None or len(r[1]) < 6000]
    rows += [(i, "x y " * 9 + f"end {i}") for i in range(200, 260)] + [(None, "z " * 8), (300, " a b " * 7 + " c"), (301, "")]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, periodic string, runs int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == contract(rows)
    assert sum(r[1] > 0 for r in contract(rows)) > 60


def test_operator_keeps_rows_and_columns(spark, docs, corpus, no_docs):
    found = periods.periodic_runs(docs, min_exponent=2, min_length=4)
    assert found.columns == [*docs.columns, "periodic"] and found.count() == len(corpus)
    assert periods.periodic_runs(no_docs).count() == 0 and periods.run_digests(periods.periodic_runs(no_docs)).count() == 0
    clash = docs.withColumn("periodic", docs.kind)
    one = {r.doc_id: r.periodic for r in periods.periodic_runs(clash).filter("doc_id in (62, 63, 67)").collect()}
    assert one[62].runs == [] and bytes(one[63].collapsed) == b"" and bytes(one[67].collapsed) == b"x" * 5000
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, min_exponent=1)
