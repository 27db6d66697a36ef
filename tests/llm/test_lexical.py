"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain(items, docs, k=20):
    held = [(i, d, Counter(terms(t))) for i, (d, t) in enumerate(docs)]
    held = [x for x in held if x[2]]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, _, c in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, i))
        out += [(item, r + 1, None if missing else d, -s) for r, (s, missing, d, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    names = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(names, weights, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(900 + i, "w1 w2, W3! w1") for i in range(30)] + [(900, "w1 w2, W3! w1")] * 2
    docs += [(1000, None), (1001, ""), (1002, "\x00 .,;"), (None, "w1 w2 w59"), (1003, "É é é w7 İx"), (1004, "w5 " * 3000)]
    items = [(i, " ".join(rng.choices(names, k=rng.randint(1, 15)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w1 w1 W2"), (104, "É İX é é"), (None, "w59"), (103, "w1 w1 W2"), (105, "w0"), (106, "w5")]
    return items, docs


@pytest.mark.parametrize("each, query_rows", [(10**6, 10**6), (60, 10**6), (25, 20)])
def test_search_equals_scoring_everything(spark, corpus, monkeypatch, each, query_rows):
    items, docs = corpus
    monkeypatch.setattr(lexical, "FAN", 3)
    asked = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, term string")
    held = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, block int, shard int")
    got = lexical.search(asked, held, each=each, query_rows=query_rows)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(items, docs)


def test_empty_tables(spark, corpus):
    items, docs = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    held = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical.search(asked.limit(0), held).count() == 0
    assert lexical.search(asked, held.limit(0)).count() == 0
    assert lexical.search(asked, held.filter("text is null")).count() == 0


def test_reading_stops_early_and_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    size = 40_000
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.start is not None:
                reads.append(len(range(*key.indices(len(self)))))
            return super().__getitem__(key)

    strong = np.sort(rng.integers(1, 900_000, 30_000))[::-1].copy()
    strong[:40] += 10**7
    lists = [(50, rng.permutation(size)[:30_000], strong), (1, rng.permutation(size)[:2000], np.sort(rng.integers(1, 9, 2000))[::-1].copy())]
    total = np.zeros(size, np.int64)
    for weight, docs, impacts in lists:
        np.add.at(total, docs, weight * impacts)
    best, scores = lexical.settle([(w, d.view(Watched), i) for w, d, i in lists], size, 20)
    order = np.lexsort((np.arange(size), -total))[:20]
    assert best.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert sum(reads) < 10_000


def test_ties_across_the_last_place():
    impacts = np.full(5000, 7, np.int64)
    docs = np.arange(5000)[::-1].copy()
    best, scores = lexical.settle([(3, docs, impacts)], 5000, 20)
    assert best.tolist() == list(range(20)) and set(scores.tolist()) == {21}
    few, _ = lexical.settle([(3, np.array([4, 2]), np.array([9, 1]))], 6, 20)
    assert few.tolist() == [4, 2]
