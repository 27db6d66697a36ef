"""Operators on vectors, pages and conversations, the graph, the queries and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest

from tallybook.llm import chat, near_vectors, queries, topk, warc
from tallybook.llm.graph import components

SF = "/root/testdata/sf0.001"


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype("f4")], i % 3) for i in range(250)]
    rows += [(300, rows[0][1], 0), (301, [x * 2 for x in rows[0][1]], 0), (302, rows[0][1], None), (303, None, 1), (304, [0.0] * 8, 1), (305, [1.0, None] * 4, 1)]
    rows += [(306, [float("nan")] * 8, 1), (307, [float("inf")] * 8, 1), (308, [], 1), (309, [1.0, 2.0], 1), (310, [1.0, 2.0], 1), (None, rows[0][1], 0), (200, rows[7][1], 1), (400, rows[3][1], 2)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, node string, values string")


def fit(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(spark):
    rows, frame = vectors(spark)
    ints = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v, _ in rows if i is not None and fit(v)]
    asked = {}
    for i, v in ints:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])]
    assert sorted(map(tuple, topk.top_k(frame).collect())) == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0
    few = frame.filter("vec_id in (0, 1, 2)")
    assert topk.top_k(few).count() == 2


def test_top_k_ties(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(40)], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, k=5, every=10).filter("query_id = 10").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_top_k_of_large_components_and_mixed_lengths(spark):
    rows = [(0, [70000.0, 1.0]), (1, [1.0, -1.0]), (2, [-70000.0, 1.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 0.0, 0.0]), (200, [2.0**20, 0.5]), (201, [3.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    for q in (0, 100, 200):
        scored = sorted((-sum(x * y for x, y in zip(ints[q], b)), i) for i, b in ints.items() if i != q and len(b) == len(ints[q]))
        assert got[q] == [(i, -s) for s, i in scored]
    with pytest.raises(OverflowError):
        topk.top_k(spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>"))


def test_near_vectors(spark):
    rows, frame = vectors(spark)
    usable = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and fit(v) and any(v)]
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    links = [(x, y) for x in range(len(usable)) for y in range(len(usable)) if x != y and usable[x][2] == usable[y][2] and cos(usable[x][1], usable[y][1])]
    counts = sorted([(usable[x][0], sum(a == x for a, _ in links)) for x in range(len(usable))] + [(i, 0) for i, v, label in rows if i is None or label is None or not (fit(v) and any(v))], key=str)
    got = near_vectors.near_duplicates(frame).collect()
    assert sorted([(r.vec_id, r.n_links) for r in got], key=str) == counts
    component = {r.vec_id: r.component_id for r in got}
    assert component[300] == component[301] == component[0] == 0 and component[302] == 302 and component[310] == 309
    assert component[None] is None and component[303] == 303
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_near_vectors_count_each_pair_once(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    rows = [(i, [float(x) for x in centre + 0.05 * rng.normal(size=64)], 1) for i in range(700)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = ((m @ m.T) >= 0.98).sum(axis=1) - 1
    found = np.array([r.n_links for r in sorted(got)])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000), (None, 5)] + [(500 + i, 501 + i) for i in range(40)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


PAGES = [(1, "http://a", "x" * 900), (2, "http://b\r\nX: y%", "x" * 900), (3, None, None), (4, "u", ""), (5, "u", "ü" * 30), (None, "v", "x" * 900), (7, "w", "long " * 200_000), (5, "u", "ü" * 30)]


def test_warc_round_trip(spark):
    frame = spark.createDataFrame([(*p, "d", "b") for p in PAGES], "page_id long, url string, html string, digest string, bytes string")
    got = warc.round_trip(frame).collect()
    want, first = [], {}
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (html or "").encode()
        head = first.setdefault(raw, i)
        kind = "response" if head == i else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if head == i else head))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.record_type for r in warc.round_trip(frame, min_payload=10**7).collect()} == {"response"}
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_reader_refuses_bad_archives(tmp_path):
    row = {"page_id": 1, "url": "u", "html": "hello", "digest": warc.digest(b"hello"), "bytes": 5, "revisit": False, "refers_to": None}
    raw = warc.page_record(row)
    assert warc.read_record(raw)["payload_bytes"] == 5
    for bad in (raw[:-1], raw.replace(b"hello", b"hellO"), raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    dictionary = warc.zstandard.train_dictionary(4096, [f"page {i} hello world {i * i}".encode() * 20 for i in range(200)]).as_bytes()
    archive = warc._Archive(str(tmp_path), dictionary)
    archive.add(raw)
    done = archive.close()
    data = (tmp_path / done["archive"]).read_bytes()
    assert [warc.parse(r)[0]["warc-type"] for r in warc.frames(data)] == ["warcinfo", "response"]
    packed = warc.zstandard.compress(dictionary)
    assert len(list(warc.frames(warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + data[8 + len(dictionary) :]))) == 2
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(data + b"more"))


def test_chat(spark, monkeypatch):
    odd = "a\\<s>b</s>\\\\[INST] x [/INST]\n<\\s> é\U0001F600"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", ""), (1, 3, "assistant", " tail <"), (2, 0, "assistant", None), (3, 1, "sys\n</s>tem", "q"), (3, 0, None, "first"), (None, 0, "assistant", "lost")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " + "words " * 50) for i in range(40)] + [(5, 0, "user", "same"), (5, 0, "user", "same")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(text for _, role, text in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in whole.items()} == want
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
    for role, text in [("user", odd), ("assistant", "</s>[INST] ok [/INST]")]:
        shown, begin, end = chat.render(role, text)
        assert chat.unescape(shown[begin:end]) == text and not chat._PLAIN.search(shown[begin:end])


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_queries_run(spark, name):
    assert queries.REGISTRY[name](spark, SF).count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        ids = left
    assert docs.count() > 0
