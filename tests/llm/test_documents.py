"""Operators on documents against plain versions."""

import hashlib
import re
from collections import Counter

import pytest

from tallybook.llm import language, mixing, near_text, pieces, repeats, secrets


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_near_duplicates(docs, corpus, no_docs):
    texts = {}
    for i, text, *_ in corpus:
        words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets = {" ".join(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else ({" ".join(words)} if words else set())
        texts.setdefault(i, []).append(sets)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in texts[a] for y in texts[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = near_text.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in texts}
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(s)) for i, sets in texts.items() for s in sets)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_text.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Chains and large groups of near copies, in buckets of many blocks, against all pairs."""
    import random

    from tallybook.llm import near_text

    monkeypatch.setattr(near_text, "CELL", 16)
    monkeypatch.setattr(near_text, "STAR", 8)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(4):
        base = [rng.choice(words) for _ in range(60)]
        for i in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            base = copy if group == 3 else base  # the last group is a chain of changes
            rows.append((len(rows), " ".join(copy)))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(56)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(rows))}


def test_best_partners():
    import numpy as np

    from tallybook.llm import near_text

    x, y, score = np.array([0, 0, 0, 1, 5]), np.array([1, 2, 3, 2, 6]), np.array([9, 8, 7, 1, 3])
    assert near_text._best(x, y, score, 1).tolist() == [0, 1, 2, 4]
    assert near_text._best(x, y, score, 9).tolist() == [0, 1, 2, 3, 4]


def test_secrets(docs, corpus, no_docs):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    want = []
    for i, text, *_ in corpus:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((i, hashlib.sha256(line.encode()).hexdigest()))
    got = secrets.find_secrets(docs)
    assert sorted((r.doc_id, r.base_sha256) for r in got.collect()) == sorted(want)
    assert secrets.find_secrets(no_docs).count() == 0


def test_redacted_keeps_the_rest(docs, no_docs):
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert (69, 'say <secret>" and <secret> <secret>') in rows
    assert (62, None) in rows and (63, "") in rows
    untouched = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 69}
    assert untouched <= rows
    assert secrets.redacted(no_docs).count() == 0


def test_random_tokens_are_told_from_words(spark):
    import random

    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = [(i, "key " + "".join(rng.choice(alphabet) for _ in range(44)) + " end") for i in range(60)]
    plain = [(100 + i, "see abcabcabcabcabcabcabcabcabcabcabcabcabcabc1 or aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1") for i in range(60)]
    got = secrets.find_secrets(spark.createDataFrame(secret + plain, "doc_id long, text string")).collect()
    flagged = {r.doc_id for r in got if "random" in r.spans}
    assert len([i for i in flagged if i < 100]) >= 50
    assert not [i for i in flagged if i >= 100]


def test_chances_of_random_tokens_are_even(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    for n, alphabet in ((24, "0123456789abcdef"), (44, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")):
        k = len(alphabet)
        drawn = [[rng.randrange(k) for _ in range(n)] for _ in range(3000)]
        rows = [([float(x) for x in v], float(sum(v.count(c) ** 2 for c in set(v)))) for v in drawn]
        frame = spark.createDataFrame(rows, "places array<double>, squares double")
        chances = sorted(r[0] for r in frame.select(secrets.battery(F.col("places"), F.col("squares"), F.lit(float(k)))).collect())
        # the distance from even chances, of which 1.95 / sqrt(3000) would be exceeded once in a thousand times
        assert max(abs(c - i / 3000) for i, c in enumerate(chances)) < 0.05
    assert secrets.even_part([100] * 20) == 2000 and 950 < secrets.even_part([5000, 400] + [50] * 18) < 1050


def test_very_long_tokens_and_very_many_matches(spark):
    import random
    import time

    rng = random.Random(6)
    token = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    many = " ".join(f"deadbeef{i:012d}" for i in range(20_000))
    frame = spark.createDataFrame([(1, token), (2, many)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    assert time.time() - began < 60
    spans = [f"hex:{21 * i}:{21 * i + 20}" for i in range(20_000)]
    assert got[2].n_hex == 20_000 and got[2].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_mixing(docs, corpus, no_docs):
    got = mixing.mix(docs, keep=["lang"]).collect()
    assert len(got) == len(corpus)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {i: len(split(t)) for i, t, *_ in corpus if i != 68} == {r.doc_id: r["size"] for r in got if r.doc_id != 68}
    weights = {s: n % 3 + 1 for n, s in enumerate(sorted((s for s in sizes if s is not None)) + [None])}
    want, free, left = {}, dict(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            del free[s]
    want |= share
    assert target == pytest.approx(want)
    again = mixing.mix(docs.repartition(7, "text"), keep=["lang"]).collect()
    assert sorted((r.doc_id, r["size"], r.copies) for r in again) == sorted((r.doc_id, r["size"], r.copies) for r in got)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * id % 97 as int)) as text", "concat('s', id % 5) as source")
    by_source = mixing.mix(rows).groupBy("source").agg({"taken": "sum", "target": "max", "copies": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.01 for r in by_source)


def test_pieces_against_the_library(docs, corpus, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode_documents(docs).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, library.encode(t or "")) for i, t, *_ in corpus)
    digest = {r.doc_id: r.decoded_sha256 for r in got}
    assert all(digest[i] == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in corpus if i != 68)
    assert pieces.encode_documents(no_docs).count() == 0


def test_words_by_merging_and_by_best_path(spark):
    from pyspark.sql import functions as F

    rows = tuple((p, i, s) for i, (p, s) in enumerate([("a", -2.0), ("b", -2.5), ("ab", -3.0), ("abc", -9.0), ("bc", -1.5), ("c", -4.0), ("cab", -2.0)]))
    table = {p: (i, s) for p, i, s in rows}
    words = ["a", "abc", "cabbc", "abcab" * 4, "xabéc", "bbb", "zz", "abc" * 40]
    frame = spark.createDataFrame([(w,) for w in words], "word string")

    def best(word):
        paths = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            ways = [(paths[s][0] + table[word[s:end]][1], s, paths[s][1] + [table[word[s:end]][0]]) for s in range(end) if word[s:end] in table]
            if not any(s == end - 1 for _, s, _ in ways):
                ways.append((paths[end - 1][0] - 19.0, end - 1, paths[end - 1][1] + [100 + b for b in word[end - 1].encode()]))
            score, _, ids = max(ways, key=lambda w: w[:2])
            paths[end] = (score, ids)
        return paths[len(word)][1]

    got = {r.word: r.ids for r in pieces.encode_words(frame, rows, 100, "unigram").collect()}
    assert got == {w: best(w) for w in words}
    merged = {r.word: r.ids for r in pieces.encode_words(frame, rows, 100, "bpe").collect()}
    assert merged == {w: pieces.merge_word(w, table, 100) for w in words}
    assert frame.filter(F.length("word") > pieces.LONG).count() == 1


def test_words_in_one_pass(spark):
    import random

    rows, base = pieces.piece_rows(), pieces.byte_base()
    assert pieces.in_order(rows) and all(set(p) == {pieces.SPACE} for p in pieces.free_pieces(rows))
    table, rng = {p: (i, s) for p, i, s in rows}, random.Random(5)
    letters = ["etaoinsrhl", "0123456789", "aàäbcçdeéèfghiïjk", pieces.SPACE * 6 + "._-the", "日本語のテ", "😀é\u0301x"]
    words = {"".join(rng.choice(kind) for _ in range(rng.randint(1, 60))) for kind in letters for _ in range(60)} | {pieces.SPACE * n for n in range(1, 60)}
    words |= {pieces.SPACE * n + "the" for n in range(30)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word: r.ids for r in pieces.encode_words(frame, rows, base, "bpe").collect()} == {w: pieces.merge_word(w, table, base) for w in words}


def test_repeats(docs, corpus, no_docs):
    first, want = {}, []
    for i, text, *_ in sorted(corpus, key=lambda r: r[0]):
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, text, *_ in corpus:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == sorted(want)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_in_wrongly_joined_groups(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "_gram_hashes", lambda data: np.zeros(len(data) - repeats.GRAM + 1, np.uint64))
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    out = repeats.least_ids(data, np.array([0, 60, 120]), np.array([9, 9, 9]), np.array([1, 2, 3]))
    assert out.tolist() == [1, 2, 1]


def test_language(docs, corpus, no_docs):
    got = language.identify(docs).collect()
    assert len(got) == len(corpus)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (62, 63, 64, 65))
    known = {i: lang for i, _, lang, *_ in corpus if i < 60}
    assert sum(by_id[i].lang_pred == lang for i, lang in known.items()) >= 58
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert language.identify(no_docs).count() == 0


def test_every_letter_counts(spark, docs):
    assert language.words_of("10 m² x½ house²x a_b Straße3c") == ["m", "x", "house", "x", "a", "b", "straße", "c"]
    field = language.fit_documents(docs)
    frame = spark.createDataFrame([("10 m² x½",), ("house²",), ("12 ½ ²",)], "text string")
    got = [r[0].lang_pred for r in frame.select(language.predictor(field)("text")).collect()]
    assert got[0] != "und" and got[1] != "und" and got[2] == "und"


def test_forward_backward_is_the_plain_recursion():
    import numpy as np

    rng = np.random.default_rng(5)
    scores, moves = rng.normal(size=(203, 3)), rng.normal(size=(3, 3))
    first = np.zeros(203, bool)
    first[[0, 1, 90]] = True
    want = []
    for a, b in ((0, 1), (1, 90), (90, 203)):
        e, n = np.exp(scores[a:b]), b - a
        f, g = np.zeros((n, 3)), np.ones((n, 3))
        f[0] = e[0]
        for t in range(1, n):
            f[t] = (f[t - 1] @ np.exp(moves)) * e[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            g[t] = np.exp(moves) @ (e[t + 1] * g[t + 1])
            g[t] /= g[t].sum()
        want.append(f * g / (f * g).sum(axis=1, keepdims=True))
    assert np.allclose(language.marginals(scores, first, moves), np.concatenate(want))


def test_fitting_holds_some_texts_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(8)
    some = [(" ".join(rng.choice([f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], 6000)), lang) for lang in "abcd" for _ in range(15)]
    monkeypatch.setattr(language, "STEPS", 1)
    tracemalloc.start()
    field = language.fit(some)  # 720,000 words with the spliced ones
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    monkeypatch.setattr(language, "FIT_CHUNK", 1 << 40)
    whole = language.fit(some)
    assert np.allclose(field.weights, whole.weights) and np.allclose(field.transitions, whole.transitions)


def test_many_small_chunks_and_buckets_of_words(spark, docs, monkeypatch):
    words = ["a", "▁the", "é́", "日本", "😀", "▁" * 40]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word: r.b for r in frame.select("word", pieces._bucket_of("word", 7).alias("b")).collect()} == {w: pieces._bucket(w, 7) for w in words}
    whole = {(r.doc_id, tuple(r.ids)) for r in pieces.encode(docs).collect()}
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(pieces, "BUCKET_CHARS", 2000)
    assert {(r.doc_id, tuple(r.ids)) for r in pieces.encode(docs).collect()} == whole


def test_units_of_words(spark):
    rows = pieces.piece_rows()
    unit = pieces.unit_pattern(rows)
    assert all(unit.findall(p) == [p] for p, _, _ in rows if len(p) > 1)
    assert pieces.words_of("Say. x_{². ab1\n", unit) == ["▁Say", ".", "▁x", "_{².", "▁ab", "1", "\n"]
    assert pieces.unit_pattern((("a.", 0, -1.0),)).findall("▁a.b") == ["▁a.", "b"]
    table, base = {p: (i, s) for p, i, s in rows}, pieces.byte_base()
    for text in ("Say.&&& (x_{²..)  ab1c—d", "ÑCIES-- '\"é́!!"):
        whole = [i for w in pieces.words_of(text) for i in pieces.merge_word(w, table, base)]
        assert [i for w in pieces.words_of(text, unit) for i in pieces.merge_word(w, table, base)] == whole
    words = ["\U000f0005x", "\U00100001", "😀the", "\U000f0005" + "a" * 70]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word: r.ids for r in pieces.encode_words(frame, rows, base, "bpe").collect()} == {w: pieces.merge_word(w, table, base) for w in words}


def test_encoding_leaves_one_stage_in_the_scratch_folder(spark, docs, monkeypatch):
    import os

    from tallybook.llm import common

    written = []
    monkeypatch.setattr(common, "scratch_path", lambda spark, name, path=common.scratch_path: written.append(path(spark, name)) or written[-1])
    assert pieces.encode(docs).count() == docs.count()
    assert [os.path.basename(p).split("-")[0] for p in written if os.path.exists(p)] == ["answers"]
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    assert spark.conf.get(name) == "128"


def test_words_keep_their_order_in_buckets():
    words = ["▁the", "é", "a", "日本", "😀", "▁", "b.", "the"]
    texts, order, at = pieces._in_buckets(words, 3)
    assert at == sorted({pieces._bucket(w, 3) for w in words})
    assert [[words[i] for i in some] for some in order] == [sorted((w for w in words if pieces._bucket(w, 3) == b), key=str.encode) for b in at]
    again, shuffled, _ = pieces._in_buckets(words[::-1], 3)
    assert [[again[i] for i in some] for some in shuffled] == [[texts[i] for i in some] for some in order]
    assert pieces._in_buckets([], 3) == ([], [], [])
    assert "words" not in pieces.ANSWER


def test_encoding_and_decoding_share_a_worker(spark, docs):
    got = pieces.encode_documents(docs)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    decode = pieces.decoder()
    rows = got.select("decoded_sha256", decode("ids").alias("text")).collect()
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
