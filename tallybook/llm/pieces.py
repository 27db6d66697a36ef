"""SentencePiece encoding and decoding: a relational lattice of substrings, folded per word."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import discard, materialize, parts, setting
from tallybook.llm.secrets import _let as let
from tallybook.session import small_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
LONG = 62  # code points, whose cuts fit into one number; the lattice of a longer word is folded by the same rules outside of SQL
CHUNK_CHARS = 8 << 20  # characters of documents that share a dictionary
BUCKET_CHARS = 32 << 20  # characters of documents per bucket of words, which a worker of Python holds as objects
WORDS = 20_000  # distinct words whose edges one task sorts

PIECES = T.StructType([
    T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("free", T.BooleanType()),
])
RANKED = T.StructType([T.StructField("piece", T.StringType()), T.StructField("code", T.LongType())])
# An edge of a ranked lattice as one number: rank of the score, start, LONG less the size, id, kind. Numbers sort as edges are tried.
RANK, START, BACK, ID = 30, 24, 18, 1
IDS = 1 << 17  # ids of single characters stand in for them as characters of the private planes
PRIVATE = 0xF0000
UNKNOWN = IDS  # a single character without a piece
Rows = tuple[tuple[str, int, float], ...]
REQUEST = "chunk int, bucket int, words binary"
ANSWER = "chunk int, bucket int, ids binary, counts binary"
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


@functools.cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def piece_rows(path: str = MODEL) -> Rows:
    """Ordinary pieces of a model with ids and scores; control, unknown, unused and byte pieces match no text."""
    m = _model(path)
    special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
    return tuple((m.id_to_piece(i), i, m.get_score(i)) for i in range(m.get_piece_size()) if not special(i))


@functools.cache
def byte_base(path: str = MODEL) -> int:
    """Id of the piece for byte 0; those of the other bytes follow it."""
    return _model(path).piece_to_id("<0x00>")


@functools.cache
def free_pieces(rows: Rows) -> frozenset[str]:
    """Pieces of several characters that share one score, as those given by hand do: they are matched as they stand, longest first."""
    shared = Counter(s for p, _, s in rows if len(p) > 1)
    return frozenset(p for p, _, s in rows if len(p) > 1 and shared[s] > 1)


@functools.cache
def in_order(rows: Rows) -> bool:
    """Whether every piece comes out whole if its own substrings are merged once each, by falling score.

    Then one pass over the edges of any word equals merging the best pair again and again: while both ends of an edge are cuts,
    what lies between is merged as the piece's own text is, and so is two parts when its turn comes.
    """
    scores, free = {p: s for p, _, s in rows}, free_pieces(rows)

    def whole(piece: str) -> bool:
        n, cuts = len(piece), set(range(len(piece) + 1))
        edges = sorted((-scores[x], i, j) for i in range(n) for j in range(i + 2, n + 1) if (x := piece[i:j]) in scores and x not in free)
        for _, i, j in edges:
            if i in cuts and j in cuts and sum(c in cuts for c in range(i + 1, j)) == 1:
                cuts -= set(range(i + 1, j))
        return len(cuts) == 2

    return all(whole(p) for p, _, _ in rows if len(p) > 1 and p not in free)


def piece_table(spark: SparkSession, rows: Rows) -> DataFrame:
    free = free_pieces(rows)
    return small_table(spark, [(p, i, s, p in free) for p, i, s in rows], PIECES)


def ranked_table(spark: SparkSession, rows: Rows) -> DataFrame:
    """Pieces of several characters with the part of an edge's number that does not depend on its place; the empty piece has none."""
    free, rank = free_pieces(rows), {x: i for i, x in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
    code = lambda p, i, s: rank[s] << RANK | (LONG - len(p)) << BACK | i << ID | (p in free)
    return small_table(spark, [(p, code(p, i, s)) for p, i, s in rows if 1 < len(p) <= LONG] + [("", None)], RANKED)


def lattice(words: DataFrame, pieces: DataFrame, longest: int, tasks: int) -> DataFrame:
    """Edges of each distinct word: ``word`` and an array of (start, end, id, score).

    Substrings up to the longest piece are exploded and equi-joined to the pieces. The words are dealt out
    first, to so many tasks that each holds its edges in memory, so grouping the edges by word moves none of them. The pieces, a vocabulary of
    fixed size, are broadcast. An empty edge keeps words in which no piece occurs.
    """
    return _edges(words, pieces, longest, tasks, 1).groupBy("word").agg(F.collect_list(F.struct("start", "end", "id", "score")).alias("edges"))


def ranked_lattice(words: DataFrame, pieces: DataFrame, longest: int, tasks: int) -> DataFrame:
    """The same edges as merging looks at them, each as one number: ``word`` and ``edges`` of several characters."""
    edges = _edges(words, pieces, longest, tasks, 2).select("word", (F.col("code") + F.shiftleft(F.col("start").cast("long"), START)).alias("edge"))
    return edges.groupBy("word").agg(F.collect_list("edge").alias("edges"))


def _edges(words: DataFrame, pieces: DataFrame, longest: int, tasks: int, least: int) -> DataFrame:
    """One row per edge of ``least`` characters or more, and an empty one: the word, its places, and the piece's columns."""
    n, size = F.length("word"), F.col("size")
    spread = (
        words.repartition(tasks, "word")
        .select("word", F.explode(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))).alias("start"))
        .select("word", "start", F.explode(F.sequence(F.when(F.col("start") == 0, least - 1).otherwise(least), F.least(F.lit(longest), n - F.col("start")))).alias("size"))
        .select("word", "start", (F.col("start") + size).alias("end"), F.coalesce(F.when(size >= least, F.substring(F.col("word"), F.col("start") + 1, size)), F.lit("")).alias("piece"))
        .withColumn("key", F.xxhash64("piece"))
    )
    # found by a number, which Spark looks up faster than a text, and then compared as a text
    same = F.col("piece").startswith(F.col("other")) & F.col("other").startswith(F.col("piece"))
    return spread.join(F.broadcast(pieces.withColumn("key", F.xxhash64("piece")).withColumnRenamed("piece", "other")), "key").filter(same)


def _bytes(char: Column, base: int) -> Column:
    """Ids of the bytes of a character."""
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + base)


def viterbi(base: int, lowest: float) -> Column:
    """Ids of the best path through ``edges`` of ``word``: greatest sum of scores, of equals the later start of the last piece.

    The fold goes from place to place; its state holds the best score and path of every place so far. A
    character without a piece of its own costs ``lowest`` minus 10 and becomes bytes.
    """
    word, edges = F.col("word"), F.col("edges")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.array().cast("array<int>").alias("ids")))

    def place(best: Column, end: Column) -> Column:
        into = F.filter(edges, lambda e: (e["end"] == end) & (e["start"] < end))
        ways = F.transform(
            into,
            lambda e: F.struct((F.element_at(best, e["start"] + 1)["score"] + e["score"]).alias("score"), e["start"].alias("start"), F.concat(F.element_at(best, e["start"] + 1)["ids"], F.array(e["id"])).alias("ids")),
        )
        before = F.element_at(best, end)
        unknown = F.struct((before["score"] + (lowest - 10)).alias("score"), (end - 1).alias("start"), F.concat(before["ids"], _bytes(F.substring(word, end, F.lit(1)), base)).alias("ids"))
        alone = F.exists(into, lambda e: e["start"] == end - 1)
        return F.concat(best, F.array(F.array_max(F.when(alone, ways).otherwise(F.concat(ways, F.array(unknown))))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, place, lambda best: F.element_at(best, -1)["ids"])


def one_pass(base: int, rows: Rows) -> Column:
    """Ids of ``word`` by merging, for pieces that are ``in_order``: each edge of the lattice is tried once, by falling score, then from the left.

    ``edges`` are those of :func:`ranked_lattice`. The state is a number with a bit for every place: 1 for a cut between parts, 0 inside a part. An edge fits if it runs
    from cut to cut with one cut between, or any number if its piece is matched as it stands. Single characters need no edge: their ids are put in their places.
    """
    word = F.col("word")
    two, low = F.lit(3).cast("long"), F.lit((1 << 32) - 1)
    shifted = lambda value, n: F.call_function("shiftleft", value, n)
    uncut = shifted(F.lit(2).cast("long"), F.length(word)) - 1

    def bits(e: Column) -> Column:
        """An edge by the bits of its ends and of its whole span, its start and id as one number, and its kind."""
        field = lambda at: F.shiftright(e, at).bitwiseAND(F.lit(63)).cast("int")
        top = F.call_function("shiftright", F.lit(1 << LONG), field(BACK))
        part = F.shiftleft(field(START).cast("long"), 32) + F.shiftright(e, ID).bitwiseAND(F.lit(IDS - 1))
        return F.struct(shifted(top + 1, field(START)).alias("ends"), shifted(top + top - 1, field(START)).alias("span"), part.alias("part"), (e.bitwiseAND(F.lit(1)) == 1).alias("free"))

    def merge(marks: Column, e: Column) -> Column:
        fits = (marks.bitwiseAND(e["ends"]) == e["ends"]) & ((F.bit_count(marks.bitwiseAND(e["span"])) == 3) | e["free"])
        return F.when(fits, marks.bitwiseAND(F.bitwise_not(e["span"] - e["ends"]))).otherwise(marks)

    single = {p: i for p, i, _ in rows if len(p) == 1}
    named = F.translate(word, "".join(single), "".join(chr(PRIVATE + i) for i in single.values()))

    def parts_of(edges: Column, marks: Column) -> Column:
        # a part is a cut, as many blanks as it has further characters, and a cut
        wide = F.transform(F.filter(edges, lambda e: marks.bitwiseAND(e["span"]) == e["ends"]), lambda e: e["part"])
        places = F.filter(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.call_function("shiftright", marks, i).bitwiseAND(two) == two)
        char = lambda text, i: F.ascii(F.substring(text, i + 1, F.lit(1)))
        number = lambda text, i: F.when(char(text, i) >= PRIVATE, char(text, i) - PRIVATE).otherwise(UNKNOWN)
        found = lambda text: F.transform(places, lambda i: F.shiftleft(i.cast("long"), 32) + number(text, i))
        alone = marks.bitwiseAND(F.shiftright(marks, 1)) != 0
        return let(F.when(alone, F.sort_array(F.concat(wide, let(named, found)))).otherwise(F.sort_array(wide)), filled)

    def filled(found: Column) -> Column:
        """The ids in order, with bytes for each character that no piece stands for."""
        number = lambda f: f.bitwiseAND(low).cast("int")
        raw = lambda f: _bytes(F.substring(word, F.shiftright(f, 32).cast("int") + 1, F.lit(1)), base)
        mixed = F.flatten(F.transform(found, lambda f: F.when(number(f) == UNKNOWN, raw(f)).otherwise(F.array(number(f)))))
        return F.when(F.exists(found, lambda f: number(f) == UNKNOWN), mixed).otherwise(F.transform(found, number))

    tried = F.transform(F.sort_array("edges"), bits)
    return let(tried, lambda edges: let(F.aggregate(edges, uncut, merge), lambda marks: parts_of(edges, marks)))


def merges(base: int) -> Column:
    """Ids of ``word`` by merging, for any pieces: of all edges over two neighbouring parts the best, leftmost one joins them, again and again.

    The state holds the cuts between parts, from single characters on.
    """
    word = F.col("word")
    edges = F.filter("edges", lambda e: e["end"] - e["start"] > 1)

    def merge(cuts: Column, _: Column) -> Column:
        fits = F.filter(
            edges,
            lambda e: (F.array_position(cuts, e["start"]) > 0) & (F.array_position(cuts, e["end"]) - F.array_position(cuts, e["start"]) == 2),
        )
        best = F.array_max(F.transform(fits, lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("first"), e["end"].alias("end"))))
        return F.when(F.size(fits) > 0, F.filter(cuts, lambda c: (c <= -best["first"]) | (c >= best["end"]))).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(1), F.length(word)), F.sequence(F.lit(0), F.length(word)), merge)
    spans = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def ids(span: Column) -> Column:
        found = F.filter("edges", lambda e: (e["start"] == span["s"]) & (e["end"] == span["e"]))
        return F.when(F.size(found) > 0, F.transform(found, lambda e: e["id"])).otherwise(_bytes(F.substring(word, span["s"] + 1, F.lit(1)), base))

    return F.flatten(F.transform(spans(cuts), ids))


def merge_word(word: str, table: dict[str, tuple[int, float]], base: int) -> list[int]:
    """The same merging for one word, with a heap of candidates."""
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word)))
    alive, heap = [True] * len(word), []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(word) and (found := table.get(word[left : after[right]])):
            heapq.heappush(heap, (-found[1], left, right, after[right]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, left, right, end = heapq.heappop(heap)
        if not (alive[left] and right < len(word) and alive[right] and after[left] == right and after[right] == end):
            continue
        after[left], alive[right] = end, False
        if end < len(word):
            before[end] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    out, i = [], 0
    while i < len(word):
        found = table.get(word[i : after[i]])
        out += [found[0]] if found else [b + base for b in word[i : after[i]].encode("utf-8", "surrogatepass")]
        i = after[i]
    return out


def viterbi_word(word: str, table: dict[str, tuple[int, float]], base: int, longest: int, lowest: float) -> list[int]:
    """The same best path for one word."""
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    back: list[tuple[float, int, list[int]]] = best
    for end in range(1, len(word) + 1):
        ways = [(back[s][0] + f[1], s, [f[0]]) for s in range(max(0, end - longest), end) if (f := table.get(word[s:end]))]
        if not any(s == end - 1 for _, s, _ in ways):
            ways.append((back[end - 1][0] + lowest - 10, end - 1, [b + base for b in word[end - 1].encode("utf-8", "surrogatepass")]))
        back.append(max(ways, key=lambda w: w[:2]))
    out, end = [], len(word)
    while end:
        out.append(back[end][2])
        end = back[end][1]
    return [i for ids in reversed(out) for i in ids]


def encode_words(words: DataFrame, rows: Rows, base: int, kind: str) -> DataFrame:
    """Ids of distinct words: the columns of ``words`` and ``ids``. ``kind`` is ``bpe`` or ``unigram``.

    A model of scores that add up takes the best path through the lattice. The scores of a merging model are ranks, and its
    ids are not those of a best path, so its edges are folded by rank.
    """
    longest, lowest = max(len(p) for p, _, _ in rows), min(s for _, _, s in rows)
    spark = words.sparkSession
    ranked = kind != "unigram" and max(i for _, i, _ in rows) < IDS and in_order(rows)
    fold = one_pass(base, rows) if ranked else viterbi(base, lowest) if kind == "unigram" else merges(base)
    tasks = parts(words.count(), WORDS)
    fits = (F.length("word") <= LONG) & ~F.col("word").rlike(rf"[\x{{{PRIVATE:x}}}-\x{{10ffff}}]")
    inside = words.filter(fits).select("word")
    if ranked:
        short = ranked_lattice(inside, ranked_table(spark, rows), longest, tasks)
    else:
        short = lattice(inside, piece_table(spark, rows + (("", -1, 0.0),)), longest, tasks)
    short = short.select("word", fold.alias("ids"))

    @F.pandas_udf("array<int>")
    def outside(batch: pd.Series) -> pd.Series:
        table = {p: (i, s) for p, i, s in rows}
        one = (lambda w: viterbi_word(w, table, base, longest, lowest)) if kind == "unigram" else (lambda w: merge_word(w, table, base))
        return batch.map(one)

    return short.unionByName(words.filter(~fits).select("word", outside("word").alias("ids")))


@functools.cache
def unit_pattern(rows: Rows) -> re.Pattern:
    """What is encoded by itself: spaces with the letters, or the other characters, that follow them; a line end.

    No piece may hold a letter beside another character, spaces before it apart, so that a word's ids are those of its units. A letter
    that some piece joins to other characters counts as one of those; if there are many of them, words are not cut at all.
    """
    joined = ""
    while len(joined) < 100:
        letter, other = rf"[^\W\d_{joined}]", rf"(?:[\d_{joined}]|[^\w{SPACE}\n])"
        unit = re.compile(f"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+|\n")
        cut = [found for p, _, _ in rows if len(p) > 1 and len(found := unit.findall(p)) > 1 and SPACE not in p[1:].lstrip(SPACE)]
        more = {c for found in cut for c in "".join(found) if re.match(letter, c)}
        if not cut:
            return unit
        if not more:
            break
        joined += "".join(sorted(more))
    return WORD


def words_of(text: str, unit: re.Pattern = WORD) -> list[str]:
    """Words of a text: each begins where spaces begin, line ends stand alone. A space is put before the text.

    No piece holds a space after another character, or a line end, so words are encoded one by one, and so are the units they are cut into.
    """
    return unit.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def _in_buckets(words: list[str], buckets: int) -> tuple[list[bytes], list[np.ndarray], list[int]]:
    """Words as bytes, the sorted places of those of each bucket that holds some, and these buckets."""
    texts = [w.encode("utf-8", "surrogatepass") for w in words]
    bucket = np.fromiter(map(zlib.crc32, texts), np.int64, len(texts)) % buckets
    ranked = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
    order = ranked[np.argsort(bucket[ranked], kind="stable")]
    at, starts = np.unique(bucket[order], return_index=True)
    return texts, np.split(order, starts[1:]) if len(at) else [], at.tolist()


def _bucket_of(word: str, buckets: int) -> Column:
    """The same number as a column, so that no second worker of Python runs beside that of the buckets."""
    return F.pmod(F.crc32(F.col(word).cast("binary")), F.lit(buckets)).cast("int")


@F.pandas_udf(T.BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    coder = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: coder.compress(t.encode("utf-8", "surrogatepass")))


def _unpack(coder: zstandard.ZstdDecompressor, packed: bytes) -> str:
    return coder.decompress(packed).decode("utf-8", "surrogatepass")


def _lines(coder: zstandard.ZstdDecompressor, packed: bytes) -> list[str]:
    return _unpack(coder, packed).split("\n")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, kind: str = "bpe", digest: bool = False) -> DataFrame:
    """Piece ids of every text: the id column and ``ids``, with ``digest`` also ``decoded_sha256`` of the text decoded from them.

    Chunks of documents ask for the words they hold; words are gathered in buckets, each distinct word is
    encoded once through the lattice, and the answers go back to the chunks, which put the ids of their
    texts together. Texts move in packed form, words as sorted packed lists, and answers without the words, whose order the chunk knows.

    Null and empty texts have no ids. Repeated rows are encoded each; other columns are ignored.
    """
    spark = docs.sparkSession
    base, rows = byte_base(model), piece_rows(model)
    unit = unit_pattern(rows)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.length("text"))).first()[0]
    chunks, buckets = parts(size, CHUNK_CHARS), parts(size, BUCKET_CHARS)
    chunked = narrow.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", _pack("text").alias("packed"))

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        coder, known = zstandard.ZstdDecompressor(), set()
        for packed in table["packed"].to_pylist():
            known.update(words_of(_unpack(coder, packed), unit))
        known.discard("\n")
        pack, out = zstandard.ZstdCompressor(level=3), []
        texts, order, at = _in_buckets(list(known), buckets)
        for b, some in zip(at, order):
            out.append((key[0].as_py(), b, pack.compress(b"\n".join(map(texts.__getitem__, some.tolist())))))
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([r[1] for r in out], pa.int32()), "words": pa.array([r[2] for r in out], pa.binary())})

    def union(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        coder, known = zstandard.ZstdDecompressor(), set()
        for packed in table["words"].to_pylist():
            known.update(_lines(coder, packed))
        return pa.table({"word": pa.array(list(known), pa.string())})

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, encoded: pa.Table) -> pa.Table:
        coder, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        at = {w: i for i, w in enumerate(encoded["word"].to_pylist())}
        lists = encoded["ids"].combine_chunks()
        offsets, values = _flat(lists)
        out = []
        for chunk, bucket, packed in zip(*(asked[c].to_pylist() for c in ("chunk", "bucket", "words"))):
            found = np.fromiter(map(at.__getitem__, _lines(coder, packed)), np.int64)
            ids, counts = _gather(offsets, values, found)
            out.append((chunk, bucket, pack.compress(ids.astype("<i4").tobytes()), pack.compress(counts.astype("<i4").tobytes())))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("chunk", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())))})

    def assemble(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        coder = zstandard.ZstdDecompressor()
        at = {"\n": 0}
        places = [np.fromiter((at.setdefault(w, len(at)) for w in words_of(_unpack(coder, packed), unit)), np.int32) for packed in texts["packed"].to_pylist()]
        # the answers hold the words in the order in which this chunk asked for them
        _, order, _ = _in_buckets(list(at)[1:], buckets)
        asked = np.concatenate([np.zeros(1, np.int64), *(some + 1 for some in order)])
        row = np.empty(len(at), np.int64)
        row[asked] = np.arange(len(at))
        del at
        ids, counts = [np.array([10 + base], np.int32)], [np.array([1], np.int32)]
        for _, some, sizes in sorted(zip(*(answers[c].to_pylist() for c in ("bucket", "ids", "counts")))):
            ids.append(np.frombuffer(coder.decompress(some), "<i4"))
            counts.append(np.frombuffer(coder.decompress(sizes), "<i4"))
        values, sizes = np.concatenate(ids), np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        found = [_gather(offsets, values, row[words])[0] for words in places]
        lengths = [len(some) for some in found]
        flat = np.concatenate(found) if found else np.empty(0, np.int32)
        bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32())
        out = {"doc_id": texts["doc_id"], "ids": pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32)))}
        if digest:
            text = _text_of(rows, base)
            out["decoded_sha256"] = pa.array([hashlib.sha256(text(some).encode()).hexdigest() for some in found], pa.string())
        return pa.table(out)

    requests = materialize(chunked.groupBy("chunk").applyInArrow(ask, REQUEST), "requests")
    known = materialize(requests.groupBy("bucket").applyInArrow(union, "word string"), "words")
    # a task groups the edges of its words as they come, without sorting them
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * WORDS)):
        encoded = materialize(encode_words(known, rows, base, kind), "encoded")
    discard(known)
    answers = requests.groupBy("bucket").cogroup(encoded.withColumn("bucket", _bucket_of("word", buckets)).groupBy("bucket")).applyInArrow(answer, ANSWER)
    answers = materialize(answers, "answers")
    discard(requests, encoded)
    out = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, T.StructType([*ENCODED.fields, T.StructField("decoded_sha256", T.StringType())]) if digest else ENCODED)
    return out.withColumnRenamed("doc_id", id_col)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def _gather(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the given rows one after the other, and their lengths."""
    counts = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(offsets[rows] - ends + counts, counts) + np.arange(total)], counts


def _text_of(rows: Rows, base: int) -> Callable[[np.ndarray], str]:
    """The text of an array of ids."""
    table = {i: p.replace(SPACE, " ").encode() for p, i, _ in rows} | {base + b: bytes([b]) for b in range(256)}
    return lambda ids: b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def decoder(model: str = MODEL):
    """A column function from ids to text: pieces joined, byte pieces as bytes, the space put before the text taken off."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        text = _text_of(piece_rows(model), byte_base(model))
        return batch.map(lambda ids: None if ids is None else text(ids))

    return decode


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Ids of every text with their number and the digest of the text decoded from them: id, ``n_tokens``, ``ids``, ``decoded_sha256``."""
    # decoded where they are put together: a step of its own would hold a second worker of Python for each task
    encoded = encode(docs, id_col, text_col, model, digest=True)
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")
