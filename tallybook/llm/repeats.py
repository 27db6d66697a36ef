"""Repeated byte strings: suffixes in buckets at content-defined cover positions, one bucket sorted at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import bucketed, materialize, parts
from tallybook.session import as_lookup

LENGTH = 50
GRAM = 24  # bytes by which suffixes are bucketed
WINDOW = LENGTH - GRAM + 1  # grams in a string of LENGTH bytes, one of which is its cover position
CHUNK = 2 << 20  # bytes of text handled together
BUCKET = 8 << 20  # bytes of text per bucket of suffixes
PLACE_BITS = 24
STEP = 1 << 15  # places worked on at once, so that arrays stay in the processor's cache

ANCHORS = "bucket int, chunk int, grams binary, shared binary"
MASKS = "chunk int, bucket int, mask binary"
CONTEXTS = "bucket int, chunk int, docs binary, sizes binary, places binary, bytes binary"
ANSWERS = "chunk int, bucket int, least binary"
EIGHTH = np.uint64(pow(0x9E3779B97F4A7C15, 8, 1 << 64))
RESULT = "digest binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@F.pandas_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("packed", T.BinaryType()), T.StructField("n_bytes", T.LongType())]))
def _pack(texts: pd.Series) -> pd.DataFrame:
    coder = zstandard.ZstdCompressor(level=3)
    raw = texts.map(lambda t: t.encode("utf-8", "surrogatepass"))
    return pd.DataFrame({"digest": raw.map(lambda r: hashlib.blake2b(r, digest_size=16).digest()), "packed": raw.map(coder.compress), "n_bytes": raw.map(len)})


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from every place, by doubling."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    power, size = np.uint64(0x9E3779B97F4A7C15), 1
    while size < 16:
        h = h[:-size] * power + h[size:]
        if size == 4:
            eight = h
        elif size == 8:
            return _mixed(h[:-8] * np.array([EIGHTH]) + eight[16:])
        power = np.multiply(np.array([power]), np.array([power]))[0]
        size *= 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def cover(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cover positions of the texts in ``data``.

    Every string of LENGTH bytes inside a text is covered by the place, among its first WINDOW ones, with the
    least gram hash, the leftmost of equals: a choice by content, so equal strings have their place at the
    same offset. Returns for each run of strings with one place: first and last string, the place, its gram hash, its text.
    """
    inner = np.ones(len(data), bool)
    for begin, end in zip(starts.tolist(), ends.tolist()):
        inner[max(begin, end - LENGTH + 1) : end] = False
    low = np.uint64((1 << PLACE_BITS) - 1)
    strings, places, grams = [], [], []
    for begin in range(0, len(data) - LENGTH + 1, STEP):
        h = _gram_hashes(data[begin : begin + STEP + LENGTH - 1]) & ~low
        least = _sliding_least(h | np.arange(len(h), dtype=np.uint64), WINDOW)
        fits = inner[begin : begin + len(least)]
        least = least[fits]
        place = (least & low).astype(np.int64) + begin
        string = np.flatnonzero(fits) + begin
        # only the first string of a run is kept here; a run that goes on in the next part is split, which changes no result
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)
        first = np.flatnonzero(new)
        strings.append(np.stack([string[first], string[np.append(first[1:], len(string)) - 1]]) if len(first) else np.empty((2, 0), np.int64))
        places.append(place[first])
        grams.append(least[first] & ~low)
    if not strings:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    first, last = np.concatenate(strings, axis=1)
    return first, last, np.concatenate(places), np.concatenate(grams), np.searchsorted(ends, first, side="right")


class _Chunk:
    """The texts of a chunk, in order of id, joined to one array, and their cover."""

    def __init__(self, table: pa.Table):
        coder = zstandard.ZstdDecompressor()
        rows = sorted(zip(table["doc_id"].to_pylist(), table["digest"].to_pylist(), table["packed"].to_pylist()))
        self.doc_ids, self.digests = [r[0] for r in rows], [r[1] for r in rows]
        texts = [coder.decompress(r[2]) for r in rows]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.first, self.last, self.place, self.gram, self.text = cover(self.data, self.ends, self.starts)

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams by bucket, whether several ids hold them, and the number of the distinct gram of each place."""
        gram, inverse = np.unique(self.gram, return_inverse=True)
        ids = np.array(self.doc_ids, np.int64)[self.text] if len(self.text) else np.empty(0, np.int64)
        low, high = np.full(len(gram), np.iinfo(np.int64).max), np.full(len(gram), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        bucket = ((gram >> np.uint64(PLACE_BITS)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return gram[order], (low != high)[order], bucket[order], number[inverse]


def _anchors(key: tuple[pa.Scalar, ...], table: pa.Table, buckets: int) -> pa.Table:
    chunk = _Chunk(table)
    gram, shared, bucket, _ = chunk.grams(buckets)
    out = []
    for b, (i, j) in _ranges(bucket):
        # the bucket settles the rest of the hash; a chance hit of 32 bits only costs a comparison later
        short = (gram[i:j] // np.uint64(buckets) >> np.uint64(PLACE_BITS)).astype("<u4")
        out.append((b, key[0].as_py(), short.tobytes(), np.packbits(shared[i:j]).tobytes()))
    return _table(out, bucket=pa.int32(), chunk=pa.int32(), grams=pa.binary(), shared=pa.binary())


def _ranges(values: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """Runs of equal values in a sorted array."""
    if len(values):
        bounds = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        for i, j in zip(bounds[:-1], bounds[1:]):
            yield int(values[i]), (int(i), int(j))


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})


def _masks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Which grams of a bucket occur in another chunk too, or in several texts of their own."""
    lists = [np.frombuffer(g, "<u4") for g in table["grams"].to_pylist()]
    gram, counts = np.unique(np.concatenate(lists), return_counts=True)
    often = gram[counts > 1]
    out = []
    for chunk, some, shared in zip(table["chunk"].to_pylist(), lists, table["shared"].to_pylist()):
        at = np.searchsorted(often, some)
        hit = (often[np.minimum(at, len(often) - 1)] == some) if len(often) else np.zeros(len(some), bool)
        hit |= np.unpackbits(np.frombuffer(shared, np.uint8), count=len(some)).astype(bool)
        if hit.any():
            out.append((chunk, key[0].as_py(), zstandard.compress(np.packbits(hit).tobytes())))
    return _table(out, chunk=pa.int32(), bucket=pa.int32(), mask=pa.binary())


def _wanted(chunk: _Chunk, masks: pa.Table, buckets: int) -> list[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Per bucket the distinct contexts of repeated grams, the least id that has each, place in it, and (run, context) pairs.

    The context of a run are the bytes that its strings span. Both passes over a chunk get the
    same order.
    """
    gram, _, bucket, number = chunk.grams(buckets)
    hit = np.zeros(len(gram), bool)
    spans = dict(_ranges(bucket))
    for b, mask in zip(masks["bucket"].to_pylist(), masks["mask"].to_pylist()):
        i, j = spans[b]
        hit[i:j] = np.unpackbits(np.frombuffer(zstandard.decompress(mask), np.uint8), count=j - i).astype(bool)
    runs = np.flatnonzero(hit[number]) if len(number) else np.empty(0, np.int64)
    runs = runs[np.argsort(bucket[number[runs]], kind="stable")]
    data, out = chunk.data.tobytes(), []
    for b, (i, j) in _ranges(bucket[number[runs]]):
        seen: dict[tuple[int, bytes], int] = {}
        which = np.empty(j - i, np.int64)
        docs: list[int] = []
        for k, run in enumerate(runs[i:j].tolist()):
            first = chunk.first[run]
            context = (int(chunk.place[run] - first), data[first : chunk.last[run] + LENGTH])
            number_of = seen.setdefault(context, len(seen))
            which[k] = number_of
            if number_of == len(docs):
                docs.append(chunk.doc_ids[chunk.text[run]])  # texts are in order of id, so the first is the least
        out.append((b, [c for _, c in seen], np.array(docs, np.int64), np.array([p for p, _ in seen], np.int64), np.stack([runs[i:j], which])))
    return out


def _contexts(key: tuple[pa.Scalar, ...], table: pa.Table, masks: pa.Table, buckets: int) -> pa.Table:
    if not masks.num_rows or not table.num_rows:
        return _table([], bucket=pa.int32(), chunk=pa.int32(), docs=pa.binary(), sizes=pa.binary(), places=pa.binary(), bytes=pa.binary())
    pack = zstandard.ZstdCompressor(level=3).compress
    out = []
    for b, contexts, docs, places, _ in _wanted(_Chunk(table), masks, buckets):
        sizes = np.array([len(c) for c in contexts], "<i4")
        out.append((b, key[0].as_py(), pack(docs.astype("<i8").tobytes()), pack(sizes.tobytes()), pack(places.astype("<i4").tobytes()), pack(b"".join(contexts))))
    return _table(out, bucket=pa.int32(), chunk=pa.int32(), docs=pa.binary(), sizes=pa.binary(), places=pa.binary(), bytes=pa.binary())


def least_ids(data: np.ndarray, begin: np.ndarray, offset: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For suffixes of LENGTH bytes from ``begin`` the least id of an equal one with equal ``offset``.

    Suffixes are sorted by three ranks, which cover their bytes: ranks are hashes of GRAM bytes,
    worked out once for all places, so a long tie costs three comparisons. Then each suffix is held against the
    first of its group by its bytes; a group that the ranks joined wrongly is settled by bytes alone.
    ``ids`` must ascend.
    """
    rank = np.concatenate([_gram_hashes(data[i : i + STEP + GRAM - 1]) for i in range(0, len(data) - GRAM + 1, STEP)])
    key = rank[begin] * np.uint64(3)
    key ^= rank[begin + GRAM] * np.uint64(0xD6E8FEB86659FD93)
    key += rank[begin + LENGTH - GRAM] ^ (offset.astype(np.uint64) << np.uint64(48))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(begin), np.int64)
    out[order] = ids[head]
    words = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
    wrong = []
    for i in range(0, len(order), STEP):
        a, b = order[i : i + STEP], head[i : i + STEP]
        a, b = a[a != b], b[a != b]
        differ = offset[a] != offset[b]
        for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            differ |= words[begin[a] + at] != words[begin[b] + at]
        wrong.append(b[differ])
    for first in np.unique(np.concatenate(wrong)) if wrong else []:
        best: dict[tuple[int, bytes], int] = {}
        for m in np.sort(order[head == first]).tolist():
            out[m] = best.setdefault((int(offset[m]), data[begin[m] : begin[m] + LENGTH].tobytes()), int(ids[m]))
    return out


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For every string of every context of a bucket the least id that has it."""
    unpack = zstandard.ZstdDecompressor().decompress
    seen: dict[tuple[int, bytes], int] = {}
    least: list[int] = []
    rows = []
    for docs, sizes, places, data in zip(*(table[c].to_pylist() for c in ("docs", "sizes", "places", "bytes"))):
        data, at, which = unpack(data), 0, []
        for doc, size, place in zip(np.frombuffer(unpack(docs), "<i8").tolist(), np.frombuffer(unpack(sizes), "<i4").tolist(), np.frombuffer(unpack(places), "<i4").tolist()):
            n = seen.setdefault((place, data[at : at + size]), len(seen))
            at += size
            which.append(n)
            if n == len(least):
                least.append(doc)
            elif doc < least[n]:
                least[n] = doc
        rows.append(np.array(which, np.int64))
    by_id = np.argsort(np.array(least, np.int64), kind="stable")
    contexts = list(seen)
    contexts = [contexts[i] for i in by_id.tolist()]
    size = np.array([len(c) for _, c in contexts], np.int64)
    place = np.array([p for p, _ in contexts], np.int64)
    data = np.frombuffer(b"".join(c for _, c in contexts), np.uint8)
    count = size - LENGTH + 1
    ends = np.cumsum(count)
    context = np.repeat(np.arange(len(size)), count)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
    found = least_ids(data, (np.cumsum(size) - size)[context] + inside, place[context] - inside + LENGTH, np.array(least, np.int64)[by_id][context])
    position = np.empty(len(by_id), np.int64)
    position[by_id] = np.arange(len(by_id))
    out, pack = [], zstandard.ZstdCompressor(level=1).compress
    for chunk, which in zip(table["chunk"].to_pylist(), rows):
        which = position[which]
        n = count[which]
        at = np.repeat((ends - count)[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append((chunk, key[0].as_py(), pack(found[at].astype("<i8").tobytes())))
    return _table(out, chunk=pa.int32(), bucket=pa.int32(), least=pa.binary())


def _removed(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Removed and kept bytes of the texts of a chunk."""
    if not table.num_rows:
        return _table([], digest=pa.binary(), doc_id=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string())
    chunk = _Chunk(table)
    masks = pa.table({"bucket": replies["bucket"], "mask": replies["mask"]})
    least = {b: np.frombuffer(zstandard.decompress(x), "<i8") for b, x in zip(replies["bucket"].to_pylist(), replies["least"].to_pylist())}
    hit = np.zeros(len(chunk.data) + LENGTH, bool)
    ids = np.array(chunk.doc_ids, np.int64)
    for b, contexts, _, _, pairs in _wanted(chunk, masks, buckets) if masks.num_rows else []:
        count = np.array([len(c) - LENGTH + 1 for c in contexts])
        offset = np.cumsum(count) - count
        run, which = pairs
        n = count[which]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found = least[b][np.repeat(offset[which], n) + inside]
        string = (np.repeat(chunk.first[run], n) + inside)[found < np.repeat(ids[chunk.text[run]], n)]
        hit[string + LENGTH] = True
    # a byte is covered if one of the LENGTH strings up to it is hit
    hits = np.cumsum(hit, dtype=np.int32)
    gone = hits[LENGTH:] > hits[:-LENGTH]
    out = []
    for digest, doc_id, i, j in zip(chunk.digests, chunk.doc_ids, chunk.starts.tolist(), chunk.ends.tolist()):
        some = gone[i:j]
        spans = int(np.count_nonzero(some[1:] & ~some[:-1])) + int(some[0]) if j > i else 0
        out.append((digest, doc_id, j - i, int(some.sum()), spans, hashlib.sha256(chunk.data[i:j][~some].tobytes()).hexdigest()))
    return _table(out, digest=pa.binary(), doc_id=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of 50 bytes over it also starts in a row with a smaller id. Strings are those
    of the input, they do not cross rows, and overlaps count.

    Equal texts are one text with their least id; the other copies of 50 bytes or more go whole.
    Chunks of texts find their cover positions: a place for every string, chosen by content. The
    grams there go to buckets, which answer what occurs more than once. For these places chunks
    send the bytes that their strings span, equal ones once with the least id, to the same
    buckets. A bucket sorts its suffixes and returns the least id of each string, and chunks mark
    what is covered by a string of a smaller id. A bucket is sorted by one task at a time, and its size is
    bounded in bytes of text, so memory does not grow with the corpus.

    Null and empty texts have no bytes. Rows with a null id match nothing and keep all. Rows equal in id and text
    get equal results. Other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = narrow.select("doc_id", _pack("text").alias("p")).select("doc_id", "p.*")
    rows = materialize(packed.select("doc_id", "digest", "n_bytes"), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0]
    chunks, buckets = parts(total, CHUNK), parts(total, BUCKET)
    texts = packed.filter("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "packed")).alias("t"))
    texts = texts.select(F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int").alias("chunk"), F.col("t.doc_id").alias("doc_id"), "digest", F.col("t.packed").alias("packed"))
    texts = bucketed(texts, "texts", "chunk", min(chunks, 4096))

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _anchors(key, table, buckets)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        return _contexts(key, table, found, buckets)

    def mark(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return _removed(key, table, replies, buckets)

    anchors = texts.groupBy("chunk").applyInArrow(find, ANCHORS)
    masks = materialize(anchors.groupBy("bucket").applyInArrow(_masks, MASKS), "masks")
    contexts = texts.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(send, CONTEXTS)
    answers = materialize(contexts.groupBy("bucket").applyInArrow(_answers, ANSWERS), "answers")
    replies = masks.join(answers, ["chunk", "bucket"])
    result = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(mark, RESULT)
    result = materialize(result, "texts-kept").withColumnRenamed("doc_id", "least_id")

    out = rows.join(as_lookup(result.drop("n_bytes")), "digest", "left")
    # of a null id no text was handled on its own account: it keeps all of its bytes
    copy = F.coalesce((F.col("doc_id") > F.col("least_id")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    nothing = F.sha2(F.lit(b""), 256)
    return out.select(
        F.col("doc_id").alias(id_col), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
