"""Periodic runs of words: suffix classes united by falling LCP, neighbours that come closer than the LCP seed runs."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 17  # words of short documents looked at together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.binary())])
MIX = np.uint64(0x9E3779B97F4A7C15)


def rank_levels(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4, ... elements that start at each place, until all differ. The end comes before any element."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels = [rank.astype(np.int32)]
    step = 1
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        step *= 2
    return levels


def common_lengths(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements the suffixes at two different places share. Equal ranks of a level cannot reach beyond the end."""
    n, shared = len(levels[0]), np.zeros(len(left), np.int64)
    for k in reversed(range(len(levels))):
        a, b = left + shared, right + shared
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        shared[same] += 1 << k
    return shared


class Classes:
    """Union-find over places, each class with its places in order."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.places: dict[int, list[int]] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def unite(self, x: int, y: int) -> list[tuple[int, int]]:
        """Join two classes; the pairs of places that are neighbours now and were in different classes."""
        a, b = self.find(x), self.find(y)
        large, small = self.places.pop(a, None) or [a], self.places.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        self.parent[b] = a
        spots = [bisect_left(large, p) for p in small]
        pairs, last = [], len(small) - 1
        for i, (p, at) in enumerate(zip(small, spots)):
            if at > 0 and (i == 0 or spots[i - 1] < at):
                pairs.append((large[at - 1], p))
            if at < len(large) and (i == last or spots[i + 1] > at):
                pairs.append((p, large[at]))
        if len(small) * 16 < len(large):
            for p, at in zip(reversed(small), reversed(spots)):
                large.insert(at, p)
        else:
            large = sorted(large + small)
        self.places[a] = large
        return pairs


def least_shared(min_exponent: int, min_length: int) -> int:
    """Fewest elements that the suffixes at a run's start and one period on share, over all periods."""
    return min(max((min_exponent - 1) * p, min_length - p) for p in range(1, max(2, min_length)))


def find_runs(ids: np.ndarray, min_exponent: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period) of at least that length and that many periods, by start, then period.

    Places i < j that share d = j - i elements or more, and have no place between them in their class, begin
    a stretch of smallest period d. They become neighbours when their classes unite, at the length they share.
    All places of a run seed it with the same end, and its start is the least of them.
    """
    n, least = len(ids), least_shared(min_exponent, min_length)
    if n < min_length:
        return []
    levels = rank_levels(ids)
    order = np.argsort(levels[-1])
    shared = common_lengths(levels, order[:-1], order[1:])
    del levels
    kept = np.flatnonzero(shared >= least)
    kept = kept[np.argsort(-shared[kept], kind="stable")]
    classes, starts = Classes(), {}
    for x, y, level in zip(order[kept].tolist(), order[kept + 1].tolist(), shared[kept].tolist()):
        for i, j in classes.unite(x, y):
            period = j - i
            if period * (min_exponent - 1) <= level and period + level >= min_length:
                key = (j + level, period)
                starts[key] = min(i, starts.get(key, i))
    return sorted((start, end - start, period) for (end, period), start in starts.items())


def repeating(ids: list[np.ndarray], width: int) -> np.ndarray:
    """Which sequences hold some ``width`` elements twice, by hashes: one that does is never left out."""
    sizes = np.array([len(x) for x in ids], np.int64)
    number = np.repeat(np.arange(len(ids)), sizes)
    values = np.concatenate(ids).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    out = np.zeros(len(ids), bool)
    if len(values) <= width:
        return out
    count = len(values) - width + 1
    with np.errstate(over="ignore"):
        key = number[:count].astype(np.uint64) * MIX
        for i in range(width):
            key = (key ^ values[i : i + count]) * MIX
            key ^= key >> np.uint64(29)
    whole = number[:count] == number[width - 1 :]
    key, owner = key[whole], number[:count][whole]
    by_key = np.argsort(key, kind="stable")
    twice = np.flatnonzero((np.diff(key[by_key]) == 0) & (np.diff(owner[by_key]) == 0))
    out[owner[by_key[twice]]] = True
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those of a run that follow its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _slices(texts: pa.Array):
    """Word lists of consecutive documents, cut where a slice holds ``SLICE`` words."""
    held, size = [], 0
    for text in texts.cast(pa.binary()):
        held.append((text.as_py() or b"").split())  # splits at ASCII white space alone
        size += len(held[-1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    yield held


def periodic_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic", min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """The rows of ``docs`` with a column ``out``: ``runs`` of words (start, length, period) and the ``collapsed`` text.

    Words are runs of anything but ASCII white space, numbered from 0. Runs are maximal, have their smallest period,
    at least ``min_exponent`` (2 or more) of it and at least ``min_length`` words, and come by start, then period.
    ``collapsed`` (UTF-8 bytes) joins by spaces the words that no run holds after its first period.
    Null and empty texts have no runs and collapse to nothing; repeated rows are treated each; a column named ``out``
    is replaced. No row leaves its task. A text of n words takes O(n log n) memory there, 4 bytes a word and level.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    width = max(1, least_shared(min_exponent, min_length))

    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>")
    def find(texts: pa.Array) -> pa.Array:
        runs, kept = [], []
        for documents in _slices(texts):
            ids = [_numbered(words) for words in documents]
            for words, numbers, again in zip(documents, ids, repeating(ids, width)):
                found = find_runs(numbers, min_exponent, min_length) if again else []
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(collapsed(words, found))
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary())], fields=list(FOUND))

    return docs.withColumn(out, find(F.col(text_col)))


def run_digests(found: DataFrame, id_col: str = "doc_id", runs: str = "periodic") -> DataFrame:
    """Per row of :func:`periodic_runs`: the number of runs, the longest of them, and digests of runs and collapsed text."""
    every, blank = F.col(f"{runs}.runs"), F.lit(None).cast("long")
    lines = F.transform(every, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    # the greatest of these has the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform(every, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select(F.col(id_col).alias("doc_id"), F.size(every).cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), F.col(f"{runs}.collapsed").alias("text"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        F.col("doc_id").alias(id_col), "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.when(F.col("best").isNull(), blank).otherwise(F.floor(F.lit(1000) * length / period)).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
