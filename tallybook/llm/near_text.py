"""Near duplicates of texts: universal hash minima, banding, signature check, full sets, components."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import bucketed, materialize
from tallybook.llm.graph import components
from tallybook.llm.near_vectors import _pairs
from tallybook.session import as_lookup

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at 0.75 shares no band with a chance of 6 in a million
MINIMA = BANDS * ROWS
SURE = 0.59  # share of equal minima below which a pair is not looked at: 4 standard errors under 0.75
STAR = 64  # nodes of a sub-group of a bucket that are held against one of them
CELL = 256  # nodes of a bucket that meet in one cell
STEPS = (0, 2, 8, BANDS)  # bands whose buckets are held against a few of their nodes, step by step
MOST, ROUNDS = 2, 3  # partners of each node in a round before all pairs are looked at, and such rounds

_rng = np.random.default_rng(20240501)
A = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
W = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("minima", T.BinaryType())])


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        mixed += each[i : len(each) - SHINGLE + 1 + i] * W[i]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima_of(hashes: np.ndarray) -> np.ndarray:
    """Least value of each universal hash function over a set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        spread = A[:, None] * hashes[None, i : i + 256]
        spread += B[:, None]
        np.minimum(least, spread.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


@F.pandas_udf(FEATURES)
def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            words = words_of(text) if text else []
            hashes = shingles_of(words)
            node = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
            rows.append((len(hashes), node, minima_of(hashes).tobytes() if words else None))
        yield pd.DataFrame(rows, columns=FEATURES.names)


@F.pandas_udf(T.BinaryType())
def pack_text(texts: pd.Series) -> pd.Series:
    coder = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: coder.compress(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.BinaryType())
def full_set(packed: pd.Series) -> pd.Series:
    coder = zstandard.ZstdDecompressor()
    return packed.map(lambda z: shingles_of(coder.decompress(z).lower().split()).tobytes())


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Signature check: enough equal minima."""
    same = [np.count_nonzero(np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")) for x, y in zip(a, b)]
    return pd.Series(np.array(same, float) >= SURE * MINIMA)


@F.pandas_udf(T.BooleanType())
def confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    """Full sets are alike: 100 * intersection >= 75 * union."""
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _sizes_allow(a: str, b: str) -> Column:
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _stars(met: DataFrame) -> DataFrame:
    """Pairs of different components that hold the nodes of each bucket against a few of them.

    A bucket is dealt into sub-groups of about ``STAR`` nodes by hash, each node is paired with the least
    hash of its sub-group, and these again, level by level, until one is left. Sub-groups differ
    from bucket to bucket, so a node meets several others.
    """
    sizes = met.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    level = met.join(as_lookup(sizes), "bucket").select("bucket", "node", "component", F.greatest(F.lit(0), F.ceil(F.log2(F.col("members") / STAR))).cast("int").alias("bits"))
    depth = level.agg(F.max("bits")).first()[0] or 0
    fewer = STAR.bit_length() - 1
    pairs = None
    for step in range(depth // fewer + 2):
        dealt = level.withColumn("part", F.pmod(F.xxhash64("bucket", "node", F.lit(step)), F.pow(F.lit(2.0), F.col("bits")).cast("long")))
        centres = dealt.groupBy("bucket", "part").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node"), F.col("component"))).alias("c"), F.first("bits").alias("bits"))
        centres = materialize(centres.select("bucket", "part", "bits", F.col("c.node").alias("v"), F.col("c.component").alias("other")), "centres")
        met_here = dealt.join(as_lookup(centres.select("bucket", "part", "v", "other")), ["bucket", "part"]).filter("component <> other").select(F.col("node").alias("u"), "v").distinct()
        pairs = met_here if pairs is None else pairs.unionByName(met_here)
        level = centres.filter("bits > 0").select("bucket", F.col("v").alias("node"), F.col("other").alias("component"), F.greatest(F.lit(0), F.col("bits") - fewer).alias("bits"))
        if step * fewer >= depth:
            break
    return pairs.distinct()


def _best(x: np.ndarray, y: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` best of one of their rows."""
    ends, scores, pair = np.concatenate([x, y]), np.concatenate([score, score]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((pair, -scores, ends))
    first = np.searchsorted(ends[order], ends[order])
    return np.unique(pair[order[np.arange(len(order)) - first < most]])


def _candidates(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray, most: int | None) -> pa.Table:
    """Pairs of each cell that lie in different components and pass the signature check; only the best of each row if ``most`` is given."""
    minima = np.frombuffer(b"".join(rows["minima"].to_pylist()), "<u4").reshape(len(rows), MINIMA)
    component = rows["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    n, own, across = rows["n_shingles"].to_numpy(), rows["own"].to_numpy(), rows["i"].to_numpy() != rows["j"].to_numpy()
    found = [[np.empty(0, np.int64)] * 3]
    for x, y in _pairs(starts, sizes):
        fit = (component[x] != component[y]) & (~across[x] | (own[x] != own[y])) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
        x, y = x[fit], y[fit]
        same = (minima[x] == minima[y]).sum(axis=1)
        near = same >= SURE * MINIMA
        found.append([x[near], y[near], same[near]])
    x, y, same = (np.concatenate(c) for c in zip(*found))
    if most is not None:
        kept = _best(x, y, same, most)
        x, y, same = x[kept], y[kept], same[kept]
    node = rows["node"].combine_chunks()
    return pa.table({"u": node.take(pa.array(x)), "v": node.take(pa.array(y)), "same": pa.array(same, pa.int64())})


def _cells(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of one bucket that lie in different components and pass the signature check.

    A bucket of many nodes is cut into blocks by hash; every pair of blocks is a cell of
    its own, so no task holds a whole bucket. Cells are sorted, and a task compares many small ones at once.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = (
        rows.join(as_lookup(sizes), "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n_shingles", "minima")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([*held, *([batch] if batch is not None else [])]) if held or batch is not None else None
            if table is None or not len(table):
                continue
            table = table.combine_chunks()
            keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            # the last cell may go on in the next batch
            cut = len(table) if batch is None else int(turns[-1]) if len(turns) else 0
            held = table.slice(cut).to_batches()
            if cut:
                starts = np.concatenate([[0], turns[turns < cut]])
                yield from _candidates(table.slice(0, cut), starts, np.diff(np.append(starts, cut)), most).to_batches()

    key = ["bucket", "i", "j"]
    found = spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(walk, "u binary, v binary, same long")
    pairs = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "same").distinct()
    if most is None:
        return pairs.select("u", "v")
    # a node's best of all its cells, of which each has named a few
    ends = pairs.select("u", "v", "same", F.explode(F.array("u", "v")).alias("end"))
    placed = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("same"), "u", "v"))
    return ends.withColumn("place", placed).filter(F.col("place") <= most).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked when their sets of five-word shingles reach a Jaccard similarity of
    0.75; the component is the smallest id reachable by links and ``kept`` marks that id.
    Equal word sequences form one node before anything is compared. Nodes meet in the
    bands of 128 minima. In each bucket nodes are first held against a few of them, then against the few most like them of other components; the
    components of these links leave most buckets with one component. Where
    several remain, all pairs across them are checked. A pair is looked at if it shares a band and 0.59 of its minima: at a
    similarity of 0.75 it fails the first with a chance of 6 in a million, the second of 3 in a hundred thousand.
    Every link is confirmed on full sets (64-bit shingle hashes).

    Null, empty or blank texts have no shingle and link with nothing: their component is
    their own id. Rows with one id and several texts are one node of the graph. A row with
    a null id keeps its text's component, and is kept if it links with nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(base.select("doc_id", features("text").alias("f")).select("doc_id", "f.*"), "features")
    worded = rows.filter("node is not null")
    classes = materialize(worded.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima")), "classes")

    band = lambda i: F.xxhash64(F.lit(i), F.substring("minima", 4 * ROWS * i + 1, 4 * ROWS))
    banded = classes.select("node", F.posexplode(F.array(*[band(i) for i in range(BANDS)])).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = materialize(banded.join(as_lookup(shared.select("bucket")), "bucket"), "met")

    # full sets of the nodes that share a bucket
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = met.select("node").distinct().join(classes, "node").select("node", "doc_id", "n_shingles", "minima")
    texts = base.filter("text is not null and doc_id is not null").select("doc_id", pack_text("text").alias("packed"))
    # a repeated id may carry other texts: the node of a text is looked up by id, then by the text's own digest
    with_text = texts.join(wanted.select("doc_id", "node").distinct(), "doc_id")
    sets = with_text.select("node", full_set("packed").alias("shingles"), own_node("packed").alias("own")).filter("own = node").select("node", "shingles").dropDuplicates(["node"])
    full = bucketed(sets, "shingle_sets", "node", buckets)
    signs = classes.select("node", "n_shingles", "minima")

    def verified(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(full.withColumnsRenamed({"node": "u", "shingles": "set_u"}), "u")
            .join(full.withColumnsRenamed({"node": "v", "shingles": "set_v"}), "v")
            .filter(confirmed("set_u", "set_v"))
            .select("u", "v")
        )

    def checked(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(signs.withColumnsRenamed({"node": "u", "n_shingles": "n_u", "minima": "m_u"}), "u")
            .join(signs.withColumnsRenamed({"node": "v", "n_shingles": "n_v", "minima": "m_v"}), "v")
            .filter(_sizes_allow("n_u", "n_v"))
            .filter(alike("m_u", "m_v"))
            .select("u", "v")
        )

    def still_open(known: DataFrame, met: DataFrame = met) -> DataFrame:
        """Nodes of the buckets that hold several components, with their component."""
        placed = met.join(as_lookup(known), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        several = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
        return placed.join(as_lookup(several), "bucket")

    def joined(known: DataFrame, links: DataFrame) -> DataFrame:
        return components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))

    # a few nodes of each bucket against its other nodes; a large group is mostly joined by the first few bands, and leaves little to the others
    known = classes.select("node", F.col("node").alias("component")).limit(0)
    for first, last in zip(STEPS, STEPS[1:]):
        here = materialize(still_open(known, met.filter(F.col("band").between(first, last - 1))), "here")
        known = joined(known, materialize(verified(checked(_stars(here))), "links"))

    # each open node against the few most like it in other components, which joins most of what belongs together
    left = materialize(still_open(known).join(signs, "node"), "open")
    for _ in range(ROUNDS):
        few = materialize(verified(materialize(_cells(left, MOST), "pairs")), "links")
        if few.isEmpty():
            break
        known = joined(known, few)
        left = materialize(still_open(known).join(signs, "node"), "open")

    # what is open still: all pairs across its components
    more = verified(materialize(_cells(left), "pairs"))

    # ids that carry several texts hold their nodes together
    twice = worded.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v <> most")
    same_id = worded.join(as_lookup(twice), "doc_id").select(F.col("node").alias("u"), "v").distinct()
    final = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(same_id))

    named = classes.select("node", "doc_id").join(as_lookup(final), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("texts"))
    ids = materialize(named.join(as_lookup(least), "component").select("node", "component_id", "texts"), "ids")
    out = rows.select("doc_id", "n_shingles", "node").join(as_lookup(ids), "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


@F.pandas_udf(T.BinaryType())
def own_node(packed: pd.Series) -> pd.Series:
    coder = zstandard.ZstdDecompressor()
    return packed.map(lambda z: hashlib.blake2b(b" ".join(coder.decompress(z).lower().split()), digest_size=16).digest())
