"""Near duplicates of vectors: cross-polytope hashing after fast Hadamard rotations, with probing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import materialize
from tallybook.llm.graph import components
from tallybook.session import as_lookup

COSINE = 0.98
TABLES, PROBES = 10, 4
LEAST_HASHES, MOST_HASHES = 2, 6  # joined in a table; the number grows with the rows, so that buckets stay small
CELL = 512
SMALL = 48  # rows of a cell up to which cells of one size are compared together
PAIRS = 40_000  # pairs compared at once
SEED = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width = x.shape[1], 1
    while width < n:
        pairs = x.reshape(len(x), n // (2 * width), 2, width)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x / np.sqrt(n)


def hashes_for(rows: int, d: int) -> int:
    """How many hashes a table joins, so that it has about as many buckets as rows are put into it."""
    return min(MOST_HASHES, max(LEAST_HASHES, math.ceil(math.log(max(2, rows * PROBES)) / math.log(2 * _wide(d)))))


def _wide(d: int) -> int:
    """The power of two to which vectors are filled up."""
    return 1 << max(1, (d - 1).bit_length())


def codes(vectors: np.ndarray, hashes: int) -> np.ndarray:
    """Bucket codes of unit vectors: (rows, tables, probes), the own bucket first.

    A hash turns the vector by three rounds of random signs and a Hadamard transform and
    names the nearest of the 2d axis directions. A table joins ``hashes`` of them. The
    further probes change the hash where the runner-up direction comes closest.
    """
    rows, d = vectors.shape
    wide = _wide(d)
    rng = np.random.default_rng(SEED)
    out = np.empty((rows, TABLES, PROBES), np.int64)
    at = np.arange(rows)
    for t in range(TABLES):
        first, second, loss = [], [], []
        for _ in range(hashes):
            y = np.zeros((rows, wide))
            y[:, :d] = vectors
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            size = np.abs(y)
            best = size.argmax(axis=1)
            top = size[at, best]
            size[at, best] = -1
            runner = size.argmax(axis=1)
            name = lambda axis: 2 * axis + (y[at, axis] < 0)  # noqa: B023, E731
            first.append(name(best))
            second.append(name(runner))
            loss.append(top - size[at, runner])
        # every choice of best or runner-up per hash, cheapest first
        choices = np.arange(1 << hashes)
        cost = sum(np.outer(loss[h], choices >> h & 1) for h in range(hashes))
        order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        code = np.zeros((rows, order.shape[1]), np.int64)
        for h in range(hashes):
            code = code * (2 * wide) + np.where(order >> h & 1, second[h][:, None], first[h][:, None])
        out[:, t] = code
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length, without overflow for very large or small components."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


HASHED = pa.struct([("codes", pa.list_(pa.int64())), ("code_bytes", pa.binary()), ("unit", pa.binary())])


def hashed(values: Column, rows: int) -> Column:
    """All codes of a vector, table by table, also as bytes, and the vector at length one as bytes. Lengths may differ between rows."""

    @F.arrow_udf("struct<codes:array<bigint>,code_bytes:binary,unit:binary>")
    def hash_all(batch: pa.Array) -> pa.Array:
        sizes, flat = np.diff(batch.offsets.to_numpy()), batch.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        out: list[dict | None] = [None] * len(batch)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            vectors = unit(flat[starts[at][:, None] + np.arange(d)].astype(np.float64))
            found = codes(vectors, hashes_for(rows, int(d))).reshape(len(at), -1)
            for i, line, vector in zip(at.tolist(), found, vectors):
                out[i] = {"codes": line, "code_bytes": line.tobytes(), "unit": vector.tobytes()}
        return pa.array(out, HASHED)

    return hash_all(values)


def _owned(a: np.ndarray, b: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether its bucket is the first one where the vectors of a pair meet.

    They meet in a bucket that both probe and that is the own bucket of one. ``a`` and
    ``b`` are (pairs, tables, probes).
    """
    of_a = (a[:, :, :1] == b).any(axis=2)
    of_b = (b[:, :, :1] == a).any(axis=2)
    first = (of_a | of_b).argmax(axis=1)
    at = np.arange(len(a))
    far = np.iinfo(np.int64).max
    chosen = np.minimum(np.where(of_a[at, first], a[at, first, 0], far), np.where(of_b[at, first], b[at, first, 0], far))
    return (first == table) & (chosen == code)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of each cell, some at a time: cells of one small size together, a large one by slices."""
    for size in np.unique(sizes[sizes <= SMALL]):
        x, y = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, PAIRS // max(1, len(x)))
        for k in range(0, len(own), step):
            some = own[k : k + step, None]
            yield (some + x).ravel(), (some + y).ravel()
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        step = max(1, PAIRS // size)
        for k in range(0, size, step):
            x, y = np.nonzero(np.arange(k, min(k + step, size))[:, None] < np.arange(size))
            yield start + k + x, start + y


def _least_linked(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row it is linked with, directly or over others."""
    least = np.arange(n)
    while len(x):
        low = np.minimum(least[x], least[y])
        before = least.copy()
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]
        if (least == before).all():
            break
    return least


class Cells:
    """Whole cells of one vector length, row after row: verified pairs, counted, and what holds them together."""

    def __init__(self, rows: pa.Table) -> None:
        number = lambda c: rows[c].to_numpy()
        joined = lambda c: np.frombuffer(b"".join(rows[c].to_pylist()), np.float64 if c == "unit" else np.int64)
        self.node, self.members, self.own, self.table, self.code = (number(c) for c in ("node", "members", "own", "table", "code"))
        self.across = number("i") != number("j")
        self.unit, self.codes = joined("unit").reshape(len(rows), -1), joined("code_bytes").reshape(len(rows), TABLES, -1)

    def links(self, starts: np.ndarray, sizes: np.ndarray) -> pa.Table:
        linked, xs, ys = np.zeros(len(self.node), np.int64), [], []
        for x, y in _pairs(starts, sizes):
            fit = np.flatnonzero(~self.across[x] | (self.own[x] != self.own[y]))
            x, y = x[fit], y[fit]
            near = np.einsum("ij,ij->i", self.unit[x], self.unit[y]) >= COSINE
            x, y = x[near], y[near]
            new = _owned(self.codes[x], self.codes[y], self.table[x], self.code[x])
            x, y = x[new], y[new]
            np.add.at(linked, x, self.members[y])
            np.add.at(linked, y, self.members[x])
            xs.append(x)
            ys.append(y)
        some = np.flatnonzero(linked)
        least = _least_linked(np.concatenate(xs), np.concatenate(ys), len(linked)) if len(some) else np.arange(len(linked))
        to = [None if v == u else v for u, v in zip(self.node[some].tolist(), self.node[least[some]].tolist())]
        return pa.table({"u": pa.array(self.node[some]), "v": pa.array(to, pa.int64()), "n": pa.array(linked[some])})


KEY = ["d", "kind", "table", "code", "i", "j"]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the sorted cells of a task; a cell that a batch cuts off waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in KEY])
        turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        cut = int(turns[-1]) if len(turns) else 0
        held = rows.slice(cut).to_batches()
        if cut:
            yield from _settled(rows.slice(0, cut), turns[:-1], keys[0, :cut])
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from _settled(rows, np.empty(0, np.int64), rows["d"].to_numpy())


def _settled(rows: pa.Table, turns: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The links of whole cells, those of one vector length at a time. ``turns`` are the rows where another cell begins."""
    bounds = np.concatenate([[0], turns, [len(rows)]])
    stretches = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(rows)]])
    for a, b in zip(stretches[:-1].tolist(), stretches[1:].tolist()):
        starts = bounds[(bounds >= a) & (bounds < b)]
        sizes = np.diff(np.append(starts, b))
        yield from Cells(rows.slice(a, b - a)).links(starts - a, sizes).to_batches()


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label are linked at a cosine of 0.98 or more, worked out in double
    precision for all pairs that meet in a bucket. Rows with equal label and vector form one node and
    are linked with each other. ``n_links`` counts linked rows, so copies count each. A
    bucket of many nodes is cut into blocks; every pair of blocks is a cell of its own. Cells are sorted, and a task compares many of them at once.
    A pair that meets in several buckets is counted in the first one only. Cells return counts and, for each
    row, the least row it hangs together with, never all pairs. Tables join more hashes the more rows there are.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows
    with a null label or id, link with nothing: no links, their own id as component.
    Vectors of different lengths never meet. Other columns are ignored.
    """
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("values"), F.col(label_col).alias("label"))
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("values").isNotNull() & ~bad & F.exists("values", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plain = F.transform("values", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are one value
    node = F.when(fit, F.sha2(F.to_json(F.struct("label", plain.alias("values"))), 256))
    named = materialize(base.select("vec_id", "label", node.alias("node"), F.when(fit, plain).alias("values")), "vectors")
    usable = named.filter("node is not null")
    nodes = usable.groupBy("node").agg(F.count("*").alias("members"), F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("values").alias("values"))
    hashes = hashed(F.col("values"), named.count())
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), F.col("node").alias("digest"), "members", "vec_id", "label", F.size("values").alias("d"), hashes.alias("h"))
    nodes = materialize(nodes.select("node", "digest", "members", "vec_id", "label", "d", "h.*"), "nodes")

    probes = nodes.select("node", "label", "d", F.posexplode("codes").alias("at", "code")).select(
        "node", "label", "d", F.floor(F.col("at") / PROBES).cast("int").alias("table"), (F.col("at") % PROBES == 0).alias("home"), "code"
    )
    bucket = ["label", "d", "table", "code"]
    shared = probes.groupBy(*bucket).agg(F.count("*").alias("n"), F.max("home").alias("homes")).filter("n > 1 and homes").select(*bucket, F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    met = probes.join(as_lookup(shared), bucket).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "d", F.xxhash64("label").alias("kind"), "table", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"
    )
    cells = cells.join(nodes.select("node", "members", "unit", "code_bytes"), "node")
    found = materialize(cells.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_verify, "u long, v long, n long"), "found")

    links = found.filter("v is not null").select("u", "v")
    # an id that carries several vectors holds their nodes together
    numbered = nodes.select("node", "digest")
    rows_of = usable.select("vec_id", F.col("node").alias("digest")).join(as_lookup(numbered), "digest")
    twice = rows_of.groupBy("vec_id").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v <> most")
    same_id = rows_of.join(as_lookup(twice), "vec_id").select(F.col("node").alias("u"), "v").distinct()
    final = components(links.unionByName(same_id))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    placed = nodes.select("node", "digest", "vec_id", "members").join(as_lookup(final), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    ids = placed.join(as_lookup(least), "component").join(as_lookup(counts), "node", "left")
    ids = materialize(ids.select(F.col("digest").alias("node"), "component_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "ids")
    out = named.select("vec_id", "node").join(as_lookup(ids), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
