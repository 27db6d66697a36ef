"""Exact top-k by inner product through distributed selection on score histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import materialize, parts
from tallybook.session import as_lookup

SCALE = 1024
REACH = 1 << 62  # scores beyond which they are not sure to fit a long; such vectors fail the search
VECTORS, QUERIES = 8192, 512  # most rows of a cell: a block of vectors meets a block of queries
SLICE = 2048  # vectors of a block that are scored at once
BITS = 9  # of a score that one round of histograms settles


def scaled(vector: str | Column) -> Column:
    """floor(1024 * x) of every component as doubles; null for vectors that take no part.

    Out are null and empty vectors and those with a null or non-finite component.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # the product of a float and 1024 is exact, so floor() on doubles loses nothing
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer products; through doubles where they are exact, else in 64 bits, where sums that fit are right even if parts of them wrap around."""
    bound = (np.abs(vectors).max(initial=0) or 1) * (np.abs(queries).max(initial=0) or 1) * vectors.shape[1]
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def _dealt(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int) -> DataFrame:
    """Cells of one block of vectors and one block of queries, each row carrying its side.

    Both sides are dealt by hash; a vector goes once to each block of queries and a query
    once to each block of vectors, so a cell holds a bounded number of rows and no task more. Vectors
    meet queries of their own length only.
    """
    v, q = parts(n_vectors, VECTORS), parts(n_queries, QUERIES)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select(
        block("row", v).alias("v_block"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("q_block"), F.lit(False).alias("is_query"),
        F.col("vec_id").alias("id"), "values", F.size("values").alias("d"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"),
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(v - 1))).alias("v_block"), block("query_id", q).alias("q_block"), F.lit(True).alias("is_query"),
        F.col("query_id").alias("id"), "values", F.size("values").alias("d"), "low", "high",
    )
    return left.unionByName(right).groupBy("d", "v_block", "q_block")


def _sides(cell: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    asks = cell["is_query"].to_numpy()
    return cell[~asks], cell[asks]


def top_k(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best scores of every query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with
    another id. Scores are integer inner products of ``scaled`` vectors; ties go to the
    smaller id. All pairs are scored in cells. Each round histograms the scores inside the
    range where a query's kth score lies, narrows that range to one bin, and after the last round the
    range is one value. A cell reports only bins from the top down to its own kth
    score, as the global kth is never below it. Then scores over the threshold are taken,
    and ties at it in order of id.

    Vectors that ``scaled`` leaves out and rows with a null id take no part, vectors of another length than
    a query's are no candidates of it. Vectors so large that a score might not fit a long raise OverflowError. A query id that occurs several times is one query, with
    its least vector; repeated candidates are ranked each. Other columns are ignored.
    """
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), scaled(vector_col).alias("values")).filter("vec_id is not null and values is not null")
    vectors = materialize(usable.withColumn("row", F.xxhash64("vec_id", "values")), "vectors")
    asked = vectors.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("values").alias("values"))
    asked = materialize(asked, "queries")
    squared = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x * x)
    n_vectors, longest = vectors.agg(F.count("*"), F.max(squared)).first()
    n_queries = asked.count()
    # no product of two vectors is larger than the square of the longest; a little is added, as the sum is rounded
    if (longest or 0) >= REACH // 2:
        raise OverflowError("inner products of these vectors may not fit a long")
    reach = int((longest or 0) * (1 + 1e-9)) + 1
    rounds = parts((2 * reach + 1).bit_length(), BITS)
    low = -(1 << (rounds * BITS - 1)) - 1
    state = asked.select("query_id", F.lit(low).cast("long").alias("low"), F.lit(-low).cast("long").alias("high"), F.lit(k).cast("long").alias("missing"))

    for step in range(rounds):
        width = 1 << ((rounds - 1 - step) * BITS)

        def histogram(cell: pd.DataFrame) -> pd.DataFrame:
            vectors, queries = _sides(cell)
            if not len(vectors) or not len(queries):
                return pd.DataFrame({"query_id": [], "bin": [], "n": []})
            q, own, ids = _matrix(queries["values"]), queries["id"].to_numpy(), vectors["id"].to_numpy()
            lows, highs = queries["low"].to_numpy(np.int64), queries["high"].to_numpy(np.int64)
            counts: list[dict[int, int]] = [{} for _ in own]
            for i in range(0, len(ids), SLICE):
                scores = _scores(_matrix(vectors["values"].iloc[i : i + SLICE]), q)
                others = ids[None, i : i + SLICE] != own[:, None]
                for j, line in enumerate(scores):
                    line = line[others[j] & (line >= lows[j]) & (line < highs[j])]
                    if len(line) > k:
                        line = np.partition(line, len(line) - k)[len(line) - k :]
                    for b in ((line - lows[j]) // width).tolist():
                        counts[j][b] = counts[j].get(b, 0) + 1
            found = []
            for query, bins in zip(own.tolist(), counts):
                seen = 0
                for b in sorted(bins, reverse=True):
                    if seen >= k:
                        break
                    seen += bins[b]
                    found.append((query, b, bins[b]))
            return pd.DataFrame(found, columns=["query_id", "bin", "n"])

        asks = asked.join(state, "query_id")
        bins = _dealt(vectors, asks, n_vectors, n_queries).applyInPandas(histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        level = bins.withColumn("upto", F.sum("n").over(from_top)).join(state.select("query_id", "low", "missing"), "query_id")
        kth = level.filter("upto >= missing and upto - n < missing").select(
            "query_id", (F.col("low") + F.col("bin") * width).alias("new_low"), (F.col("missing") - F.col("upto") + F.col("n")).alias("left")
        )
        # a query with fewer candidates than k keeps its whole range
        state = materialize(
            state.join(as_lookup(kth), "query_id", "left").select(
                "query_id", F.coalesce("new_low", "low").alias("low"),
                F.when(F.col("new_low").isNotNull(), F.col("new_low") + width).otherwise(F.col("high")).alias("high"), F.coalesce("left", "missing").alias("missing"),
            ),
            "kth",
        )

    def winners(cell: pd.DataFrame) -> pd.DataFrame:
        vectors, queries = _sides(cell)
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("id", kind="stable")
            ids, q = vectors["id"].to_numpy(), _matrix(queries["values"])
            best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
            for i in range(0, len(ids), SLICE):
                scores, some = _scores(_matrix(vectors["values"].iloc[i : i + SLICE]), q), ids[i : i + SLICE]
                for j, (own, least) in enumerate(zip(queries["id"], queries["low"])):
                    at = np.flatnonzero((scores[j] >= least) & (some != own))
                    order = at[np.argsort(-scores[j][at], kind="stable")[:k]]
                    best[j] = sorted(best[j] + [(-int(scores[j][a]), int(some[a])) for a in order])[:k]
            for own, found in zip(queries["id"], best):
                out += [(own, i, -s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    asks = asked.join(state.select("query_id", "low", "high"), "query_id")
    found = _dealt(vectors, asks, n_vectors, n_queries).applyInPandas(winners, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
