"""Ranked lexical search without random access: lists sorted by impact are read from their tops until every score is settled."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import materialize, parts
from tallybook.session import as_lookup

EACH = 400_000  # postings of a shard of documents
QUERY_ROWS = 200_000  # terms of a block of queries
FAN = 32  # shards whose best documents are compared together
FIRST = 256  # entries read from each list at first; the depth doubles from there
SHARPNESS, WEIGHT, SCALE = 12, 25, 1_000_000_000  # constants of the score: saturation, share of the length, integer scale

# Term characters are all but ASCII marks, controls and spaces; only A-Z are lower-cased. Other bytes of UTF-8 stay.
SEPARATED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
ALL = b""  # stands for the number of terms; no term is empty
COUNTED = pa.struct([("term", pa.binary()), ("tf", pa.int64())])


def term_counts(text: Column) -> Column:
    """The distinct terms of a text with their numbers, and under the empty term the number of all, if there are any."""

    @F.arrow_udf("array<struct<term:binary,tf:bigint>>")
    def count(texts: pa.Array) -> pa.Array:
        ends, terms, counts = [0], [], []
        for one in texts.cast(pa.binary()):
            words = (one.as_py() or b"").translate(SEPARATED).split()
            if words:
                found = Counter(words)
                terms += [ALL, *found]
                counts += [len(words), *found.values()]
            ends.append(len(terms))
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], fields=list(COUNTED))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return count(text)


def settle(lists: list[tuple[int, np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents with the highest scores above 0, equal scores by document number, by reads in impact order.

    Each list is (weight, documents, impacts), impacts falling; a document's score is the sum of weight times impact
    over the lists that hold it. What was read bounds every score from below. A list still open adds at most
    its last value to the documents not met in it, which bounds the scores from above. Reading goes on until no document that
    may belong to the result, or tie with its last place, has bounds that differ.
    """
    lower, at = np.zeros(size, np.int64), 0
    depth = FIRST
    while True:
        unseen, known = 0, np.zeros(size, np.int64)
        for weight, docs, impacts in lists:
            fresh = slice(at, depth)
            lower[docs[fresh]] += weight * impacts[fresh]
            if depth < len(docs):
                bound = weight * int(impacts[depth - 1])
                unseen += bound
                known[docs[:depth]] += bound
        kth = int(np.partition(lower, size - k)[size - k]) if size > k else 0
        if not unseen:
            break
        upper = lower + (unseen - known)
        # a document met in no list has ``unseen`` above it, which must not reach the last place either
        if unseen < kth and (upper[upper >= kth] == lower[upper >= kth]).all():
            break
        at, depth = depth, depth * 2
    found = np.flatnonzero(lower >= max(kth, 1))
    best = found[np.argsort(-lower[found], kind="stable")][:k]
    return best, lower[best]


def _search(k: int):
    """Search one shard of documents for one block of queries."""
    fields = {"item_key": pa.int64(), "shard": pa.int64(), "place": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
    schema = pa.schema(list(fields.items()))

    def search(postings: pa.Table, queries: pa.Table) -> pa.Table:
        if not postings.num_rows or not queries.num_rows:
            return schema.empty_table()
        # documents numbered by id, null ids last, so that equal scores go by number
        known = postings["doc_id"].combine_chunks()
        place, first = np.unique(postings["place"].to_numpy(), return_index=True)
        ids, missing = known.fill_null(0).to_numpy()[first], known.is_null().to_numpy(zero_copy_only=False)[first]
        by_id = np.lexsort((place, ids, missing))
        number = np.empty(len(place), np.int64)
        number[by_id] = np.arange(len(place))
        doc = number[np.searchsorted(place, postings["place"].to_numpy())]
        term, impact = postings["term_id"].to_numpy(), postings["impact"].to_numpy()
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        terms, start = np.unique(term, return_index=True)
        end = np.append(start[1:], len(term))

        query = queries.sort_by([("item_key", "ascending"), ("term_id", "ascending")])
        key, wanted, weight = (query[c].to_numpy() for c in ("item_key", "term_id", "weight"))
        spot = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        held = np.flatnonzero(terms[spot] == wanted)
        keys, begin = np.unique(key[held], return_index=True)
        out = [schema.empty_table()]
        for item, rows in zip(keys.tolist(), np.split(held, begin[1:])):
            lists = [(int(weight[i]), doc[start[spot[i]] : end[spot[i]]], impact[start[spot[i]] : end[spot[i]]]) for i in rows]
            best, scores = settle(lists, len(place), k)
            found = by_id[best]
            same = lambda v: pa.array(np.full(len(best), v, np.int64))
            columns = [same(item), same(queries["shard"][0].as_py()), pa.array(place[found]), pa.array(ids[found], mask=missing[found]), pa.array(scores)]
            out.append(pa.table(columns, schema=schema))
        return pa.concat_tables(out).combine_chunks()

    return search


def best_of(found: DataFrame, shards: int, k: int) -> DataFrame:
    """The ``k`` best rows of each query, chosen among ``FAN`` shards at a time, so that no task meets all shards."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    while shards > 1:
        shards = parts(shards, FAN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN))
        within = Window.partitionBy("item_key", "shard").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k).drop("rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item_key").orderBy(*order))).filter(F.col("rank") <= k)


def search(
    items: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
    each: int = EACH, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: ``item_id, rank, doc_id, score``.

    All documents are indexed and all items are answered. Documents are dealt to shards by
    a hash, each with the impact-sorted lists of the terms that items ask for; a shard settles its own best documents by
    :func:`settle` and the best of all shards are merged in a tree. Frequencies are those of the whole table.

    Null or empty texts have no terms: such documents are never found, such items have no rows. Each row is a document or item of
    its own, so repeated rows are ranked, or answered, each; equal scores go by ascending id, null ids last, and
    equal ids in any order. Other columns are ignored.
    """
    key = F.monotonically_increasing_id()
    asked = materialize(
        items.select(key.alias("item_key"), F.col(item_id).alias("item_id"), term_counts(F.col(item_text)).alias("found")).select("item_key", "item_id", F.explode("found").alias("t")).select(
            "item_key", "item_id", "t.term", F.col("t.tf").alias("times")), "items")
    words = asked.select("term").distinct().filter(F.length("term") > 0)
    blank = items.sparkSession.range(1).select(F.lit(ALL).alias("term"))
    vocabulary = materialize(words.unionByName(blank).select("term", key.alias("term_id")), "vocabulary")
    counted = docs.select(key.alias("place"), F.col(doc_id).alias("doc_id"), term_counts(F.col(doc_text)).alias("found")).filter(F.size("found") > 0)
    every = counted.select("place", "doc_id", F.get("found", F.lit(0))["tf"].alias("n"), F.explode("found").alias("t")).select("place", "doc_id", "n", "t.term", "t.tf")
    postings = materialize(every.join(as_lookup(vocabulary), "term").drop("term"), "postings")

    sums = materialize(postings.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(vocabulary, "term_id"), "terms")
    whole = sums.filter(F.length("term") == 0).first()
    # without documents nothing is found
    n_docs, n_terms = (whole["df"], whole["total"]) if whole else (0, 1)
    rarity = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    rated = sums.filter(F.length("term") > 0).select("term", "term_id", rarity.alias("rarity")).filter("rarity > 0")
    weighted = asked.join(as_lookup(rated), "term").select("item_key", "term_id", (F.col("times") * F.col("rarity")).alias("weight"))
    blocks, shards = parts(asked.count(), query_rows), parts(postings.count(), each)
    queries = materialize(weighted.withColumn("block", F.pmod(F.xxhash64("item_key"), F.lit(blocks))), "queries")

    short = F.lit(100 - WEIGHT) + F.expr(f"({WEIGHT} * n * {n_docs}L) div {n_terms}L")
    impact = F.expr(f"({SCALE}L * tf) div (1000 * tf + {SHARPNESS} * short)")
    wanted = queries.select(F.col("block").alias("of_block"), "term_id").distinct()
    listed = postings.withColumn("short", short).select(
        "term_id", "place", "doc_id", impact.alias("impact"), F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard")
    ).join(as_lookup(wanted), "term_id")
    everywhere = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    settled = listed.groupBy("of_block", "shard").cogroup(everywhere.groupBy("block", "shard")).applyInArrow(
        _search(k), "item_key long, shard long, place long, doc_id long, score long"
    )
    names = asked.select("item_key", "item_id").distinct()
    return best_of(settled, shards, k).join(as_lookup(names), "item_key").select(
        F.col("item_id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(doc_id), "score"
    )
