"""Registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm import chat, language, lexical, mixing, near_text, near_vectors, periods, personal, pieces, repeats, secrets, topk, warc
from tallybook.llm.common import table

# Fixed values of the contract: a conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_payload=0)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@F.arrow_udf(T.BinaryType())
def repeated_tail(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Of every tenth document, by a hash of its id, all words from some place on repeat the first few from there."""
    out = []
    for number, text in zip(ids, texts.cast(pa.binary())):
        h = zlib.crc32(str(number.as_py()).encode())
        g, words = h // 10, (text.as_py() or b"").split()  # splits at ASCII white space alone
        if number.is_valid and h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            out.append(b" ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)]))
        else:
            out.append(text.as_py())
    return pa.array(out, pa.binary())


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail("doc_id", "text").alias("text"))
    return periods.run_digests(periods.periodic_runs(docs, min_exponent=4, min_length=6))


def op12_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=20)


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language, op2_topk, op3_chat, op4_mixing, op5_pieces, op6_minhash, op7_warc, op8_vectors, op9_secrets, op10_repeats, op11_periods, op12_nra, op13_personal)
}

ORACLES: dict[str, str] = {
    "op2_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
            where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 10
    """,
    "op8_vectors": """
        with recursive v as (
            select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
        ), reach as (
            select u as node, u as other from links union select r.node, l.v from reach r join links l on l.u = r.other
        ), least as (select node, min(other) as component_id from reach group by node),
        n as (select u, count(*) as n_links from links group by u)
        select e.vec_id, coalesce(n.n_links, 0) as n_links, coalesce(least(c.component_id, e.vec_id), e.vec_id) as component_id,
               coalesce(least(c.component_id, e.vec_id), e.vec_id) = e.vec_id as kept
        from embeddings e left join n on n.u = e.vec_id left join least c on c.node = e.vec_id
    """,
    "op12_nra": r"""
        with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        p as (select doc_id, term, count(*)::bigint as tf from t group by all),
        d as (select doc_id, sum(tf)::bigint as n from p group by all),
        s as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d),
        w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by term, n_docs),
        m as (select doc_id, 100 - 25 + (25 * n * n_docs) // n_terms as m from d, s),
        i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        q as (select item_id, term, count(*)::bigint as times from i group by all),
        r as (
            select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
            from q join p using (term) join w using (term) join m using (doc_id) group by all
        ), o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0)
        select item_id, rank::int as rank, doc_id, score from o where rank <= 20
    """,
    "op6_minhash": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
            from documents
        ), s as (
            select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh
            from w
        ), n as (select doc_id, len(sh) as n from s),
        x as (select doc_id, unnest(sh) as g from s),
        common as (select a.doc_id as u, b.doc_id as v, count(*) as k from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        links as (select u, v from common join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 75 * (a.n + b.n - k)),
        reach as (select u as node, u as other from links union select r.node, l.v from reach r join links l on l.u = r.other),
        least as (select node, min(other) as component_id from reach group by node)
        select d.doc_id, n.n::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
        from documents d join n using (doc_id) left join least c on c.node = d.doc_id
    """,
}
