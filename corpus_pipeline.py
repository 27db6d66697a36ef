"""A training-corpus pipeline over the documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import language, mixing, near_text, pieces, secrets
from tallybook.llm.common import materialize

LEAST_SCORE = 0.3  # mean posterior of the predicted language below which a text is rejected


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the field can tell; the others go."""
    predict = language.predictor(language.fit_documents(docs))
    scored = docs.withColumn("language_prediction", predict(F.col("text")))
    told = (F.col("language_prediction.lang_pred") != language.UNKNOWN) & (F.col("language_prediction.score") >= LEAST_SCORE)
    return scored.filter(told).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Repeated rows of that id stay together."""
    found = near_text.near_duplicates(docs.select("doc_id", "text"))
    dropped = found.filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, docs.doc_id.eqNullSafe(dropped.doc_id), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and the character counts follow."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some not, some once, some up to three times."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return pieces.encode_documents(docs)


STAGES = [
    ("language ID", keep_languages),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

# A fitted field, hash draws and a tokenizer cannot be put into SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
