"""The kinds of statement sources, each read from paths to raw ledger rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.schema import RAW_LEDGER
from tallybook.sources import manual, statements, tables

Paths = str | list[str]
READERS: dict[str, Callable[[SparkSession, Paths], DataFrame]] = {
    "ledger_csv": lambda spark, paths: tables.scan_ledger_csv(spark, paths, RAW_LEDGER),
    "card_text": lambda spark, paths: statements.parse_card_text(statements.read_statement_lines(spark, paths)),
    "card_csv": lambda spark, paths: statements.load_card_table(spark, paths),
    "bank_csv": lambda spark, paths: statements.load_bank_table(spark, paths),
    "bank_pages": lambda spark, paths: statements.load_bank_pages(spark.read.parquet(*([paths] if isinstance(paths, str) else paths))),
    "manual_json": lambda spark, paths: manual.manual_entries(manual.read_manual_documents(spark, paths)),
}
# Kinds whose files may owe a fee.
CARDS = ("card_text", "card_csv")


def read_source(spark: SparkSession, kind: str, paths: Paths) -> DataFrame:
    """Raw ledger rows of the files of one kind."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source {kind!r}; known are {', '.join(READERS)}")
    return READERS[kind](spark, paths).select(*RAW_LEDGER.fieldNames())
