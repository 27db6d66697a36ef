"""Ledger tables and files: scans, typing, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.scalars import ISO_DATE, parse_date
from tallybook.schema import LEDGER
from tallybook.sources.checked import CORRUPT, Field, accept, check, violations


class EmptyLedger(ValueError):
    """A sink was asked to overwrite a stored ledger with nothing."""


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_ledger_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def check_ledger_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = LEDGER, whole: bool = True) -> DataFrame:
    """CSV with a header and ISO dates as typed rows with their problems: values that cannot be read, lines of another width.

    The width of a line is known only where it is parsed ``whole``, whatever columns are used.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.option("columnPruning", str(not whole).lower())
    lines = reader.csv(path, schema=text, header=True, escape='"', columnNameOfCorruptRecord=CORRUPT)
    return check(lines, [_field(f) for f in schema], [], CORRUPT)


def _field(f: T.StructField) -> Field:
    text = F.col(f.name)
    if isinstance(f.dataType, T.StringType):
        return Field(f.name, text, text)
    return Field(f.name, text, parse_date(f.name, ISO_DATE) if isinstance(f.dataType, T.DateType) else text.try_cast(f.dataType))


def scan_ledger_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType = LEDGER, strict: bool = False, observation: Observation | None = None
) -> DataFrame:
    """CSV with a header and ISO dates; the schema is given, so the file is read once.

    What cannot be read is null and listed by ``csv_violations``; ``strict`` fails on it, ``observation`` counts it.
    """
    checked = check_ledger_csv(spark, path, schema, whole=strict or observation is not None)
    return accept(checked, schema.fieldNames(), strict, observation)


def csv_violations(spark: SparkSession, path: str | list[str], schema: T.StructType = LEDGER, key: list[str] | None = None) -> DataFrame:
    """The values and lines that ``scan_ledger_csv`` cannot read: ``(*key, column, value, problem)``."""
    return violations(check_ledger_csv(spark, path, schema), key or [])


def type_dates(rows: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Text dates to date columns. ``strict`` makes any bad value fail the job, else it becomes null."""
    return rows.withColumns({c: parse_date(c, ISO_DATE, strict) for c in columns})


def date_violations(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The values that :func:`type_dates` cannot read."""
    tested = F.array(*[F.when(parse_date(c).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in columns])
    return rows.select(*key, F.explode(F.filter(tested, lambda t: t.isNotNull())).alias("t")).select(*key, "t.column", "t.value")


def _refuse_empty(stored: DataFrame) -> None:
    if stored.isEmpty():
        raise EmptyLedger("refusing to overwrite the stored ledger with an empty one")


def _switch(spark: SparkSession, path: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> None:
    """Replace the folder ``path`` by what ``write`` puts into a fresh folder beside it.

    The old rows stay in place until the new ones are written and known not to be empty, so a
    ledger may be read from the folder it is written to, and a failed write changes nothing.
    A process that dies between the two renames leaves the old rows beside, as ``.old-...``.
    """
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex[:12]
    at, staged, old = (Path(path.rstrip("/") + end) for end in ("", f".staged-{mark}", f".old-{mark}"))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(staged.toString())
        _refuse_empty(read(staged.toString()))
        held = files.exists(at)
        if held and not files.rename(at, old):
            raise OSError(f"cannot set {path} aside")
        if not files.rename(staged, at):
            if held:
                files.rename(old, at)
            raise OSError(f"cannot put the new ledger at {path}")
        if held:
            files.delete(old, True)
    finally:
        files.delete(staged, True)
    spark.catalog.refreshByPath(path)


def sink_csv(ledger: DataFrame, path: str) -> None:
    """Overwrite the stored ledger, which may be the one that ``ledger`` is read from."""
    spark = ledger.sparkSession
    _switch(
        spark, path, lambda to: ledger.write.csv(to, header=True, dateFormat=ISO_DATE, escape='"'),
        lambda at: spark.read.csv(at, schema=ledger.schema, header=True, escape='"'),
    )


def sink_parquet(ledger: DataFrame, path: str, text_dates: bool = False, cluster: bool = False) -> None:
    """Overwrite the stored ledger, which may be the one that ``ledger`` is read from.

    ``cluster`` writes it in date ranges, so that later date filters skip whole files
    by their statistics; further columns split a date that holds many rows.
    """
    out = dates_as_text(ledger) if text_dates else ledger
    if cluster:
        tie_breakers = [c for c in ("owner", "amount", "description") if c in out.columns]
        out = out.repartitionByRange("txn_date", *tie_breakers).sortWithinPartitions("txn_date")
    spark = ledger.sparkSession
    _switch(spark, path, out.write.parquet, lambda at: spark.read.schema(out.schema).parquet(at))


def sink_table(ledger: DataFrame, table: str, text_dates: bool = False) -> None:
    """Replace a catalog table, which may be the one that ``ledger`` is read from.

    The rows are written as a table of their own, which then takes the name; the old table goes last.
    """
    spark, mark = ledger.sparkSession, uuid.uuid4().hex[:12]
    staged, old = f"{table}_staged_{mark}", f"{table}_old_{mark}"
    try:
        (dates_as_text(ledger) if text_dates else ledger).write.saveAsTable(staged)
        _refuse_empty(spark.table(staged))
        held = spark.catalog.tableExists(table)
        if held:
            spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
        if held:
            spark.sql(f"DROP TABLE {old}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")


def dates_as_text(ledger: DataFrame) -> DataFrame:
    days = [f.name for f in ledger.schema if isinstance(f.dataType, T.DateType)]
    return ledger.withColumns({c: F.date_format(c, ISO_DATE) for c in days})


def as_json_records(ledger: DataFrame) -> DataFrame:
    """One JSON text per row, ISO dates, null fields kept, text as it is."""
    return ledger.select(F.to_json(F.struct("*"), {"dateFormat": ISO_DATE, "ignoreNullFields": "false"}).alias("record"))


def provenance(path: str | Column = "_metadata.file_path") -> tuple[Column, Column]:
    """Owner (folder) and source file (file name) of a path; ``key=value`` folders give the value."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    owner = F.regexp_replace(F.element_at(parts, -2), "^[^=]*=", "")
    return owner.alias("owner"), F.element_at(parts, -1).alias("source_file")


def add_provenance(rows: DataFrame, path: str = "_metadata.file_path") -> DataFrame:
    return rows.select("*", *provenance(path))
