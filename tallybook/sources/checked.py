"""What a reader cannot read: typed rows with their problems, counted, listed, or fatal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Column that holds a line which does not have the table's form, where the format can tell.
CORRUPT = "_corrupt_record"
PROBLEMS = "problems"
MISSING, UNREADABLE, MALFORMED = "missing", "unreadable", "malformed line"


@dataclass(frozen=True)
class Field:
    """A column to be read: its text, what the text means, and whether it must be there."""

    name: str
    text: Column
    value: Column
    required: bool = False

    def problem(self) -> Column:
        """Null, or what is wrong with the value."""
        blank = self.text.isNull() | (F.trim(self.text) == "")
        found = F.when(blank, F.lit(MISSING if self.required else None).cast("string")).when(self.value.isNull(), F.lit(UNREADABLE))
        record = F.struct(F.lit(self.name).alias("column"), self.text.alias("value"), found.alias("problem"))
        return F.when(found.isNotNull(), record)


def check(rows: DataFrame, fields: list[Field], carried: list[str | Column], corrupt: str | None = None) -> DataFrame:
    """The carried columns, the typed fields, and an array of problems per row.

    A plan that does not use the problems does not work them out.
    """
    found = [f.problem() for f in fields if f.required or f.text is not f.value]
    if corrupt:
        line = F.struct(F.lit(None).cast("string").alias("column"), F.col(corrupt).alias("value"), F.lit(MALFORMED).alias("problem"))
        found.append(F.when(F.col(corrupt).isNotNull(), line))
    problems = F.filter(F.array(*found), lambda p: p.isNotNull())
    return rows.select(*carried, *[f.value.alias(f.name) for f in fields], problems.alias(PROBLEMS))


def accept(checked: DataFrame, columns: list[str], strict: bool = False, observation: Observation | None = None) -> DataFrame:
    """The typed rows, what could not be read as null.

    ``strict`` fails on the first problem. ``observation`` counts ``rows``, ``bad_rows`` and the
    problems of each column (``bad_<column>``) while the rows are used, without a pass of its own.
    """
    if observation is not None:
        named = lambda c: F.exists(PROBLEMS, lambda p: p["column"] == c)
        checked = checked.observe(
            observation, F.count("*").alias("rows"), F.count_if(F.size(PROBLEMS) > 0).alias("bad_rows"),
            *[F.count_if(named(c)).alias(f"bad_{c}") for c in columns], F.count_if(F.exists(PROBLEMS, lambda p: p["column"].isNull())).alias("bad_lines"),
        )
    if strict:
        first = F.get(PROBLEMS, F.lit(0))
        text = F.concat_ws(" ", F.lit("cannot read:"), first["column"], first["problem"], first["value"])
        checked = checked.filter(F.when(F.size(PROBLEMS) > 0, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*columns)


def violations(checked: DataFrame, key: list[str]) -> DataFrame:
    """One row per problem: ``(*key, column, value, problem)``; the column of a malformed line is null and its value the line."""
    return checked.select(*key, F.explode(PROBLEMS).alias("p")).select(*key, "p.column", "p.value", "p.problem")
