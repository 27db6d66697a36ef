"""The load step: union, tag, check, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.operators.filters import exclude_personal
from tallybook.operators.quality import add_stamp_duty, dedup_suffix, duplicates, newest_first, union_sources
from tallybook.operators.rules import rule_conflicts, tag_ledger, unclassified
from tallybook.schema import LEDGER, RAW_LEDGER
from tallybook.session import free_shuffles
from tallybook.sources.registry import CARDS, Paths, read_source


class LedgerError(ValueError):
    """A check of the strict load failed."""


def load_checks(tagged: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """The rows that make a strict load fail, by check."""
    return {
        "conflicts": rule_conflicts(tagged, rules),
        "unclassified": unclassified(tagged, rules),
        "duplicates": duplicates(tagged),
    }


def load_ledger(
    *sources: DataFrame,
    rules: DataFrame,
    include_personal: bool = True,
    de_duplicate: bool = False,
    counter_by: str = "all",
    strict: bool = False,
    ordered: bool = False,
    stage: str | None = None,
) -> DataFrame:
    """History and new rows to a tagged ledger.

    History (the first source) is tagged again with the rest, so a changed rule reaches
    old rows. ``strict`` raises on conflicts, unclassified rows and, without
    ``de_duplicate``, on duplicates. ``ordered`` sorts by date, newest first. ``stage``
    names a shared folder for the tagged rows, which the checks and the suffixes read
    several times; without it they are tagged anew each time.
    """
    history, *new = [s.select(*[c for c in RAW_LEDGER.fieldNames() if c in s.columns]) for s in sources]
    if not include_personal:
        history = exclude_personal(history)
    tagged = tag_ledger(union_sources(history, *new), rules)
    if stage:
        tagged.write.mode("overwrite").parquet(stage)
        free_shuffles(tagged.sparkSession)
        tagged = tagged.sparkSession.read.schema(LEDGER).parquet(stage)
    if strict:
        for name, failed in load_checks(tagged, rules).items():
            if name == "duplicates" and de_duplicate:
                continue
            if not failed.isEmpty():
                raise LedgerError(f"the load found {name}")
    if de_duplicate:
        tagged = dedup_suffix(tagged, counter_by=counter_by)
    # The rows carry the flag of their rule.
    kept = tagged.filter("not update_exception")
    return newest_first(kept) if ordered else kept


def load_from_statements(
    spark: SparkSession, sources: dict[str, Paths], rules: DataFrame, history: DataFrame | None = None, fees: dict[str, str] | None = None, **options
) -> DataFrame:
    """The load step over statement folders: ``sources`` gives the paths of each kind of the source registry.

    Each card file may owe a fee, whose terms ``fees`` can change (``after``, ``threshold``, ``fee``, ``label``). The filter on personal rows
    concerns ``history`` alone, as in ``load_ledger``, which takes the other options.
    """
    read = {kind: read_source(spark, kind, paths) for kind, paths in sources.items()}
    rows = [add_stamp_duty(r, **(fees or {})) if kind in CARDS else r for kind, r in read.items()]
    first = history if history is not None else spark.createDataFrame([], RAW_LEDGER)
    return load_ledger(first, *rows, rules=rules, **options)
