"""Checks on the ledger: copies, expectations, and rows derived from whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.scalars import money, parse_date
from tallybook.schema import COPY_KEY, STAMP_DUTY
from tallybook.session import discard, free_shuffles, staged

# One task writes out at most this many copies of a row.
COPIES_PER_TASK = 1_000_000
# A row with at most this many copies is written out where it stands.
COPIES_IN_PLACE = 16
# So many rows at most are put in one task because they agree on some columns.
ROWS_IN_GROUP = 1_000_000
# The bits that mark repeated fingerprints: 16 MB, powers of two.
MARK_BITS, WORDS = 1 << 27, 16


def collapse_copies(ledger: DataFrame, n: str = "n") -> DataFrame:
    """Fully equal rows become one row with a count; the count starts before the shuffle."""
    return ledger.groupBy(*ledger.columns).agg(F.count("*").alias(n))


def expand_copies(rows: DataFrame, n: str, by: list[str] | None = None, per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Undo :func:`collapse_copies`, adding ``copy_no`` from 1.

    Counts are cut into blocks and the blocks are shuffled (by all columns or those of
    ``by``), so that many copies of one row come from many tasks.
    """
    step = F.lit(per_task).cast("bigint")
    blocks = rows.filter(F.col(n) > 0).withColumn("block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n), step)))
    last = F.least(F.col("block") + per_task - 1, F.col(n))
    spread = blocks.repartition(*(by or rows.columns), "block")
    return spread.withColumn("copy_no", F.explode(F.sequence(F.col("block"), last))).drop("block", n)


def written_out(rows: DataFrame, n: str, by: list[str]) -> DataFrame:
    """:func:`expand_copies` in which rows of few copies stay where they are."""
    few = rows.filter(F.col(n) <= COPIES_IN_PLACE).withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), n))).drop(n)
    return few.unionByName(expand_copies(rows.filter(F.col(n) > COPIES_IN_PLACE), n, by=by))


def fingerprint(columns: list[str]) -> Column:
    """Rows that agree on the columns have equal fingerprints; a few others may too."""
    return F.xxhash64(*columns)


def repeated_fingerprints(ledger: DataFrame, columns: list[str], more_than: int = 1) -> DataFrame:
    """The fingerprints of more than so many rows, ``(fingerprint)``.

    Only eight bytes and a count per distinct value are shuffled. What remains is as small as the copies are few.
    """
    counts = ledger.groupBy(fingerprint(columns).alias("fingerprint")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > more_than).select("fingerprint")


def split_repeats(ledger: DataFrame, columns: list[str], more_than: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows whose values of ``columns`` occur ``more_than`` times at most, and the others.

    The second part may hold some rows that are no copies: a repeated fingerprint marks one of ``MARK_BITS`` bits, which are
    broadcast, and rows whose bit is marked go there. So the split moves no row of the ledger, however many copies it has.
    """
    return split_marked(ledger, columns, marks_of(repeated_fingerprints(ledger, columns, more_than)))


def marks_of(fingerprints: DataFrame) -> DataFrame:
    """The bits that fingerprints mark, in rows of ``WORDS`` words."""
    bucket, word, bit = _mark(F.col("fingerprint"))
    words = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))) for i in range(WORDS)]
    return staged(fingerprints.groupBy(bucket.alias("mark_bucket")).agg(F.array(*words).alias("mark_words")), "marks")


def split_marked(rows: DataFrame, columns: list[str], marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose fingerprint has no mark, and the others."""
    bucket, word, bit = _mark(fingerprint(columns))
    looked_up = rows.join(F.broadcast(marks), bucket == F.col("mark_bucket"), "left")
    marked = F.coalesce(F.get("mark_words", word).bitwiseAND(bit) != 0, F.lit(False))
    return looked_up.filter(~marked).select(*rows.columns), looked_up.filter(marked).select(*rows.columns)


def _mark(value: Column) -> tuple[Column, Column, Column]:
    """Where a fingerprint's bit is: the bucket of words, the word in it, and the bit as a number."""
    at = value.bitwiseAND(F.lit(MARK_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftright(at, (64 * WORDS).bit_length() - 1), F.shiftright(at, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"), bit


def duplicates(ledger: DataFrame, key: list[str] = COPY_KEY) -> DataFrame:
    """The repeats: all rows of a copy group but its first by file, booking date and the rest.

    Rows without a copy leave before anything else is done. No group is ever gathered: equal rows are counted
    first, and the first row of a group is a minimum.
    """
    rest = [c for c in ["source_file", "booking_date"] if c in ledger.columns]
    rest += [c for c in ledger.columns if c not in key and c not in rest]
    counted = collapse_copies(split_repeats(ledger, key)[1])
    groups = (
        counted.groupBy(*key)
        .agg(F.sum("n").alias("group_n"), F.min(F.struct(*rest)).alias("first_row"))
        .filter("group_n > 1")
    )
    is_first = F.struct(*rest).eqNullSafe(F.col("first_row"))
    hit = match_nulls(counted, groups, key).select(
        *ledger.columns, (F.col("n") - F.when(is_first, 1).otherwise(0)).alias("n")
    )
    return expand_copies(hit, "n").select(*ledger.columns)


def duplicate_count(ledger: DataFrame, key: list[str] = COPY_KEY) -> DataFrame:
    """How many rows repeat an earlier one."""
    sizes = split_repeats(ledger, key)[1].groupBy(*key).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def dedup_suffix(ledger: DataFrame, key: list[str] = COPY_KEY, counter_by: str = "all", text: str = "description") -> DataFrame:
    """Suffix the description of every member of a copy group with ``_1``, ``_2`` and so on.

    ``counter_by='all'`` counts within rows equal in every column but the description,
    so copies from different files each start at 1; ``'subset'`` counts within the copy
    key, which makes all members differ. Rows of a counter group are counted by file, booking date, description and the rest.

    Rows without a copy pass straight through. The others are collapsed and then moved once, by the columns that the copy key and
    the counter share: copy groups and counter groups both lie within rows equal in these. Only where very many
    rows agree on them are the groups found by joins and counted over ranges.
    """
    unique, copies = split_repeats(ledger, key)
    counted = staged(collapse_copies(copies), "counted")
    counter = [c for c in ledger.columns if c != text] if counter_by == "all" else list(key)
    order = [c for c in ("source_file", "booking_date", text) if c in ledger.columns and c not in counter]
    order += [c for c in ledger.columns if c not in counter and c not in order]
    shared = [c for c in key if c in counter]
    if shared and fit_in_tasks(counted, shared):
        single, numbered, by = _count_in_groups(counted, key, counter, order, shared)
    else:
        single, numbered, by = _count_in_ranges(counted, key, counter, order)
    numbered = numbered.select(*ledger.columns, "first", "n", *[c for c in by if c not in ledger.columns and c != "first"])
    suffixed = written_out(numbered, "n", by).withColumn(
        text, F.concat(F.col(text), F.lit("_"), (F.col("first") + F.col("copy_no")).cast("string"))
    )
    return unique.unionByName(single.select(*ledger.columns)).unionByName(suffixed.select(*ledger.columns))


def fit_in_tasks(rows: DataFrame, columns: list[str]) -> bool:
    """Whether ``ROWS_IN_GROUP`` rows at most agree on the columns. Only fingerprints are moved for that."""
    if rows.count() <= ROWS_IN_GROUP:
        return True
    sizes = rows.groupBy(fingerprint(columns).alias("fingerprint")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0]
    free_shuffles(rows.sparkSession)
    return most <= ROWS_IN_GROUP


def gathered(rows: DataFrame, columns: list[str], day: str = "txn_date") -> tuple[DataFrame, list[str]]:
    """Rows moved once into ranges of days, if these are among the columns, and a number, so that rows equal in the columns are in one place.

    A window that has what comes back beside the rows among its keys moves nothing. The number stands for the columns,
    as a window takes no range of floating numbers for its own.
    """
    place = [*[c for c in columns if c == day], "place"]
    return rows.withColumn("place", F.hash(*columns)).repartitionByRange(*place), place


def _count_in_groups(
    counted: DataFrame, key: list[str], counter: list[str], order: list[str], shared: list[str]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows in no copy group, and the others with the number of their counter group's rows before them (``first``)."""
    rows = [c for c in counted.columns if c != "n"]
    together, place = gathered(counted, shared)
    groups = Window.partitionBy(*place, *[c for c in key if c not in place])
    sized = together.withColumn("group_n", F.sum("n").over(groups))
    copies = F.when(F.col("group_n") > 1, F.col("n"))
    before = Window.partitionBy(*place, *[c for c in counter if c not in place]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.withColumn("first", F.coalesce(F.sum(copies).over(before), F.lit(0)))
    return numbered.filter("group_n = 1").select(*rows), numbered.filter("group_n > 1"), rows


def _count_in_ranges(counted: DataFrame, key: list[str], counter: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """What :func:`_count_in_groups` gives, where a group may be too large for one task.

    The rows are sorted into ranges that are staged, so that counts run within a range and are shifted by the totals of the ranges before.
    """
    rows = [c for c in counted.columns if c != "n"]
    sizes = counted.groupBy(*key).agg(F.sum("n").alias("group_n")).filter("group_n > 1")
    sized = match_nulls(counted, sizes, key, "left").select(*rows, "n", "group_n")
    # A row whose fingerprint alone was repeated is in no group.
    counter_id = F.when(F.col("group_n").isNotNull(), _digest(counter))
    ranged = sized.withColumn("counter_id", counter_id).drop("group_n").repartitionByRange("counter_id", *order)
    placed = staged(ranged.withColumn("block", F.spark_partition_id()), "copies")
    discard(counted)
    hit = placed.filter("counter_id is not null")
    before = Window.partitionBy("counter_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range of a counter group meets in the second window.
    earlier = Window.partitionBy("counter_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hit.groupBy("counter_id", "block").agg(F.sum("n").alias("block_n")).select(
        "counter_id", "block", F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("offset")
    )
    numbered = hit.withColumn("local", F.coalesce(F.sum("n").over(before), F.lit(0))).join(offsets, ["counter_id", "block"])
    numbered = numbered.withColumn("first", F.col("local") + F.col("offset"))
    return placed.filter("counter_id is null").select(*rows), numbered, ["counter_id", "first"]


def _digest(columns: list[str]) -> Column:
    """One short key for many columns. Each value follows its length, so no two rows look alike; null has no length."""
    text = lambda c: F.col(c).cast("string")
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])))


def match_nulls(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other, as they do in a copy group."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in key]
    return left.join(renamed, same, how).drop(*[f"right_{k}" for k in key])


def newest_first(ledger: DataFrame, day: str = "txn_date") -> DataFrame:
    """The ledger by date, newest first; all other columns break ties.

    Rows are shuffled once, by the sort. Only a row with so many copies that they would fill a sort task is
    sorted as one row with a count, in blocks.
    """
    others = [c for c in ledger.columns if c != day]
    few, many = split_repeats(ledger, ledger.columns, COPIES_PER_TASK)
    one = F.lit(1).cast("bigint")
    blocks = collapse_copies(many).withColumn("block", F.explode(F.sequence(one, F.col("n"), F.lit(COPIES_PER_TASK).cast("bigint"))))
    last = F.least(F.col("block") + COPIES_PER_TASK - 1, F.col("n"))
    counted = few.withColumns({"block": one, "last": one}).unionByName(blocks.withColumn("last", last).drop("n"))
    ordered = counted.orderBy(F.desc(day), *[F.asc(c) for c in others], "block")
    return ordered.withColumn("copy_no", F.explode(F.sequence("block", "last"))).select(*ledger.columns)


def add_stamp_duty(
    ledger: DataFrame,
    after: str = STAMP_DUTY["after"],
    threshold: str = STAMP_DUTY["threshold"],
    fee: str = STAMP_DUTY["fee"],
    label: str = STAMP_DUTY["label"],
) -> DataFrame:
    """Append a fee row for each file that starts after the cut-off and exceeds the threshold."""
    return ledger.unionByName(stamp_duty(ledger, after, threshold, fee, label), allowMissingColumns=True)


def stamp_duty(ledger: DataFrame, after: str, threshold: str, fee: str, label: str) -> DataFrame:
    """The fee rows alone, dated at the file's earliest date."""
    files = ledger.groupBy("source_file", "owner").agg(
        F.min("txn_date").alias("txn_date"), F.sum(money("amount")).alias("file_total")
    )
    due = files.filter((F.col("txn_date") > F.lit(after).cast("date")) & (F.col("file_total") > money(F.lit(threshold))))
    return due.select(
        "txn_date",
        F.col("txn_date").alias("booking_date"),
        F.lit(label).alias("description"),
        F.lit(fee).cast("double").alias("amount"),
        "source_file",
        "owner",
    )


def ledger_violations(
    rows: DataFrame,
    key: list[str],
    files: list[str] | None = None,
    owners: list[str] | None = None,
    classifications: list[str] | None = None,
    dates: list[str] | None = None,
) -> DataFrame:
    """One row per failed expectation: ``(*key, rule, value)``. A null value fails too."""
    checks = [(f"date_format:{c}", F.col(c), parse_date(c).isNull()) for c in (dates or [])]
    for name, column, allowed in (
        ("file_label", "source_file", files),
        ("owner", "owner", owners),
        ("classification", "classification", classifications),
    ):
        if allowed is not None:
            checks.append((name, F.col(column), ~F.coalesce(F.col(column).isin(allowed), F.lit(False))))
    tested = F.array(*[F.when(bad, F.struct(F.lit(n).alias("rule"), v.cast("string").alias("value"))) for n, v, bad in checks])
    return rows.select(*key, F.explode(F.filter(tested, lambda t: t.isNotNull())).alias("t")).select(*key, "t.rule", "t.value")


def uneven_arrays(documents: DataFrame, entry: str, fields: list[str], key: list[str]) -> DataFrame:
    """Documents whose parallel arrays differ in length: ``(*key, rule, value)`` with the lengths."""
    sizes = [F.coalesce(F.size(F.col(f"{entry}.{f}")), F.lit(-1)) for f in fields]
    return documents.filter(F.greatest(*sizes) != F.least(*sizes)).select(
        *key, F.lit("equal_lengths").alias("rule"), F.concat_ws(",", *[s.cast("string") for s in sizes]).alias("value")
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, duplicates kept, missing columns null."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out
