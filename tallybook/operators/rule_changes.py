"""Maintenance of the rule table as batch change-sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.schema import KEPT_EXCEPTION, RULES
from tallybook.session import as_lookup, staged
from tallybook.sources.rule_store import with_defaults

OPS = ["insert", "update", "add_term", "remove_term", "remove"]
SCALARS = ["classification", "update_exception", "web", "essential", "recurrent", "product_service"]
FIELDS = [f for f in RULES.fieldNames() if f != "rule_ord"]

CHANGES = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("name", T.StringType())]
    + [RULES[f] for f in SCALARS]
    + [RULES["descriptions"], T.StructField("term", T.StringType()), T.StructField("new_name", T.StringType())]
)

# Term changes of one name are replayed in blocks of this many sequence numbers.
SEQ_BLOCK = 100_000


def _next_ord(rules: DataFrame) -> int:
    return rules.agg(F.coalesce(F.max("rule_ord"), F.lit(0))).first()[0]


def _last_given(column: str, seq: str = "seq") -> Column:
    """The latest non-null value."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(seq)))


def insert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Append new rules ``(seq, name, ...)`` with defaults; names that exist are rejected, the first of a repeat wins."""
    fields = [c for c in FIELDS if c in new.columns and c != "name"]
    first = new.groupBy("name").agg(F.min_by(F.struct("seq", *fields), "seq").alias("doc"))
    absent = first.join(rules.select("name").distinct(), "name", "left_anti")
    base = _next_ord(rules)
    rows = absent.select(
        (F.lit(base) + F.col("doc.seq")).cast("int").alias("rule_ord"),
        "name",
        *[(F.col(f"doc.{f}") if f in fields else F.lit(None).cast(RULES[f].dataType)).alias(f) for f in FIELDS if f != "name"],
    )
    return rules.select(*RULES.fieldNames()).unionByName(with_defaults(rows))


def rejected_inserts(rules: DataFrame, new: DataFrame) -> DataFrame:
    """The inserts that :func:`insert_rules` does not take: ``(seq, name)``."""
    first = new.groupBy("name").agg(F.min("seq").alias("first_seq"))
    known = rules.select("name", F.lit(True).alias("known")).distinct()
    return new.select("seq", "name").join(as_lookup(first), "name").join(as_lookup(known), "name", "left").filter(
        F.col("known") | (F.col("seq") > F.col("first_seq"))
    ).select("seq", "name")


def update_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite the given (non-null) fields by exact name: ``updates(seq, name, ...)``, the latest wins."""
    fields = [c for c in updates.columns if c in FIELDS and c != "name"]
    latest = updates.groupBy("name").agg(*[_last_given(f).alias(f"new_{f}") for f in fields])
    return rules.join(latest, "name", "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in RULES.fieldNames()]
    )


def add_terms(rules: DataFrame, adds: DataFrame) -> DataFrame:
    """Append terms ``(seq, name, term)`` in sequence; repeats are kept."""
    grouped = adds.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "term"))).alias("added"))
    extra = F.coalesce(F.transform("added", lambda a: a["term"]), F.array().cast("array<string>"))
    return rules.join(grouped, "name", "left").withColumn("descriptions", F.concat("descriptions", extra)).select(*RULES.fieldNames())


def _entries(rules: DataFrame, terms: str = "descriptions") -> DataFrame:
    """One row per term of a rule: ``(rule_ord, name, later, place, term)``; terms added afterwards have ``later`` 1."""
    return rules.select("rule_ord", "name", F.lit(0).alias("later"), F.posexplode(terms).alias("place", "term")).withColumn("place", F.col("place").cast("bigint"))


def _without_first(entries: DataFrame, balance: DataFrame) -> DataFrame:
    """The terms that are left of each rule: ``(rule_ord, name, terms)``.

    Equal terms of a rule are ranked; of ``removals`` requests ``removals + least(0, held + low)`` take effect, with
    ``held`` the occurrences at the start, and that many go from the front. A rule without terms left has no row.
    """
    same = Window.partitionBy("rule_ord", "name", "term")
    ranked = entries.withColumns({
        "rank": F.row_number().over(same.orderBy("later", "place")), "held": F.count_if(F.col("later") == 0).over(same),
    })
    drops = F.coalesce(F.col("removals") + F.least(F.lit(0), F.col("held") + F.col("low")), F.lit(0))
    kept = ranked.join(as_lookup(balance), ["name", "term"], "left").filter(F.col("rank") > drops)
    listed = kept.groupBy("rule_ord", "name").agg(F.array_sort(F.collect_list(F.struct("later", "place", "term"))).alias("listed"))
    return listed.select("rule_ord", "name", F.transform("listed", lambda t: t["term"]).alias("terms"))


def _with_terms(rules: DataFrame, touched: DataFrame, left: DataFrame) -> DataFrame:
    """Put the terms that are left into the rules whose names are ``touched``; the others keep theirs."""
    marked = rules.join(as_lookup(touched.select("name", F.lit(True).alias("touched")).distinct()), "name", "left")
    joined = marked.join(as_lookup(left), ["rule_ord", "name"], "left")
    terms = F.when(F.col("touched").isNull(), F.col("descriptions")).otherwise(F.coalesce("terms", F.array().cast("array<string>")))
    return joined.withColumn("descriptions", terms).select(*RULES.fieldNames())


def remove_terms(rules: DataFrame, removals: DataFrame) -> DataFrame:
    """Take out the first occurrence of a term per request ``(name, term)``. Only the rules asked for are taken apart."""
    counts = removals.groupBy("name", "term").agg(F.count("*").alias("removals")).withColumn("low", -F.col("removals"))
    asked = rules.join(as_lookup(removals.select("name").distinct()), "name", "left_semi")
    return _with_terms(rules, removals, _without_first(_entries(asked), counts))


def missing_terms(rules: DataFrame, removals: DataFrame) -> DataFrame:
    """Removal requests beyond what the rule holds: ``(name, term, requested, held)``."""
    counts = removals.groupBy("name", "term").agg(F.count("*").alias("requested"))
    held = rules.select("name", F.explode("descriptions").alias("term")).groupBy("name", "term").agg(F.count("*").alias("held"))
    known = rules.select("name").distinct()
    return (
        counts.join(known, "name")
        .join(held, ["name", "term"], "left")
        .select("name", "term", "requested", F.coalesce("held", F.lit(0)).alias("held"))
        .filter("requested > held")
    )


def resolve_renames(renames: DataFrame) -> DataFrame:
    """What a name in use at the start ends up as, after ``renames(seq, name, new_name)`` one by one: ``(name, new_name)``.

    A request hands its rule on to the first later request for the name it gave. Chains of requests are shortened by
    pointer jumping, so a chain of n requests takes about log2(n) joins. Of several requests for a name the first counts:
    after it, nothing has that name.
    """
    steps = renames.groupBy("name", "seq").agg(F.min("new_name").alias("new_name"))
    asked = steps.select(F.col("name").alias("key"), "seq", F.col("seq").alias("asked_at"), *[F.lit(None).cast("string").alias(c) for c in ("name", "new_name")])
    given = steps.select(F.col("new_name").alias("key"), "seq", F.lit(None).cast("bigint").alias("asked_at"), "name", "new_name")
    later = Window.partitionBy("key").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    linked = asked.unionByName(given).withColumn("next_seq", F.min("asked_at").over(later))
    # A request is known by its number and its name; jumps carry a number of their own for it, and no name.
    here = linked.filter("name is not null").select("name", "seq", "new_name", "next_seq").withColumn("id", F.monotonically_increasing_id())
    requests = staged(here, "renames")
    onward = requests.select(F.col("name").alias("via"), F.col("seq").alias("via_seq"), F.col("id").alias("to"), F.col("next_seq").isNotNull().alias("open"))
    met = (requests.new_name == onward.via) & (requests.next_seq == onward.via_seq)
    links = staged(requests.filter("next_seq is not null").join(onward, met).select("id", "to", onward.open), "renames")
    while not links.filter("open").isEmpty():
        # those that have reached the end of their chain stay as they are, as targets of the others
        further = links.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("open").alias("more"))
        jumped = links.join(further, "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), F.coalesce("more", F.lit(False)).alias("open"))
        links = staged(jumped, "renames")
    ends = requests.select(F.col("id").alias("to"), F.col("new_name").alias("last_name"))
    ended = links.join(ends, "to").select("id", "last_name")
    links = requests.join(ended, "id", "left").select("name", "seq", F.coalesce("last_name", "new_name").alias("new_name"))
    return links.groupBy("name").agg(F.min_by("new_name", "seq").alias("new_name"))


def rename_rules(rules: DataFrame, renames: DataFrame) -> DataFrame:
    """Give rules a new name: ``renames(name, new_name[, seq])``, one after the other by ``seq``, or all at once without it."""
    one = resolve_renames(renames) if "seq" in renames.columns else renames.groupBy("name").agg(F.min("new_name").alias("new_name"))
    return rules.join(as_lookup(one), "name", "left").withColumn("name", F.coalesce("new_name", "name")).select(*RULES.fieldNames())


def rename_clashes(rules: DataFrame, renames: DataFrame) -> DataFrame:
    """Names that several rules share after the renames: ``(name, n_rules)``."""
    return rename_rules(rules, renames).groupBy("name").agg(F.count("*").alias("n_rules")).filter("n_rules > 1")


def remove_rules(rules: DataFrame, names: DataFrame) -> DataFrame:
    return rules.join(names.select("name").distinct(), "name", "left_anti").select(*RULES.fieldNames())


def clear_exceptions(rules: DataFrame, keep: str = KEPT_EXCEPTION) -> DataFrame:
    """Remove all exception rules but one name."""
    return rules.filter(~(F.col("update_exception") & (F.col("name") != F.lit(keep))))


def _term_balance(effective: DataFrame) -> DataFrame:
    """Per (name, term): removals asked for, and the lowest running balance of adds minus removals.

    The running balance is built in blocks of sequence numbers, so a term with very many
    changes is spread over tasks.
    """
    steps = effective.filter(F.col("op").isin("add_term", "remove_term")).select(
        "name",
        "term",
        "seq",
        F.floor(F.col("seq") / SEQ_BLOCK).alias("block"),
        F.when(F.col("op") == "add_term", 1).otherwise(-1).cast("bigint").alias("step"),
    )
    local = steps.withColumn("balance", F.sum("step").over(Window.partitionBy("name", "term", "block").orderBy("seq")))
    blocks = local.groupBy("name", "term", "block").agg(
        F.sum("step").alias("net"), F.min("balance").alias("low"), F.sum(F.when(F.col("step") < 0, 1).otherwise(0)).alias("removals")
    )
    before = Window.partitionBy("name", "term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifted = blocks.withColumn("low", F.col("low") + F.coalesce(F.sum("net").over(before), F.lit(0)))
    return shifted.groupBy("name", "term").agg(F.sum("removals").alias("removals"), F.least(F.lit(0), F.min("low")).alias("low"))


class ChangesRefused(ValueError):
    """A change-set needs splitting or cannot work."""


def apply_rule_changes(rules: DataFrame, changes: DataFrame, strict: bool = False) -> DataFrame:
    """Apply a change-set (:data:`CHANGES`) in sequence order within each name, then the renames.

    Nothing is replayed row by row. A rule's life ends at its last ``remove`` and starts
    anew at the first ``insert`` after it; later updates are a latest-value aggregate.
    A removal takes the earliest occurrence of its term and fails if there is none, so
    of ``removals`` requests ``removals + least(0, held + low)`` take effect, with
    ``held`` the occurrences at the start and ``low`` the lowest running balance.
    ``strict`` raises on a set that :func:`change_violations` objects to, before anything is applied.
    """
    changes = staged(changes.select(*CHANGES.fieldNames()), "changes")
    if strict:
        found = change_violations(rules, changes).take(5)
        if found:
            raise ChangesRefused("; ".join(f"{r['name']}: {r['problem']}" for r in found))
    edits = changes.filter(F.col("op").isin(OPS))
    removed = edits.filter("op = 'remove'").groupBy("name").agg(F.max("seq").alias("removed_at"))
    known = rules.select("name", F.lit(True).alias("known")).distinct()
    inserts = edits.filter("op = 'insert'").join(as_lookup(removed), "name", "left").join(as_lookup(known), "name", "left")
    able = F.when(F.col("removed_at").isNotNull(), F.col("seq") > F.col("removed_at")).otherwise(F.col("known").isNull())
    docs = [*SCALARS, "descriptions"]
    born = inserts.filter(able).groupBy("name").agg(
        F.min("seq").alias("from_seq"), *[F.min_by(f, "seq").alias(f) for f in docs]
    )
    base = _next_ord(rules)
    newborn = with_defaults(born.select((F.lit(base) + F.col("from_seq")).cast("int").alias("rule_ord"), "name", *docs, "from_seq"), "from_seq")
    survivors = rules.join(as_lookup(removed), "name", "left_anti").select(*RULES.fieldNames(), F.lit(-1).cast("bigint").alias("from_seq"))
    # Written once, as the terms and the other fields of a rule go separate ways from here.
    alive = staged(survivors.unionByName(newborn), "rules")

    starts = alive.groupBy("name").agg(F.max("from_seq").alias("from_seq"))
    live = edits.filter(F.col("op").isin("update", "add_term", "remove_term")).join(as_lookup(starts), "name").filter("seq > from_seq").drop("from_seq")
    given = staged(live.filter("op = 'update'").groupBy("name").agg(
        *[_last_given(f).alias(f"new_{f}") for f in docs],
        F.max(F.when(F.col("descriptions").isNotNull(), F.col("seq"))).alias("reset_at"),
    ), "updates")
    # A new term list replaces what came before it.
    term_ops = staged(live.filter(F.col("op") != "update").join(as_lookup(given.select("name", "reset_at")), "name", "left").filter(
        "reset_at is null or seq > reset_at"
    ).select("name", "seq", "op", "term"), "terms")
    updated = alive.join(given, "name", "left").select("rule_ord", "name", *[F.coalesce(f"new_{f}", f).alias(f) for f in docs])

    touched = updated.join(as_lookup(term_ops.select("name").distinct()), "name", "left_semi").select("rule_ord", "name", "descriptions")
    added = touched.select("rule_ord", "name").join(term_ops.filter("op = 'add_term'"), "name").select(
        "rule_ord", "name", F.lit(1).alias("later"), F.col("seq").alias("place"), "term"
    )
    left = _without_first(_entries(touched).unionByName(added), _term_balance(term_ops))
    result = _with_terms(updated, term_ops, left)
    renames = changes.filter("op = 'rename'").select("seq", "name", "new_name")
    return rename_rules(result, renames)


def change_violations(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Change-sets that need splitting or cannot work: ``(seq, name, problem)``."""
    renames = changes.filter("op = 'rename'").select("seq", F.col("name").alias("old"), "new_name")
    touched = changes.filter("op <> 'rename'").select(F.col("seq").alias("other_seq"), "name")
    ends = renames.select("seq", F.explode(F.array("old", "new_name")).alias("name"))
    later = ends.join(touched, "name").filter("other_seq > seq").groupBy("seq", "name").count().select(
        "seq", "name", F.lit("renamed and changed later").alias("problem")
    )
    repeated = renames.groupBy(F.col("old").alias("name")).agg(F.min("seq").alias("seq"), F.count("*").alias("n")).filter("n > 1").select(
        "seq", "name", F.lit("renamed twice").alias("problem")
    )
    unknown = changes.filter(~F.col("op").isin([*OPS, "rename"])).select("seq", "name", F.lit("unknown operation").alias("problem"))
    repeated_rules = rules.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit(None).cast("bigint").alias("seq"), "name", F.lit("name used by several rules").alias("problem")
    )
    return later.unionByName(repeated).unionByName(unknown).unionByName(repeated_rules)
