"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import materialize, parts, word_count
from tallybook.session import as_lookup

MOST = 3  # times a source, and so a document, is taken at most
BLOCK = 64  # units that one task-side fold settles; the tree has one level per factor of it
SEED = 4


def uniform(*what: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *what), 11) / F.lit(float(2**53))


def source_targets(totals: DataFrame) -> DataFrame:
    """Target words of every source: ``src``, ``source``, ``source_size``, ``target``.

    ``totals`` has one row per source (``src``, ``source``, ``source_size``). Sources in code
    point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops at
    three times its source; the excess goes to the others by weight. The sources that
    stop are those whose limit per weight is least, so a running sum finds them. Only the table of sources,
    not of documents, passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("limit", F.col("source_size") * float(MOST))
    least_first = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    everything = Window.partitionBy()
    upto = least_first.rowsBetween(Window.unboundedPreceding, -1)
    onward = least_first.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = F.col("total") - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))
    filled = (
        weighted.withColumn("total", total.cast("double"))
        .withColumn("left", left)
        .withColumn("weights", F.sum("weight").over(onward))
        .withColumn("full", F.col("limit") * F.col("weights") <= F.col("weight") * F.col("left"))
    )
    spent = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    share = F.col("weight") * (F.col("total") - spent) / open_weight
    return filled.select("src", "source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(share).alias("target"))


def pivotal(units: Column) -> Column:
    """Fold the pivotal method over an array of open units (``key``, ``p``, ``due``, ``size``, ``gap``) with 0 < p < 1.

    Two open units with a sum of ``p`` under 1: one takes the sum, the other becomes 0. Otherwise
    one becomes 1 and the other keeps the rest. Chances are such that every unit's expectation stays what it
    was. Returns the one unit left open, with ``done``, the settled ones and their 0 or 1, and ``gap``, the
    words that were due from settled units and not taken.
    """
    nothing = F.lit(None).cast("array<struct<key:string,extra:int>>")
    start = F.struct(F.lit(None).cast("string").alias("key"), *[F.lit(0.0).alias(c) for c in ("p", "due", "size", "gap")], nothing.alias("done"))

    def meet(acc: Column, x: Column) -> Column:
        both, draw = acc["p"] + x["p"], uniform(acc["key"], x["key"])
        # the first one stays open: under 1 it takes the sum, else the other is settled as 1
        first = F.when(both < 1, draw * both < acc["p"]).otherwise(draw * (2 - both) >= 1 - x["p"])
        of = lambda c: (F.when(first, acc[c]).otherwise(x[c]), F.when(first, x[c]).otherwise(acc[c]))
        extra = F.when(both < 1, 0).otherwise(1)
        ended = F.array(F.struct(of("key")[1].alias("key"), extra.alias("extra")))
        done = F.when(acc["done"].isNull(), ended).otherwise(F.concat(acc["done"], ended))
        gap = acc["gap"] + x["gap"] + of("due")[1] - extra * of("size")[1]
        met = F.struct(of("key")[0].alias("key"), (both - extra).alias("p"), of("due")[0].alias("due"), of("size")[0].alias("size"), gap.alias("gap"), done.alias("done"))
        return F.when(acc["key"].isNull(), F.struct(*[x[c].alias(c) for c in ("key", "p", "due", "size", "gap")], acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(units, start, meet)


def closing(units: Column) -> Column:
    """Settle the last open units of a source, one per size class, from the largest down.

    Each is drawn with the chance at which the words still due from it and from all settled units are expected
    to be taken, so smaller units make good what larger ones left.
    """
    gap = F.aggregate(units, F.lit(0.0), lambda acc, x: acc + x["gap"])
    start = F.struct(gap.alias("gap"), F.lit(None).cast("array<struct<key:string,extra:int>>").alias("done"))

    def draw(acc: Column, x: Column) -> Column:
        due = acc["gap"] + x["due"]
        extra = F.when(x["size"] > 0, uniform(x["key"]) * x["size"] < due).otherwise(False).cast("int")
        one = F.array(F.struct(x["key"].alias("key"), extra.alias("extra")))
        return F.struct((due - extra * x["size"]).alias("gap"), F.when(acc["done"].isNull(), one).otherwise(F.concat(acc["done"], one)).alias("done"))

    return F.aggregate(F.reverse(F.array_sort(units)), start, draw, lambda acc: acc["done"])


def _level(open_units: DataFrame, *group: str) -> tuple[DataFrame, DataFrame]:
    """Settle all units of each group but one; the settled units and those left."""
    # blocks of one class go to tasks of their own, though the class was gathered to count its blocks
    folded = open_units.repartition("src", "class", "block").groupBy(*group).agg(pivotal(F.array_sort(F.collect_list(F.struct("rank", "key", "p", "due", "size", "gap")))).alias("r"))
    folded = materialize(folded, "mix-level")
    return folded.select(F.explode("r.done").alias("d")).select("d.*"), folded.select(*group, *[F.col(f"r.{c}").alias(c) for c in ("key", "p", "due", "size", "gap")])


def rounded(units: DataFrame) -> DataFrame:
    """0 or 1 for every unit of ``units`` (src, size, key, p with 0 < p < 1): ``key``, ``extra``.

    Units meet units of their source and size class first, in blocks dealt by hash; what a
    block leaves open goes up a tree, level by level, until one unit per class is open. Those of a
    source are settled together. Each level is written once and read twice.
    """
    classed = units.select(
        "src", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int").alias("class"), F.col("size").alias("rank"), "key", "p",
        (F.col("p") * F.col("size")).alias("due"), F.col("size").cast("double").alias("size"), F.lit(0.0).alias("gap"),
    )
    sizes = classed.groupBy("src", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = classed.join(as_lookup(sizes), ["src", "class"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    most = sizes.agg(F.max("blocks")).first()[0]
    done, left = _level(dealt, "src", "class", "blocks", "block")
    level = 0
    while most and most > 1:
        level, most = level + 1, parts(most, BLOCK)
        dealt = left.withColumn("blocks", F.ceil(F.col("blocks") / BLOCK))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "key"), "blocks")).withColumn("rank", F.xxhash64(F.lit(level), "key"))
        some, left = _level(dealt, "src", "class", "blocks", "block")
        done = done.unionByName(some)
    last = left.groupBy("src").agg(closing(F.collect_list(F.struct("class", "key", "due", "size", "gap"))).alias("done"))
    return done.unionByName(last.select(F.explode("done").alias("d")).select("d.*"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """How often the mix takes each row.

    Returns one row per row of ``docs``: the id, ``source``, ``size`` (words), ``source_size``,
    ``target`` of the source, ``copies`` and ``taken`` (words, repeats counted); ``keep`` names columns of
    ``docs`` to be carried along. A row is expected ``target / source_size`` times, at most
    three. The whole part is taken as it is; the fractions are rounded by the pivotal method, so
    the taken words of a source stay within about one row of each size class of its target.

    Null texts are empty; empty rows count as rows of size 0, of a source of target 0 if all its rows are
    empty. Null sources are one source, the last. Rows equal in id, source and size are one
    unit whose copies are spread over them evenly. All draws depend on id, source and size
    only, so reruns agree whatever the partitioning.
    """
    source, doc_id = F.col(source_col), F.col(id_col)
    rows = docs.select(
        doc_id.alias("mix_id"), source.alias("mix_source"), word_count(F.col(text_col)).alias("mix_size"),
        F.to_json(F.struct(source.alias("s"))).alias("src"), F.xxhash64(F.col(text_col)).alias("mix_text"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    ).withColumn("key", F.to_json(F.struct(F.col("mix_id").alias("d"), F.col("mix_source").alias("s"), F.col("mix_size").alias("n"))))
    units = rows.groupBy("key", "src").agg(F.first("mix_source").alias("source"), F.first("mix_size").alias("size"), F.count("*").alias("rows"))
    units = materialize(units, "mix-units")
    totals = units.groupBy("src").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = materialize(source_targets(totals), "mix-targets")

    wanted = units.join(as_lookup(targets.select("src", "source_size", "target")), "src")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0) * F.col("rows")
    wanted = wanted.withColumn("times", times).withColumn("whole", F.floor("times")).withColumn("p", F.col("times") - F.col("whole"))
    extra = rounded(wanted.filter("p > 0").select("src", "size", "key", "p"))
    settled = wanted.join(extra, "key", "left").select("key", "rows", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("times"))

    # of several texts with one id, source and size the same ones are taken in every run
    nth = F.row_number().over(Window.partitionBy("key").orderBy("mix_text"))
    copies = F.floor(F.col("times") / F.col("rows")) + (nth <= F.col("times") % F.col("rows")).cast("long")
    out = rows.drop("src").join(settled, "key").withColumn("copies", copies.cast("long"))
    return out.select(
        F.col("mix_id").alias(id_col), F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), F.col("source_size").cast("long").alias("source_size"),
        "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"), *[F.col(f"kept_{c}") for c in keep],
    )


def mixed(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated up to three times."""
    names = docs.columns
    taken = mix(docs, keep=names, **columns).filter("copies > 0")
    repeated = taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"kept_{c}").alias(c) for c in names])
