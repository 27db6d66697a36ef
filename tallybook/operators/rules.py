"""Standardise, classify and tag descriptions with the rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.scalars import trim_all
from tallybook.schema import CHANNEL_SHOP, CHANNEL_WEB, GROUPS
from tallybook.session import as_lookup, never_broadcast, sized_lookup, small_table

# A term is found through one of its grams, whose size is the largest of these that the term has.
SIZES = (1, 2, 4, 8, 16)


def rule_terms(rules: DataFrame) -> DataFrame:
    """One row per search term, empty ones skipped: ``(rule_ord, name, classification, pos, term)``."""
    return rules.select("rule_ord", "name", "classification", F.posexplode("descriptions").alias("pos", "term")).filter(
        F.length("term") > 0
    )


def _grams(text: Column, size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    every = F.transform(starts, lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, every).otherwise(F.array().cast("array<string>"))


def term_anchors(terms: DataFrame) -> DataFrame:
    """Each distinct term with the one of its grams that the fewest terms hold: ``(term, gram)``.

    A beginning that thousands of terms share is so passed over for what tells them apart, and
    long terms have long grams, which few texts hold. Counts start before the shuffle, so a gram of all terms is not gathered.
    """
    distinct = terms.select("term").filter(F.length("term") > 0).distinct()
    size = F.lit(SIZES[0])
    for s in SIZES[1:]:
        size = F.when(F.length("term") >= s, s).otherwise(size)
    every = distinct.select("term", F.explode(F.array_distinct(_grams(F.col("term"), size))).alias("gram"))
    counts = every.groupBy("gram").agg(F.count("*").alias("n_terms"))
    rated = never_broadcast(every).join(as_lookup(counts), "gram")
    return rated.groupBy("term").agg(F.min_by("gram", F.struct("n_terms", "gram")).alias("gram"))


def candidates(texts: DataFrame, anchors: DataFrame, text: str = "description") -> DataFrame:
    """Every (text, term) where the text holds the term's anchor, as an equi join.

    The anchors are worked out once and counted. If they are small they are broadcast, else both sides are shuffled
    and a gram that is hot is split; the grams of the texts never meet in one place.
    """
    anchors = sized_lookup(anchors, "anchors")
    # One value per gram size comes back.
    sizes = sorted(r[0] for r in anchors.select(F.length("gram")).distinct().collect())
    if not sizes:
        return texts.filter("false").select("*", F.lit(None).cast("string").alias("term"))
    grams = F.array_distinct(F.concat(*[_grams(F.col(text), n) for n in sizes]))
    return texts.withColumn("gram", F.explode(grams)).join(anchors, "gram").drop("gram")


def match_terms(texts: DataFrame, terms: DataFrame, text: str = "description") -> DataFrame:
    """Every (text, term) where the term occurs literally in the text, with all columns of both.

    Each distinct term meets the texts that hold its rarest gram, ``contains`` confirms, and the
    rows of an equal term join last. So work follows the matches and not terms times texts.
    """
    found = candidates(texts, term_anchors(terms), text).filter(F.contains(F.col(text), F.col("term")))
    return found.join(sized_lookup(terms, "terms"), "term").select(*texts.columns, *terms.columns)


def matched_names(ledger: DataFrame, rules: DataFrame, text: str = "description") -> DataFrame:
    """Per distinct text that some rule matches: the first and last matching name, in name order.

    The names of a term are reduced to two before any text is met.
    """
    texts = ledger.select(text).filter(F.col(text).isNotNull()).distinct()
    terms = rule_terms(rules).groupBy("term").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    hits = match_terms(texts, terms, text)
    return hits.groupBy(text).agg(F.min("low").alias("first_name"), F.max("high").alias("last_name"))


def standardize(ledger: DataFrame, rules: DataFrame, text: str = "description") -> DataFrame:
    """Replace a matched description by its rule's name; keep the others.

    A text that several names match takes the first in name order and shows up in
    :func:`rule_conflicts`.
    """
    names = matched_names(ledger, rules, text).select(text, F.col("first_name").alias("std_name"))
    return ledger.join(as_lookup(names), text, "left").select(
        *ledger.columns, F.coalesce("std_name", text).alias("std_description")
    )


def rule_conflicts(ledger: DataFrame, rules: DataFrame, text: str = "description") -> DataFrame:
    """Texts matched by two or more different names: ``(text, names)``, names sorted."""
    texts = ledger.select(text).filter(F.col(text).isNotNull()).distinct()
    hits = match_terms(texts, rule_terms(rules).select("name", "term").distinct(), text)
    return (
        hits.groupBy(text)
        .agg(F.array_sort(F.collect_set("name")).alias("names"))
        .filter(F.size("names") > 1)
    )


def class_order(rules: DataFrame) -> DataFrame:
    """Classifications by first appearance in the rule table."""
    return rules.groupBy("classification").agg(F.min("rule_ord").alias("class_ord"))


def tags_by_name(rules: DataFrame) -> DataFrame:
    """One row per rule name: the earliest classification, the flags of its last rule."""
    ranked = rules.join(as_lookup(class_order(rules)), "classification")
    latest = lambda c: F.max_by(c, "rule_ord")
    return ranked.groupBy(F.col("name").alias("std_description")).agg(
        F.min_by("classification", "class_ord").alias("classification"),
        F.when(F.bool_or("web"), F.lit(CHANNEL_WEB)).otherwise(F.lit(CHANNEL_SHOP)).alias("channel"),
        F.bool_or("update_exception").alias("update_exception"),
        latest("essential").cast("int").alias("essential"),
        latest("recurrent").cast("int").alias("recurrent"),
        latest("product_service").cast("int").alias("product"),
    )


def classify(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the classification of the standard name; null when no rule has that name."""
    classes = tags_by_name(rules).select("std_description", "classification")
    return ledger.join(as_lookup(classes), "std_description", "left").select(*ledger.columns, "classification")


def unclassified(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Ledger rows whose standard name no rule knows."""
    names = rules.select(F.col("name").alias("std_description")).distinct()
    return ledger.join(as_lookup(names), "std_description", "left_anti").select(*ledger.columns)


def tag_attributes(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Add channel, exception flag, essential, recurrent and product."""
    tags = tags_by_name(rules).drop("classification")
    return ledger.join(as_lookup(tags), "std_description", "left").select(
        *ledger.columns,
        F.coalesce("channel", F.lit(CHANNEL_SHOP)).alias("channel"),
        F.coalesce("update_exception", F.lit(False)).alias("update_exception"),
        "essential",
        "recurrent",
        "product",
    )


def tag_ledger(ledger: DataFrame, rules: DataFrame, text: str = "description") -> DataFrame:
    """Standardise, classify and tag with one join on the ledger.

    All tags depend on the description alone, so they are worked out once per distinct
    description and joined back. Descriptions that no rule knows are left out there: they stay as they are.
    If the others are few, no row of the ledger is moved.
    """
    texts = ledger.select(text).filter(F.col(text).isNotNull()).distinct()
    names = matched_names(texts, rules, text).select(text, F.col("first_name").alias("std_name"))
    named = texts.join(names, text, "left").select(text, F.coalesce("std_name", text).alias("std_description"))
    known = named.join(as_lookup(tags_by_name(rules)), "std_description", "left")
    dictionary = known.filter((F.col("std_description") != F.col(text)) | F.col("channel").isNotNull())
    tagged = ledger.join(sized_lookup(dictionary, "dictionary"), text, "left")
    return tagged.select(
        *ledger.columns,
        F.coalesce("std_description", text).alias("std_description"),
        "classification",
        F.coalesce("channel", F.lit(CHANNEL_SHOP)).alias("channel"),
        F.coalesce("update_exception", F.lit(False)).alias("update_exception"),
        "essential",
        "recurrent",
        "product",
    )


def _words(term: Column) -> Column:
    """The distinct words of a term."""
    return F.array_distinct(F.regexp_extract_all(term, F.lit(r"(?U)\w+"), F.lit(0)))


def _marks(term: Column) -> Column:
    """The distinct characters of a term that belong to no word, so written that they equal no word."""
    return F.transform(F.array_distinct(F.regexp_extract_all(term, F.lit(r"(?Us)\W"), F.lit(0))), lambda c: F.concat(F.lit(" "), c))


def _inside(term: Column, other: Column) -> Column:
    """Whether a term occurs in another between word boundaries."""
    literal = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.contains(other, term) & F.rlike(other, F.concat(F.lit(r"(?U)(^|\W)"), literal, F.lit(r"(\W|$)")))


def _trimmed_entries(rules: DataFrame) -> DataFrame:
    """One row per term, blanks around it gone: ``(rule_ord, name, classification, pos, term)``."""
    return rule_terms(rules).withColumn("term", trim_all("term"))


def _held_terms(entries: DataFrame) -> DataFrame:
    """Every pair of distinct terms of which one occurs in the other at word boundaries: ``(term, matches_with)``.

    Every word of a term that occurs between boundaries is a whole word of the other. So a term is found through its word that
    the fewest terms hold, in the postings of all terms by word; a term without words through such a character. Then the two are compared.
    """
    distinct = entries.select("term").filter(F.length("term") > 0).distinct()
    keyed = distinct.select("term", _words(F.col("term")).alias("words"), _marks(F.col("term")).alias("marks"))
    postings = keyed.select("term", F.explode(F.concat("words", "marks")).alias("key"))
    counts = postings.groupBy("key").agg(F.count("*").alias("n_terms"))
    own = keyed.select("term", F.explode(F.when(F.size("words") > 0, F.col("words")).otherwise(F.col("marks"))).alias("key"))
    rarest = never_broadcast(own).join(as_lookup(counts), "key").groupBy("term").agg(F.min_by("key", F.struct("n_terms", "key")).alias("key"))
    tried = never_broadcast(postings.withColumnRenamed("term", "matches_with")).join(as_lookup(rarest), "key")
    return tried.filter(_inside(F.col("term"), F.col("matches_with"))).select("term", "matches_with")


def overlap_classes(rules: DataFrame) -> DataFrame:
    """Overlaps between distinct terms, entries counted: ``(term, matches_with, n_entries, n_others, n_pairs)``.

    However many rules list one term, it has one row here. A term that only one entry lists does not overlap itself.
    """
    entries = _trimmed_entries(rules)
    sizes = entries.groupBy("term").agg(F.count("*").alias("n_entries"))
    others = sizes.select(F.col("term").alias("matches_with"), F.col("n_entries").alias("n_others"))
    held = _held_terms(entries)
    counted = held.join(never_broadcast(as_lookup(sizes)), "term").join(never_broadcast(as_lookup(others)), "matches_with")
    same = (F.col("term") == F.col("matches_with")).cast("bigint")
    pairs = F.col("n_entries") * (F.col("n_others") - same)
    return counted.select("term", "matches_with", "n_entries", "n_others", pairs.alias("n_pairs")).filter("n_pairs > 0")


def rule_overlaps(rules: DataFrame) -> DataFrame:
    """Ordered pairs of different term entries where one term occurs inside the other at word boundaries.

    The pairs of distinct terms are found first, then their entries are joined; ``overlap_classes`` counts
    them instead, where a term is listed so often that its pairs are too many to look at.
    """
    entries = _trimmed_entries(rules)
    inner = entries.select("term", F.col("name").alias("entity"), "classification", "rule_ord", "pos")
    outer = entries.select(
        F.col("term").alias("matches_with"),
        F.col("name").alias("other_entity"),
        F.col("classification").alias("other_classification"),
        F.col("rule_ord").alias("other_ord"),
        F.col("pos").alias("other_pos"),
    )
    pairs = as_lookup(_held_terms(entries)).join(never_broadcast(inner), "term").join(never_broadcast(outer), "matches_with")
    return pairs.filter((F.col("rule_ord") != F.col("other_ord")) | (F.col("pos") != F.col("other_pos"))).select(
        "term",
        "entity",
        "classification",
        "matches_with",
        "other_entity",
        "other_classification",
        F.format_string(
            "Overlap: '%s' (%s) occurs in '%s' (%s)", "term", "entity", "matches_with", "other_entity"
        ).alias("summary"),
    )


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rules per classification, most first."""
    return rules.groupBy("classification").agg(F.count("*").alias("n_rules")).orderBy(F.desc("n_rules"), "classification")


def rule_names_by_class(rules: DataFrame) -> DataFrame:
    """The names of each classification in document order, one per row."""
    return rules.join(as_lookup(class_order(rules)), "classification").select("class_ord", "classification", "rule_ord", "name")


def map_category(ledger: DataFrame, groups: DataFrame) -> DataFrame:
    """Add the category: the first group, in group order, that holds the classification."""
    first = groups.groupBy("classification").agg(F.min_by("grp", "grp_ord").alias("category"))
    return ledger.join(first, "classification", "left").select(*ledger.columns, "category")


def groups_table(spark, groups: dict[str, list[str]]) -> DataFrame:
    rows = [(g, i, c) for i, (g, classes) in enumerate(groups.items(), start=1) for c in classes]
    return small_table(spark, rows, GROUPS)
