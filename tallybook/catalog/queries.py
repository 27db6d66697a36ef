"""The registered queries: each runs one operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.catalog import inputs
from tallybook.functions import scalars as S
from tallybook.functions.dates import AsOf, date_context
from tallybook.operators import filters, quality, rule_changes, rules, series
from tallybook.plans import dashboard, drift, load, reports
from tallybook.schema import CATEGORY_GROUPS, COPY_KEY, OWNERS, RAW_LEDGER
from tallybook.session import delete_path, discard, scratch_path, staged
from tallybook.sources import manual, rule_store, statements, tables
from tallybook.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CTX = AsOf.of(inputs.AS_OF)
RANGE = CTX.dashboard_window
DRIFT = CTX.drift_ends
EVENT_DRIFT = ("2024-01-15", "2024-01-29")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- scans, sources, sinks ------------------------------------------------------------


@query
def scan_ledger(spark, sf):
    return inputs.stored_ledger(spark, sf)


@query
def scan_ledger_csv(spark, sf):
    path = scratch_path(spark, "csv")
    inputs.stored_ledger(spark, sf).write.csv(path, header=True)
    return tables.scan_ledger_csv(spark, path)


@query
def type_dates(spark, sf):
    items = inputs.ledger_items(spark, sf)
    text = (
        F.when(F.col("l_returnflag") == "R", inputs.italian_day("booking_date"))
        .when(F.col("l_linestatus") == "F", F.concat(F.date_format("booking_date", "yyyy"), F.lit("-02-30")))
        .otherwise(F.date_format("booking_date", "yyyy-MM-dd"))
    )
    rows = items.select("l_orderkey", "l_linenumber", text.alias("date_text"), text.alias("booking_date"))
    return tables.type_dates(rows, ["booking_date"])


@query
def parse_card_text(spark, sf):
    lines = statements.read_statement_lines(spark, inputs.card_text(spark, sf))
    return statements.parse_card_text(lines).drop("source_file")


@query
def pair_amounts(spark, sf):
    lines = statements.read_statement_lines(spark, inputs.paired_text(spark, sf))
    return statements.pair_amounts(lines).select("txn_text", "booking_text", "description", "amount_text")


@query
def load_card_table(spark, sf):
    return statements.load_card_table(spark, inputs.card_csv(spark, sf)).drop("source_file")


@query
def load_bank_table(spark, sf):
    return statements.load_bank_table(spark, inputs.bank_csv(spark, sf)).drop("source_file")


@query
def load_bank_pages(spark, sf):
    return statements.load_bank_pages(inputs.bank_cells(spark, sf))


@query
def csv_violations(spark, sf):
    schema = T.StructType([T.StructField("reference", T.StringType()), *RAW_LEDGER.fields])
    return tables.csv_violations(spark, inputs.bad_ledger_csv(spark, sf), schema, ["reference"])


@query
def card_violations(spark, sf):
    return statements.card_violations(spark, inputs.bad_card_csv(spark, sf), comma=True, key=["Riferimento"]).drop("source_file")


@query
def bank_violations(spark, sf):
    return statements.bank_violations(spark, inputs.bad_bank_csv(spark, sf), key=["riferimento"]).drop("source_file")


@query
def page_violations(spark, sf):
    return statements.page_violations(inputs.bad_bank_cells(spark, sf))


@query
def manual_violations(spark, sf):
    """Documents of order status P lack their amounts, those of status O hold one too many."""
    return manual.manual_violations(manual.read_manual_documents(spark, inputs.bad_manual_json(spark, sf)))


@query
def load_manual_entries(spark, sf):
    return manual.manual_entries(manual.read_manual_documents(spark, inputs.manual_json(spark, sf)))


@query
def add_provenance(spark, sf):
    lines = statements.read_statement_lines(spark, inputs.card_text(spark, sf))
    placed = tables.add_provenance(lines, "path")
    return placed.groupBy("owner", F.element_at(F.split("source_file", r"\."), -1).alias("extension")).agg(F.count("*").alias("n_lines"))


@query
def sink_csv(spark, sf):
    path = scratch_path(spark, "sink-csv")
    tables.sink_csv(inputs.stored_ledger(spark, sf), path)
    return tables.scan_ledger_csv(spark, path)


@query
def sink_table(spark, sf):
    path = scratch_path(spark, "sink-table")
    tables.sink_parquet(inputs.stored_ledger(spark, sf), path, text_dates=True)
    return tables.scan_ledger(spark, path)


@query
def sink_update_in_place(spark, sf):
    """The stored ledger is replaced by what is read from it: one owner's rows, dated a year later."""
    path = scratch_path(spark, "sink-update")
    tables.sink_parquet(inputs.stored_ledger(spark, sf), path)
    tables.sink_parquet(tables.scan_ledger(spark, path).filter("owner = 'owner_a'").withColumn("txn_date", F.add_months("txn_date", 12)), path)
    return tables.scan_ledger(spark, path)


@query
def export_json(spark, sf):
    return tables.as_json_records(inputs.stored_ledger(spark, sf))


@query
def scan_rules(spark, sf):
    return inputs.flat_rules(rule_store.scan_rules(spark, inputs.rules_json(spark, sf)))


@query
def scan_rules_ordered(spark, sf):
    return inputs.flat_rules(rule_store.scan_rules_ordered(spark, inputs.unnumbered_rules_json(spark, sf)))


# --- filters and expectations -----------------------------------------------------------


@query
def filter_personal(spark, sf):
    return filters.exclude_personal(inputs.stored_ledger(spark, sf)).select(*RAW_LEDGER.fieldNames())


@query
def filter_range(spark, sf):
    return filters.in_range(inputs.stored_ledger(spark, sf), *RANGE).select(*RAW_LEDGER.fieldNames())


@query
def period_split(spark, sf):
    return filters.split_periods(inputs.stored_ledger(spark, sf), *DRIFT).select(*RAW_LEDGER.fieldNames(), "period")


@query
def drop_exceptions(spark, sf):
    return filters.drop_exceptions(inputs.stored_ledger(spark, sf), inputs.ledger_rules(spark))


@query
def slice_by_index(spark, sf):
    return filters.slice_by_index(inputs.stored_ledger(spark, sf), 2).select(*RAW_LEDGER.fieldNames(), "classification")


@query
def ledger_violations(spark, sf):
    return quality.ledger_violations(
        inputs.bad_rows(spark, sf), ["l_orderkey", "l_linenumber"], files=["spesa individuale", "src_F", "src_O"], owners=OWNERS, dates=["txn_date"]
    )


@query
def rules_by_flag(spark, sf):
    return inputs.flat_rules(filters.rules_by_flag(inputs.part_rules(spark, sf), True))


@query
def rules_search(spark, sf):
    return inputs.flat_rules(filters.search_rules(inputs.part_rules(spark, sf), "Old R"))


# --- rules -------------------------------------------------------------------------------


@query
def standardize(spark, sf):
    return rules.standardize(inputs.raw_ledger(spark, sf), inputs.ledger_rules(spark))


@query
def standardize_parts(spark, sf):
    """As many rules as parts, whose terms share their beginnings."""
    return rules.standardize(inputs.part_ledger(spark, sf), inputs.part_rules(spark, sf))


@query
def rule_conflicts(spark, sf):
    found = rules.rule_conflicts(inputs.raw_ledger(spark, sf), inputs.ledger_rules(spark, [inputs.CONFLICT_RULE]))
    return found.select("description", F.array_join("names", "|").alias("names"))


@query
def classify(spark, sf):
    dimension = inputs.ledger_rules(spark)
    return rules.classify(rules.standardize(inputs.raw_ledger(spark, sf), dimension), dimension)


@query
def unclassified(spark, sf):
    dimension = inputs.ledger_rules(spark, without="WIDGET")
    return rules.unclassified(rules.standardize(inputs.raw_ledger(spark, sf), dimension), dimension)


@query
def tag_attributes(spark, sf):
    dimension = inputs.ledger_rules(spark)
    return rules.tag_attributes(rules.standardize(inputs.raw_ledger(spark, sf), dimension), dimension)


@query
def map_category(spark, sf):
    return rules.map_category(inputs.stored_ledger(spark, sf), rules.groups_table(spark, CATEGORY_GROUPS)).select(
        *RAW_LEDGER.fieldNames(), "classification", "category"
    )


@query
def class_summary(spark, sf):
    return reports.class_summary(inputs.stored_ledger(spark, sf), CTX)


@query
def rule_overlaps(spark, sf):
    return rules.rule_overlaps(inputs.part_rules(spark, sf))


@query
def overlap_classes(spark, sf):
    return rules.overlap_classes(inputs.part_rules(spark, sf))


@query
def rule_counts(spark, sf):
    return rules.rule_counts(inputs.part_rules(spark, sf))


@query
def rule_terms(spark, sf):
    return rules.rule_terms(inputs.part_rules(spark, sf)).select("rule_ord", "name", "pos", "term")


@query
def rule_names_by_class(spark, sf):
    return rules.rule_names_by_class(inputs.part_rules(spark, sf))


# --- series and reports --------------------------------------------------------------------


@query
def resample_d(spark, sf):
    return series.resample(inputs.stored_ledger(spark, sf), "D")


@query
def resample_w(spark, sf):
    return series.resample(inputs.stored_ledger(spark, sf), "W")


@query
def resample_m(spark, sf):
    return series.resample(inputs.stored_ledger(spark, sf), "M")


@query
def resample_discounts(spark, sf):
    """Daily sums of amounts with four decimals."""
    return series.resample(inputs.discount_ledger(spark, sf), "D", by=["owner"])


@query
def describe_series(spark, sf):
    return reports.describe_series(inputs.stored_ledger(spark, sf), CTX)


@query
def monthly_totals(spark, sf):
    return reports.monthly_totals(inputs.stored_ledger(spark, sf), CTX)


@query
def class_totals_prev_month(spark, sf):
    return reports.class_totals_prev_month(inputs.stored_ledger(spark, sf), CTX)


@query
def class_delta_ytd(spark, sf):
    return reports.class_delta_ytd(inputs.stored_ledger(spark, sf), CTX)


@query
def expense_matrix(spark, sf):
    return reports.expense_matrix(inputs.stored_ledger(spark, sf), CTX)


@query
def expense_matrix_mean(spark, sf):
    return reports.expense_report(inputs.stored_ledger(spark, sf), CTX)


@query
def expense_report_forecast(spark, sf):
    return reports.expense_report(inputs.stored_ledger(spark, sf), CTX, forecast=True)


@query
def budget_pivot(spark, sf):
    return reports.budget_pivot(inputs.stored_ledger(spark, sf), CTX)


@query
def budget_delta(spark, sf):
    return reports.budget_delta(inputs.stored_ledger(spark, sf), CTX)


@query
def budget_cube(spark, sf):
    return reports.budget_cube(inputs.stored_ledger(spark, sf), CTX, CTX.day.year - 1)


@query
def forecast_monthly(spark, sf):
    matrix = reports.expense_matrix(inputs.stored_ledger(spark, sf), start="1995-01-01", end=CTX.prev_month_end)
    future = series.forecast_months(reports.melt_matrix(matrix), 3, ["series"])
    return future.select("series", "bucket", F.round("total", 4).alias("total"))


@query
def class_trend(spark, sf):
    return dashboard.class_trend(dashboard.class_series(inputs.stored_ledger(spark, sf), *RANGE))


# --- dashboard -----------------------------------------------------------------------------


def dashboard_rows(spark: SparkSession, sf: str) -> DataFrame:
    return filters.in_range(inputs.stored_ledger(spark, sf), *RANGE)


@query
def top_vendors(spark, sf):
    return dashboard.top_vendors(dashboard_rows(spark, sf), 10)


@query
def channel_share(spark, sf):
    return dashboard.channel_share(dashboard_rows(spark, sf))


@query
def product_share(spark, sf):
    return dashboard.product_share(dashboard_rows(spark, sf))


@query
def flag_shares(spark, sf):
    return dashboard.flag_shares(dashboard_rows(spark, sf))


@query
def flag_trend(spark, sf):
    return dashboard.flag_trend(dashboard_rows(spark, sf))


@query
def class_series(spark, sf):
    return dashboard.class_series(inputs.stored_ledger(spark, sf), *RANGE)


@query
def class_cumsum(spark, sf):
    return dashboard.class_cumsum(dashboard.class_series(inputs.stored_ledger(spark, sf), *RANGE))


@query
def year_compare(spark, sf):
    return dashboard.year_compare(inputs.stored_ledger(spark, sf), *RANGE)


@query
def year_stats(spark, sf):
    return dashboard.year_stats(inputs.stored_ledger(spark, sf), *RANGE)


@query
def year_cumsum(spark, sf):
    return dashboard.year_cumsum(inputs.stored_ledger(spark, sf), *RANGE)


# --- quality -------------------------------------------------------------------------------


@query
def duplicates(spark, sf):
    return quality.duplicates(inputs.with_redelivery(spark, sf))


@query
def dedup_suffix(spark, sf):
    return quality.dedup_suffix(inputs.with_redelivery(spark, sf))


@query
def derived_fees(spark, sf):
    by_month = inputs.raw_ledger(spark, sf).withColumn(
        "source_file", F.concat("source_file", F.lit("_"), F.date_format("txn_date", "yyyy-MM"))
    )
    return quality.stamp_duty(by_month, "2001-01-01", "77.47", "2.00", "imposta di bollo")


@query
def ledger_sorted(spark, sf):
    return quality.newest_first(inputs.stored_ledger(spark, sf))


@query
def union_sources(spark, sf):
    stored = inputs.stored_ledger(spark, sf).select(*RAW_LEDGER.fieldNames(), "std_description", "classification", "channel")
    return quality.union_sources(stored, inputs.raw_ledger(spark, sf))


# --- drift ---------------------------------------------------------------------------------


@query
def drift_new_values(spark, sf):
    ledger = inputs.stored_ledger(spark, sf)
    return drift.new_values(ledger.filter(~((F.col("std_description") == "WIDGET") & (F.col("txn_date") <= F.lit(DRIFT[0])))), *DRIFT)


@query
def numeric_profile(spark, sf):
    daily = series.resample(inputs.stored_ledger(spark, sf), "D", by=["classification"])
    return drift.numeric_profile(daily, ["classification"])


@query
def drift_numeric(spark, sf):
    return drift.drift_numeric(drift.drift_series(inputs.events_ledger(spark, sf), *EVENT_DRIFT))


@query
def drift_histogram(spark, sf):
    return drift.drift_histogram(drift.drift_series(inputs.events_ledger(spark, sf), *EVENT_DRIFT))


# --- scalars -------------------------------------------------------------------------------


@query
def scalar_functions(spark, sf):
    items = inputs.ledger_items(spark, sf)
    text = S.format_amount(F.when(F.col("l_returnflag") == "R", -F.col("amount")).otherwise(F.col("amount")))
    short_day = F.date_format("txn_date", "dd/MM/yy")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        text.alias("amount_text"),
        S.parse_amount(text).alias("amount_trailing"),
        S.parse_amount(F.concat(F.lit("- "), S.format_amount("amount"))).alias("amount_leading"),
        S.parse_amount("description").alias("amount_none"),
        F.abs(-F.col("amount")).alias("amount_abs"),
        S.parse_date(inputs.italian_day("txn_date"), "dd/MM/yyyy").alias("day_first"),
        S.parse_date(short_day, "dd/MM/yy").alias("short_year"),
        S.month_name("txn_date").alias("month_name"),
        S.month_end("txn_date").alias("month_end"),
        F.trunc("txn_date", "month").alias("month_start"),
        F.date_sub("txn_date", 365).alias("year_before"),
        F.add_months("booking_date", -12).alias("months_before"),
        S.round_even(F.col("amount") / 7, 2).alias("rounded_2"),
        S.round_even(F.floor("amount") / 2, 0).alias("rounded_0"),
        S.percent_text(F.floor("amount") / 100).alias("percent"),
        S.short_label(F.concat(F.upper("description"), F.lit(" STORE"))).alias("label"),
        F.concat("description", F.lit("_"), F.col("l_linenumber").cast("string")).alias("suffixed"),
        S.null_if_zero(F.col("l_linenumber").cast("double") - 1).alias("zero_as_null"),
        S.zero_if_null(S.null_if_zero(F.col("l_linenumber").cast("double") - 1)).alias("null_as_zero"),
        S.trim_all(F.concat(F.lit(" \t"), F.col("description"), F.lit(" \n"))).alias("trimmed"),
        F.date_diff("booking_date", "txn_date").alias("days_between"),
        F.contains(F.col("description"), F.lit("d r")).alias("has_literal"),
    )


@query
def date_context_fields(spark, sf):
    days = inputs.stored_ledger(spark, sf).select("txn_date").distinct()
    return days.select("txn_date", *[c.alias(n) for n, c in date_context("txn_date").items()])


REGISTRY["date_context"] = REGISTRY.pop("date_context_fields")


# --- bundles -------------------------------------------------------------------------------


@query
def load_ledger(spark, sf):
    """History is all but the returned lines; those arrive twice, from two files. The tables are joined once."""
    items = staged(inputs.ledger_items(spark, sf).select(*RAW_LEDGER.fieldNames(), "l_returnflag"), "items")
    history = items.filter("l_returnflag <> 'R'").select(*RAW_LEDGER.fieldNames())
    returned = items.filter("l_returnflag = 'R'").select(*RAW_LEDGER.fieldNames())
    again = returned.withColumn("source_file", F.lit("redelivered"))
    loaded = load.load_ledger(
        history, returned, again, rules=inputs.ledger_rules(spark), include_personal=False, de_duplicate=True, stage=scratch_path(spark, "stage")
    )
    # What was loaded is read from its stage.
    discard(items)
    return loaded


@query
def load_from_statements(spark, sf):
    """Folders of three kinds, with the fees of card files; the history is one source of the ledger itself."""
    history = inputs.raw_ledger(spark, sf).filter("source_file = 'src_P'")
    sources = inputs.statement_folders(spark, sf)
    return load.load_from_statements(spark, sources, inputs.ledger_rules(spark), history, inputs.FEES).drop("source_file")


@query
def report_long(spark, sf):
    return reports.report_long(inputs.stored_ledger(spark, sf), CTX)


@query
def dashboard_long(spark, sf):
    return dashboard.dashboard_long(inputs.stored_ledger(spark, sf), CTX)


@query
def validate_ledger_slice(spark, sf):
    return drift.validate_long(inputs.stored_ledger(spark, sf), *DRIFT, slice_index=2)


@query
def validate_long(spark, sf):
    return drift.validate_long(inputs.events_ledger(spark, sf), *EVENT_DRIFT)


@query
def stream_ingest(spark, sf):
    """All rows arrive as CSV files; those of returned lines arrive again in a second run."""
    items = inputs.ledger_items(spark, sf)
    root = scratch_path(spark, "stream")
    source, target = f"{root}/in", f"{root}/ledger"
    dimension = inputs.ledger_rules(spark)
    raw = RAW_LEDGER.fieldNames()
    items.select(*raw).write.csv(f"{source}/first", header=True)
    ingest.ingest(spark, f"{source}/*", target, f"{root}/state", dimension)
    items.filter("l_returnflag = 'R'").withColumn("source_file", F.lit("redelivered")).select(*raw).write.csv(f"{source}/second", header=True)
    ingest.ingest(spark, f"{source}/*", target, f"{root}/state", dimension)
    return ingest.ledger_so_far(spark, target).select(*COPY_KEY, "channel", "status")


@query
def stream_statements(spark, sf):
    """Card text and bank exports arrive as files, then returned card rows once more as a ledger file."""
    sources, root = inputs.statement_folders(spark, sf), scratch_path(spark, "stream-statements")
    again = inputs.ledger_items(spark, sf).filter("l_returnflag = 'R' and l_linestatus = 'F'").withColumns({
        "amount": -F.col("amount"), "source_file": F.lit("redelivered"), "owner": F.concat("owner", F.date_format("txn_date", "_yyyy-MM")),
    })
    again.select(*RAW_LEDGER.fieldNames()).write.csv(f"{root}/again", header=True)
    kinds = {"card_text": f"{sources['card_text']}/*", "bank_csv": f"{sources['bank_csv']}/*", "ledger_csv": f"{root}/again"}
    ingest.ingest_statements(spark, kinds, f"{root}/ledger", f"{root}/state", inputs.ledger_rules(spark))
    return ingest.ledger_so_far(spark, f"{root}/ledger").select(*COPY_KEY, "channel", "status")


@query
def stream_two_sources(spark, sf):
    """Two streams bring the same rows; then all batches are compacted.

    The tables are joined once, the files are packed, and those of a stream go when it has ended.
    """
    root, dimension = scratch_path(spark, "stream-two"), inputs.ledger_rules(spark)
    rows = staged(inputs.raw_ledger(spark, sf), "rows")

    for name, part in (("one", rows.filter("owner = 'owner_a'")), ("two", rows.withColumn("source_file", F.lit("second")))):
        arrived = f"{root}/in/{name}"
        part.write.option("maxRecordsPerFile", 1_000_000).csv(arrived, header=True, compression="gzip")
        if name == "two":
            discard(rows)
        ingest.ingest(spark, arrived, f"{root}/ledger", f"{root}/state/{name}", dimension, compact_after=1)
        delete_path(spark, arrived)
    return ingest.ledger_so_far(spark, f"{root}/ledger").select(*COPY_KEY, "source_file", "status")


# --- rule maintenance ------------------------------------------------------------------------


def new_rule_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A document per part; those of PROMO parts take a new name, the others clash."""
    return inputs.table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("seq"),
        F.concat(F.when(F.col("p_type") == "PROMO", F.lit("NEW ")).otherwise(F.lit("")), F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("viaggi").alias("classification"),
        F.array("p_name").alias("descriptions"),
        F.when(F.col("p_size") > 25, True).alias("web"),
    )


@query
def rules_insert(spark, sf):
    return inputs.flat_rules(rule_changes.insert_rules(inputs.part_rules(spark, sf), new_rule_docs(spark, sf)))


@query
def rules_update(spark, sf):
    """PROMO parts get two updates of one field, ECONOMY parts one of another."""
    part = inputs.table(spark, sf, "part").withColumn("name", F.concat(F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string")))
    promo, economy = part.filter("p_type = 'PROMO'"), part.filter("p_type = 'ECONOMY'")
    blank = F.lit(None)
    updates = (
        promo.select(F.lit(1).alias("seq"), "name", F.lit("casa").alias("classification"), blank.cast("int").alias("essential"))
        .unionByName(promo.select(F.lit(2).alias("seq"), "name", F.lit("auto").alias("classification"), blank.cast("int").alias("essential")))
        .unionByName(economy.select(F.lit(3).alias("seq"), "name", blank.cast("string").alias("classification"), F.lit(1).alias("essential")))
    )
    return inputs.flat_rules(rule_changes.update_rules(inputs.part_rules(spark, sf), updates))


def _names_of(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    part = inputs.table(spark, sf, "part").filter(condition)
    sku = F.concat(F.lit("sku "), F.col("p_partkey").cast("string"))
    return part.select(
        (F.col("p_partkey") + 1).alias("seq"),
        F.concat(F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.concat("p_name", F.lit(" "), sku).alias("term"),
        "p_size",
        "p_type",
        "p_name",
        "p_partkey",
    )


@query
def rules_add_term(spark, sf):
    adds = _names_of(spark, sf, "p_type in ('PROMO', 'LARGE')").select("seq", "name", "term")
    return inputs.flat_rules(rule_changes.add_terms(inputs.part_rules(spark, sf), adds))


@query
def rules_remove_term(spark, sf):
    removals = _names_of(spark, sf, "p_type in ('PROMO', 'LARGE')").select("name", "term")
    return inputs.flat_rules(rule_changes.remove_terms(inputs.part_rules(spark, sf), removals))


@query
def rules_rename(spark, sf):
    renames = _names_of(spark, sf, "p_type = 'SMALL'").select("name", F.concat(F.col("name"), F.lit(" BIS")).alias("new_name"))
    return inputs.flat_rules(rule_changes.rename_rules(inputs.part_rules(spark, sf), renames))


@query
def rules_rename_chain(spark, sf):
    """SMALL parts are renamed twice in a row, LARGE ones in the wrong order, PROMO ones back again; ECONOMY ones pass one name down the table."""
    part = _names_of(spark, sf, "true")
    at = lambda step: F.col("seq") * 10 + step
    link = lambda step: F.concat(F.lit("LINK "), (F.col("p_partkey") + step).cast("string"))

    def rename(kind: str, step: int, old: Column, new: Column) -> Column:
        return F.when(F.col("p_type") == kind, F.struct(at(step).cast("bigint").alias("seq"), old.alias("name"), new.alias("new_name")))

    name, bis, ter = F.col("name"), F.concat("name", F.lit(" BIS")), F.concat("name", F.lit(" TER"))
    handed_on = F.struct(at(5).cast("bigint").alias("seq"), link(0).alias("name"), link(1).alias("new_name"))
    steps = F.array(
        rename("SMALL", 1, name, bis), rename("SMALL", 2, bis, ter), rename("LARGE", 1, bis, ter), rename("LARGE", 2, name, bis),
        rename("PROMO", 1, name, bis), rename("PROMO", 2, bis, name), rename("PROMO", 3, bis, ter), rename("ECONOMY", 1, name, link(0)), handed_on,
    )
    renames = part.select(F.explode(F.filter(steps, lambda r: r.isNotNull())).alias("r")).select("r.*")
    return inputs.flat_rules(rule_changes.rename_rules(inputs.part_rules(spark, sf), renames))


@query
def rules_remove(spark, sf):
    return inputs.flat_rules(rule_changes.remove_rules(inputs.part_rules(spark, sf), _names_of(spark, sf, "p_size <= 20")))


@query
def rules_clear_exceptions(spark, sf):
    """Keeps the exception rule that comes first by name."""
    part = inputs.part_rules(spark, sf)
    keep = part.filter("update_exception").agg(F.min("name")).first()[0]
    return inputs.flat_rules(rule_changes.clear_exceptions(part, keep))


def rule_change_set(spark: SparkSession, sf: str) -> DataFrame:
    """Changes for every part, by its type.

    ECONOMY: removed, and the large ones inserted anew. LARGE: the first term removed
    three times, then added. MEDIUM: updated twice. PROMO: an insert that is refused,
    then a term added. SMALL: renamed. STANDARD: a new rule, which then gets a term.
    """
    part = _names_of(spark, sf, "true")
    types = {f.name: f.dataType for f in rule_changes.CHANGES.fields}
    missing = F.lit(None)

    def change(kind: str, step: int, op: str, when=F.lit(True), **fields):
        given = {"seq": F.col("seq") * 10 + step, "op": F.lit(op), "name": F.col("name"), **fields}
        record = F.struct(*[given.get(f, missing).cast(t).alias(f) for f, t in types.items()])
        return F.when((F.col("p_type") == kind) & when, record)

    term, new_name = F.col("term"), F.concat(F.lit("NEW "), F.col("name"))
    records = F.array(
        change("ECONOMY", 1, "add_term", term=F.lit("lost")),
        change("ECONOMY", 2, "remove"),
        change("ECONOMY", 3, "insert", F.col("p_size") > 25, classification=F.lit("salute"), descriptions=F.array(F.lit("again"))),
        change("LARGE", 1, "remove_term", term=term),
        change("LARGE", 2, "remove_term", term=term),
        change("LARGE", 3, "remove_term", term=term),
        change("LARGE", 4, "add_term", term=term),
        change("MEDIUM", 1, "update", essential=F.lit(1), web=F.lit(True)),
        change("MEDIUM", 2, "update", classification=F.lit("salute"), essential=F.lit(2)),
        change("PROMO", 1, "insert", classification=F.lit("salute")),
        change("PROMO", 2, "add_term", term=F.lit("added")),
        change("SMALL", 1, "rename", new_name=F.concat(F.col("name"), F.lit(" BIS"))),
        change("STANDARD", 1, "insert", name=new_name, classification=F.lit("asporto"), descriptions=F.array(F.lit("one"))),
        change("STANDARD", 2, "add_term", name=new_name, term=F.lit("two")),
    )
    return part.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")


@query
def rules_apply_changes(spark, sf):
    return inputs.flat_rules(rule_changes.apply_rule_changes(inputs.part_rules(spark, sf), rule_change_set(spark, sf)))
