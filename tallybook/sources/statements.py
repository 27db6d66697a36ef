"""Card and bank statements: extracted text, tabular exports and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.scalars import normalise_header, parse_amount, parse_date
from tallybook.schema import BANK_BLANK_PATCH, CARD_PAYMENT_MARK, RAW_LEDGER
from tallybook.sources.checked import Field, accept, check, violations
from tallybook.sources.tables import provenance

# Fixed patterns of the statement format.
TRANSACTION_LINE = r"(?U)\d{2}/\d{2}/\d{4}\s\d{2}/\d{2}/\d{4}\s.+"
AMOUNT = r"[\d.]*\d,\d{2}-?"
AMOUNT_NO_THOUSANDS = r"\d+,\d{2}-?"
CARD_HEADERS = {
    "Data Operazione": "txn_date",
    "Data Registrazione": "booking_date",
    "Descrizione Operazione": "description",
    "Importo (€)": "amount",
}
BANK_HEADERS = {"data_contabile": "txn_date", "data_valuta": "booking_date", "causale_descrizione": "description", "importo": "amount"}
BANK_DROPPED = ["canale", "divisa"]
BANK_AMOUNT_HEADER = "USCITE"

# A power of two.
LINES_PER_BLOCK = 1 << 16


def read_statement_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Statement text line by line: ``(path, block, pos, line)``.

    A large file is read in splits, so no file has to fit in one task. Lines are ordered
    by block and then by position. A block is a run of at most ``LINES_PER_BLOCK`` lines
    of a split: its number is the split's offset plus the run, which stays below the
    next split's offset because a run holds more bytes than one.
    """
    pos = F.monotonically_increasing_id()
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        pos.alias("pos"),
        F.col("value").alias("line"),
    )
    # The low 33 bits of the position count the lines of the task.
    run = F.shiftright(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)), LINES_PER_BLOCK.bit_length() - 1)
    return rows.select("path", (F.col("split") + run).alias("block"), "pos", "line")


def lines_of(documents: DataFrame, text: str = "text", path: str = "path", lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """The same lines from whole documents held in a column."""
    return documents.select(path, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(
        path, F.floor(F.col("pos") / lines_per_block).alias("block"), F.col("pos").cast("bigint").alias("pos"), "line"
    )


def pair_amounts(lines: DataFrame, amount_pattern: str = AMOUNT) -> DataFrame:
    """Transaction lines with their amounts: ``(path, k, txn_text, booking_text, description, amount_text)``.

    A line's first amount is taken only while fewer amounts than transactions have
    been seen, and the k-th taken amount belongs to the k-th transaction. With ``d``
    and ``x`` the running counts of transactions and of lines with an amount, the
    amounts taken up to a line are ``x + least(0, running min(d - x))``. The running
    values are built per block and shifted by the totals of the blocks before, so a
    file of any size is spread over tasks. A transaction without an amount keeps null.
    """
    # Both marks are cheap to test, so most other lines go before a pattern is tried.
    likely = lines.filter(F.contains("line", F.lit(",")) | F.contains("line", F.lit("/")))
    # One column holds both finds, neither of which has a line end. So the totals of blocks and the rows themselves need the same
    # columns, and the lines are read and moved once for both.
    both = F.concat_ws("\n", F.regexp_extract("line", amount_pattern, 0), F.regexp_extract("line", TRANSACTION_LINE, 0))
    found = likely.select("path", "block", "pos", both.alias("both")).repartition("path", "block").withColumns({
        "is_txn": (~F.endswith("both", F.lit("\n"))).cast("bigint"),
        "has_amount": (~F.startswith("both", F.lit("\n"))).cast("bigint"),
    })

    in_block = Window.partitionBy("path", "block").orderBy("pos")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = found.withColumns({"d": F.sum("is_txn").over(so_far), "x": F.sum("has_amount").over(so_far)})
    local = local.withColumn("low", F.min(F.col("d") - F.col("x")).over(so_far))

    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        local.groupBy("path", "block")
        .agg(F.max("d").alias("d_end"), F.max("x").alias("x_end"), F.min("low").alias("low_end"))
        .withColumns({
            "d0": F.coalesce(F.sum("d_end").over(before), F.lit(0)),
            "x0": F.coalesce(F.sum("x_end").over(before), F.lit(0)),
        })
        .withColumn("low0", F.least(F.lit(0), F.min(F.col("d0") - F.col("x0") + F.col("low_end")).over(before)))
        .select("path", "block", "d0", "x0", "low0")
    )
    shifted = local.join(starts, ["path", "block"])
    taken = F.col("x0") + F.col("x") + F.least("low0", F.col("d0") - F.col("x0") + F.col("low"))
    shifted = shifted.withColumns({"txn_no": F.col("d0") + F.col("d"), "taken": taken})
    previous = F.coalesce(F.lag("taken").over(in_block), F.col("x0") + F.col("low0"))
    shifted = shifted.withColumn("is_taken", F.col("taken") > previous)

    shifted = shifted.withColumns({"amount_text": F.substring_index("both", "\n", 1), "txn_line": F.substring_index("both", "\n", -1)})
    nothing = F.lit(None).cast("string")
    # A line that pairs with itself goes on as one row.
    own = (F.col("is_txn") == 1) & F.col("is_taken") & (F.col("txn_no") == F.col("taken"))
    as_txn = F.when(F.col("is_txn") == 1, F.struct(F.col("txn_no").alias("k"), "txn_line", F.when(own, F.col("amount_text")).alias("amount_text")))
    as_amount = F.when(F.col("is_taken") & ~own, F.struct(F.col("taken").alias("k"), nothing.alias("txn_line"), "amount_text"))
    halves = shifted.select("path", F.explode(F.filter(F.array(as_txn, as_amount), lambda e: e.isNotNull())).alias("e")).select("path", "e.*")
    # Two rows at most share a (k, path), so aggregating before the shuffle would not pay. Sorting looks at the number first, at long paths last.
    whole = halves.repartition("k", "path").groupBy("k", "path").agg(
        F.max("txn_line").alias("txn_line"), F.max("amount_text").alias("amount_text")
    )
    return whole.select(
        "path",
        "k",
        F.substring("txn_line", 1, 10).alias("txn_text"),
        F.substring("txn_line", 12, 10).alias("booking_text"),
        F.expr("substring(txn_line, 23)").alias("description"),
        "amount_text",
    )


def parse_card_text(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """Raw ledger rows of card statement text. ``legacy`` ignores thousands groups in amounts."""
    paired = pair_amounts(lines, AMOUNT_NO_THOUSANDS if legacy else AMOUNT)
    owner, source_file = provenance("path")
    return paired.select(
        parse_date("txn_text", "dd/MM/yyyy").alias("txn_date"),
        parse_date("booking_text", "dd/MM/yyyy").alias("booking_date"),
        "description",
        parse_amount("amount_text").alias("amount"),
        source_file,
        owner,
    )


def unpaired_files(paired: DataFrame) -> DataFrame:
    """Files with fewer amounts than transactions: ``(path, n_transactions, n_amounts)``."""
    return (
        paired.groupBy("path")
        .agg(F.count("*").alias("n_transactions"), F.count("amount_text").alias("n_amounts"))
        .filter("n_transactions <> n_amounts")
    )


def _amount(column: str, comma: bool) -> Column:
    """An amount as the file writes it.

    ``1.234`` is a thousand and more only where the file is said to write a decimal comma; a value that
    holds a comma is no plain number in any file.
    """
    return parse_amount(column) if comma else F.when(F.contains(F.col(column), F.lit(",")), parse_amount(column)).otherwise(F.col(column).try_cast("double"))


def _days(fmt: str) -> list[Field]:
    return [Field(c, F.col(c), parse_date(c, fmt), required=True) for c in ("txn_date", "booking_date")]


def check_card_table(spark: SparkSession, path: str | list[str], comma: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Card statements as CSV: rows with a blank in any column (totals, comments) go, the others are typed and checked."""
    table = spark.read.csv(path, header=True, recursiveFileLookup=True)
    owner, source_file = provenance()
    named = table.select("*", owner, source_file).dropna("any", subset=table.columns).withColumnsRenamed(CARD_HEADERS)
    fields = [*_days("dd/MM/yyyy"), Field("amount", F.col("amount"), _amount("amount", comma), required=True)]
    return check(named, fields, ["description", "source_file", "owner", *(carry or [])])


def load_card_table(
    spark: SparkSession, path: str | list[str], comma: bool = False, strict: bool = False, observation: Observation | None = None
) -> DataFrame:
    """Raw ledger rows of card statements as CSV: complete rows only, dates day first.

    ``comma`` says that the file writes amounts with a decimal comma, so that points mark thousands. What cannot be read is null and
    listed by ``card_violations``; ``strict`` fails on it, ``observation`` counts it.
    """
    return accept(check_card_table(spark, path, comma), RAW_LEDGER.fieldNames(), strict, observation)


def card_violations(spark: SparkSession, path: str | list[str], comma: bool = False, key: list[str] | None = None) -> DataFrame:
    """The values that ``load_card_table`` cannot read; ``key`` names further columns of the table that tell its rows apart."""
    return violations(check_card_table(spark, path, comma, key), ["source_file", "owner", *(key or [])])


def check_bank_table(spark: SparkSession, path: str | list[str], comma: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Bank exports as CSV: expenses and rows whose amount is missing or unreadable, typed and checked."""
    table = spark.read.csv(path, header=True, recursiveFileLookup=True)
    owner, source_file = provenance()
    with_source = table.select("*", owner, source_file)
    tidy = with_source.toDF(*[normalise_header(c) for c in with_source.columns]).drop(*BANK_DROPPED).withColumnsRenamed(BANK_HEADERS)
    amount = _amount("amount", comma)
    fields = [*_days("dd/MM/yyyy"), Field("amount", F.col("amount"), F.abs(amount), required=True)]
    return check(tidy.filter(F.coalesce(amount <= 0, F.lit(True))), fields, ["description", "source_file", "owner", *(carry or [])])


def load_bank_table(
    spark: SparkSession, path: str | list[str], strict: bool = False, comma: bool = False, observation: Observation | None = None
) -> DataFrame:
    """Bank exports as CSV: expenses only, amounts made positive.

    ``comma`` says that the file writes amounts with a decimal comma, so that points mark thousands. A row whose amount cannot be read is
    kept with a null amount. What cannot be read is listed by ``bank_violations``; ``strict`` fails on it, ``observation`` counts it.
    """
    return accept(check_bank_table(spark, path, comma), RAW_LEDGER.fieldNames(), strict, observation)


def bank_violations(spark: SparkSession, path: str | list[str], comma: bool = False, key: list[str] | None = None) -> DataFrame:
    """The values that ``load_bank_table`` cannot read; ``key`` names further columns of the export, as normalised."""
    return violations(check_bank_table(spark, path, comma, key), ["source_file", "owner", *(key or [])])


def check_bank_pages(
    cells: DataFrame,
    amount_header: str = BANK_AMOUNT_HEADER,
    drop_containing: str = CARD_PAYMENT_MARK,
    blank_patch: tuple[str, str, str] = BANK_BLANK_PATCH,
) -> DataFrame:
    """Bank page tables ``(file, owner, page, row_no, cells)``: expenses and rows with an unreadable amount, typed and checked.

    Row 0 of a page is skipped and row 1 names the columns; pages without the amount column are ignored.
    """
    headers = cells.filter("row_no = 1").select(
        "file", "owner", "page", F.array_position("cells", amount_header).cast("int").alias("amount_at")
    ).filter("amount_at > 0")
    body = cells.filter("row_no > 1").join(headers, ["file", "owner", "page"]).select(
        F.col("file").alias("source_file"),
        "owner",
        "page",
        "row_no",
        F.try_element_at("cells", F.col("amount_at")).alias("spent"),
        F.get("cells", F.lit(0)).alias("booking_date"),
        F.get("cells", F.lit(1)).alias("txn_date"),
        F.get("cells", F.lit(3)).alias("amount"),
        F.try_element_at("cells", F.lit(-1)).alias("description"),
    )
    # A page row without a last cell mentions no card payment.
    kept = body.filter((F.col("spent") != "") & ~F.contains(F.coalesce("description", F.lit("")), F.lit(drop_containing)))
    patches = dict(zip(("booking_date", "txn_date", "amount"), blank_patch))
    blank = F.col("booking_date") == ""
    patched = kept.withColumns({c: F.when(blank, F.lit(p)).otherwise(F.col(c)) for c, p in patches.items()})
    amount = parse_amount("amount")
    fields = [*_days("dd/MM/yy"), Field("amount", F.col("amount"), F.abs(amount), required=True)]
    return check(patched.filter(F.coalesce(amount <= 0, F.lit(True))), fields, ["description", "source_file", "owner", "page", "row_no"])


def load_bank_pages(cells: DataFrame, strict: bool = False, observation: Observation | None = None, **layout) -> DataFrame:
    """Raw ledger rows of bank page tables; ``layout`` as in ``check_bank_pages``.

    What cannot be read is null and listed by ``page_violations``; ``strict`` fails on it, ``observation`` counts it.
    """
    return accept(check_bank_pages(cells, **layout), RAW_LEDGER.fieldNames(), strict, observation)


def page_violations(cells: DataFrame, **layout) -> DataFrame:
    """The values that ``load_bank_pages`` cannot read: ``(source_file, owner, page, row_no, column, value, problem)``."""
    return violations(check_bank_pages(cells, **layout), ["source_file", "owner", "page", "row_no"])
