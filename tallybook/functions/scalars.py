"""Column expressions. All of them stay inside the JVM; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.schema import MONTH_NAMES_IT

# Amounts are added up as exact decimals: 26 digits before the point, and more after it than any currency has.
MONEY = "decimal(38,12)"
# For sums of a few columns, which need a digit more each.
CELL = "decimal(34,12)"
ISO_DATE = "yyyy-MM-dd"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """An amount as exact decimal, so that sums do not depend on row order.

    A double becomes the shortest decimal that stands for it, kept to twelve decimals. One too large to be kept fails the
    job instead of giving null; ``money_problem`` names such values. NaN is no amount.
    """
    return col(c).cast(MONEY)


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def money_problem(c: str | Column) -> Column:
    """Null, or why a double is not kept exactly by :func:`money`."""
    value = col(c).cast("double")
    kept = value.try_cast(MONEY)
    return (
        F.when(F.isnan(value), "no number")
        .when(value.isNotNull() & kept.isNull(), "too large")
        .when(kept.cast("double") != value, "more than 12 decimals")
    )


def total(c: str | Column) -> Column:
    return F.sum(money(c))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0).cast("double"))


def null_if_zero(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(0).cast("double"))


def parse_amount(text: str | Column) -> Column:
    """Italian amount text to double: ``1.234,56``, ``3,60-`` and ``- 3,60``; null if not a number."""
    text = col(text)
    sign = F.when(text.startswith("-") | text.endswith("-"), -1.0).otherwise(1.0)
    plain = F.trim(F.replace(F.replace(F.btrim(text, F.lit("-")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    # Each step is named once: a value repeated in branches is generated, and worked out, again and again.
    return F.regexp_substr(plain, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")).try_cast("double") * sign


def format_amount(amount: str | Column) -> Column:
    """Double to Italian amount text, a trailing minus for negative values."""
    amount = col(amount)
    text = F.translate(F.format_number(F.abs(amount), 2), ",.", ".,")
    return F.when(amount < 0, F.concat(text, F.lit("-"))).otherwise(text)


def parse_date(text: str | Column, fmt: str = ISO_DATE, strict: bool = False) -> Column:
    """Text to date by a fixed format. ``strict`` raises on bad text, else it gives null."""
    return F.to_date(col(text), fmt) if strict else F.try_to_date(col(text), fmt)


def trim_all(text: str | Column) -> Column:
    """Trim Unicode white space of any kind, not only spaces."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def month_name(day: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES_IT]), F.month(col(day)))


def month_end(day: str | Column) -> Column:
    return F.last_day(col(day))


def percent_text(value: str | Column) -> Column:
    """``12.34%``, or a dash where there is no value."""
    return F.coalesce(F.concat(F.bround(col(value), 2).cast("decimal(30,2)").cast("string"), F.lit("%")), F.lit("-"))


def round_even(value: str | Column, digits: int = 2) -> Column:
    return F.bround(col(value), digits)


def short_label(text: str | Column, size: int = 10) -> Column:
    return F.lower(F.substring(col(text), 1, size))


def normalise_header(name: str) -> str:
    return name.replace(" / ", " ").replace(" ", "_").lower()
