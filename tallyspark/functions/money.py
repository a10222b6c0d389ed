"""Amounts: parsing, comparison and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
LARGEST = "9999999999.99"


def _with_decimal_mark(s: Column, mark: str, long: bool = False) -> Column:
    """s read with this decimal mark, the other as thousands in groups of three; null where it doesn't fit."""
    other = "," if mark == "." else "."
    places = "+" if long else "{1,2}"
    fits = s.rlike(rf"^(\d{{1,3}}(\{other}\d{{3}})+|\d+)\{mark}\d{places}\z")
    return F.when(fits, F.replace(F.replace(s, F.lit(other), F.lit("")), F.lit(mark), F.lit(".")))


def _thousands(s: Column, mark: str) -> Column:
    return F.when(s.rlike(rf"^\d{{1,3}}(\{mark}\d{{3}})+\z"), F.replace(s, F.lit(mark), F.lit("")))


def parse_amount(s: Column, decimal_mark: str = ",", to: str = "decimal(18,4)") -> Column:
    """an amount as banks write it; null where it can't be read.

    Tried in turn: one or two places after the declared mark, after the other one, groups of three by the
    declared mark, by the other one, digits only, and more places after either mark.
    """
    other = "," if decimal_mark == "." else "."
    bare = F.regexp_replace(s, r"[^0-9.,+\-]", "")
    negative, body = bare.startswith("-"), F.regexp_replace(bare, r"^[+-]", "")
    text = F.coalesce(
        _with_decimal_mark(body, decimal_mark), _with_decimal_mark(body, other), _thousands(body, decimal_mark), _thousands(body, other),
        F.when(body.rlike(r"^\d+\z"), body), _with_decimal_mark(body, other, True), _with_decimal_mark(body, decimal_mark, True),
    )
    value = text.try_cast(to)
    return F.when(negative, -value).otherwise(value).cast(to)


def receipt_number(s: Column) -> Column:
    """of both marks the right-most is the decimal one; one kind of mark alone is decimal if one or two digits follow."""
    return marked_number(F.regexp_replace(s, r"[^0-9.,]", ""))


def marked_number(bare: Column) -> Column:
    """F02 for texts of nothing but digits, points and commas."""
    comma, dot = F.length(F.substring_index(bare, ",", -1)), F.length(F.substring_index(bare, ".", -1))
    both = bare.contains(",") & bare.contains(".")
    english = F.replace(bare, F.lit(","), F.lit(""))
    german = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    text = F.when(both, F.when(comma < dot, german).otherwise(english)).when(bare.contains(","), F.when(bare.rlike(r"^\d+,\d{1,2}\z"), german).otherwise(english)).otherwise(bare)
    return text.try_cast("decimal(18,4)").try_cast(MONEY)


def money_text(x: Column) -> Column:
    """$1,234.56; null as 'no disponible'."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(x, 2)), F.lit("no disponible"))


def pct_change(now: Column, base: Column) -> Column:
    """percentage change as a double; null where the base is null or 0."""
    return F.when(base != 0, (now.cast("double") - base.cast("double")) / base.cast("double") * 100)


def clamped(x: Column, otherwise: Column | None = None) -> Column:
    """Amounts beyond the column's range become otherwise (default null)."""
    instead = F.lit(None) if otherwise is None else otherwise
    return F.when(F.abs(x) > F.lit(LARGEST).cast("decimal(18,2)"), instead).otherwise(x).cast(MONEY)


def amount_gap(a: Column, b: Column) -> Column:
    """The difference of two amounts without their signs."""
    return F.abs(F.abs(a) - F.abs(b))
