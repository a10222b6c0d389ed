"""Calendar functions. Today is always a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MONTHS_LONG = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
MONTHS_SHORT = tuple(m[:3] for m in MONTHS_LONG)


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def add_months(d: date, n: int) -> date:
    """The first of the month n months on."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, 1)


def month_names(d: Column, short: bool = False) -> Column:
    """F06."""
    return F.element_at(F.array(*[F.lit(m) for m in (MONTHS_SHORT if short else MONTHS_LONG)]), F.month(d))


def days_in_month(d: Column) -> Column:
    """F07."""
    return F.dayofmonth(F.last_day(d))


def age_days(then: Column, now: Column) -> Column:
    """fractional days between two timestamps."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000


def shift_years(d: Column, years: int) -> Column:
    """The same day in another year, 29 February as 28."""
    return F.add_months(d, 12 * years)


def period_start(period: Column) -> Column:
    """the first day of a YYYY-MM period; null if it is no period."""
    return F.when(period.rlike(r"^\d{4}-(0[1-9]|1[0-2])\z"), F.try_to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd"))


def months_until(spark: SparkSession, as_of: date, months: int) -> DataFrame:
    """Month (its first day) of the last months, as_of's own the last of them."""
    if not 1 <= months <= 36:
        raise ValueError("1 to 36 months can be asked for")
    first, last = add_months(as_of, 1 - months), add_months(as_of, 0)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))).alias("month"))
