"""Spend dashboards (A01-A13, W02-W03): conditional aggregation in one scan wherever windows are compared."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_months, month_start, months_until
from ..functions.money import pct_change
from ..functions.text import category_key, category_label, category_order, category_varies, no_category

TOTAL = "decimal(18,2)"


def of_company(rows: DataFrame, company: str | None) -> DataFrame:
    """The tenant's rows, or all."""
    return rows if company is None else rows.where(F.col("company_id") == company)


def in_window(day: Column, start: date, end: date) -> Column:
    """Start <= day < end."""
    return (day >= F.lit(start)) & (day < F.lit(end))


def total(amount: Column, where: Column | None = None) -> Column:
    x = amount if where is None else F.when(where, amount)
    return F.coalesce(F.sum(x), F.lit(0)).cast(TOTAL)


def period_total(receipts: DataFrame, start: date, end: date, company: str | None = None) -> DataFrame:
    """Amount and number of the receipts of start <= date < end; provisional dates don't count."""
    rows = of_company(receipts, company).where(in_window(F.col("expense_date"), start, end) & ~F.col("date_provisional"))
    return rows.agg(total(F.col("total_amount")).alias("amount"), F.count(F.lit(1)).alias("receipts"))


def _compared(receipts: DataFrame, now: tuple[date, date], before: tuple[date, date], company: str | None) -> DataFrame:
    day, amount = F.col("expense_date"), F.col("total_amount")
    rows = of_company(receipts, company).where((in_window(day, *now) | in_window(day, *before)) & ~F.col("date_provisional"))
    sums = rows.agg(
        total(amount, in_window(day, *now)).alias("amount"), F.count_if(in_window(day, *now)).alias("receipts"),
        total(amount, in_window(day, *before)).alias("amount_before"), F.count_if(in_window(day, *before)).alias("receipts_before"),
    )
    return sums.withColumns({"delta": (F.col("amount") - F.col("amount_before")).cast(TOTAL), "change_pct": F.round(pct_change(F.col("amount"), F.col("amount_before")), 6)})


def month_on_month(receipts: DataFrame, as_of: date, company: str | None = None) -> DataFrame:
    """as_of's month against the month before; change_pct is null on a base of 0."""
    this, last, after = add_months(as_of, 0), add_months(as_of, -1), add_months(as_of, 1)
    return _compared(receipts, (this, after), (last, this), company)


def month_to_date(receipts: DataFrame, as_of: date, company: str | None = None, legacy_cut: bool = False) -> DataFrame:
    """as_of's month so far against the month before up to the same day (within that month's length).
    The day itself counts unless legacy_cut."""
    this, last = add_months(as_of, 0), add_months(as_of, -1)
    same = last.replace(day=min(as_of.day, monthrange(last.year, last.month)[1]))
    step = timedelta(days=0 if legacy_cut else 1)
    return _compared(receipts, (this, as_of + step), (last, same + step), company)


def spend_by_category(receipts: DataFrame, start: date, end: date, company: str | None = None, whole: Column | None = None) -> DataFrame:
    """Amount, number and share by category key in canonical order, unclassified last but for unknown keys' place after all."""
    rows = of_company(receipts, company).where(in_window(F.col("expense_date"), start, end) & ~F.col("date_provisional"))
    sums = rows.groupBy(category_key(F.col("category")).alias("category")).agg(total(F.col("total_amount")).alias("amount"), F.count(F.lit(1)).alias("receipts"))
    base = F.sum("amount").over(Window.partitionBy()) if whole is None else whole  # one row for each category
    share = F.when(base != 0, F.col("amount").cast("double") / base.cast("double")).otherwise(0.0)
    key = F.col("category")
    return sums.select(key, category_label(key).alias("label"), category_varies(key).alias("varies"), category_order(key).alias("position"), "amount", "receipts", F.round(share, 6).alias("share")).orderBy("position", "category")


def monthly_trend(receipts: DataFrame, as_of: date, months: int = 12, company: str | None = None) -> DataFrame:
    """Month, amount and number of the last months, months without receipts as 0. Provisional dates count here."""
    start, end = add_months(as_of, 1 - months), add_months(as_of, 1)
    rows = of_company(receipts, company).where(in_window(F.col("expense_date"), start, end))
    sums = rows.groupBy(month_start(F.col("expense_date")).alias("month")).agg(F.sum("total_amount").alias("a"), F.count(F.lit(1)).alias("n"))
    return months_until(receipts.sparkSession, as_of, months).join(sums, "month", "left").select("month", F.coalesce("a", F.lit(0)).cast(TOTAL).alias("amount"), F.coalesce("n", F.lit(0)).alias("receipts")).orderBy("month")


def top_providers(receipts: DataFrame, start: date, end: date, k: int = 8, company: str | None = None) -> DataFrame:
    """The k providers with the largest amounts, ties by name. Provisional dates count here."""
    rows = of_company(receipts, company).where(in_window(F.col("expense_date"), start, end))
    return rows.groupBy("provider_name").agg(total(F.col("total_amount")).alias("amount"), F.count(F.lit(1)).alias("receipts")).orderBy(F.desc("amount"), "provider_name").limit(k)


def counts_by(rows: DataFrame, column: str, values: tuple[str, ...] | None = None, company: str | None = None) -> DataFrame:
    """Rows by value of a column; with values, those values only, zero-filled."""
    counted = of_company(rows, company).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if values is None:
        return counted
    wanted = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias("value"))
    return wanted.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def match_status_counts(receipts: DataFrame, reconciliations: DataFrame, company: str | None = None) -> DataFrame:
    """Reconciliations by status, of receipts of the tenant."""
    rows = of_company(receipts, company).select(F.col("id").alias("receipt_id"))
    return reconciliations.join(rows, "receipt_id").groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))


def bank_coverage(bank: DataFrame, start: date, end: date, company: str | None = None) -> DataFrame:
    """How much of the bank's movements is reconciled; amounts keep their signs, the share is 0 without movements."""
    rows = of_company(bank, company).where(in_window(F.col("transaction_date"), start, end))
    sums = rows.agg(F.count(F.lit(1)).alias("movements"), F.count_if("is_reconciled").alias("reconciled"), total(F.col("amount")).alias("amount"), total(F.col("amount"), F.col("is_reconciled")).alias("reconciled_amount"))
    share = F.when(F.col("movements") > 0, F.round(F.col("reconciled") * 100.0 / F.col("movements"), 6)).otherwise(0.0).cast("double")
    return sums.withColumns({"open": F.col("movements") - F.col("reconciled"), "reconciled_pct": share})


def months_by_category(receipts: DataFrame, as_of: date, months: int = 6, company: str | None = None) -> DataFrame:
    """A10: amount by month and category of the last months in one aggregation; categories seen in any month are zero-filled."""
    start, end = add_months(as_of, 1 - months), add_months(as_of, 1)
    rows = of_company(receipts, company).where(in_window(F.col("expense_date"), start, end) & ~F.col("date_provisional"))
    sums = rows.groupBy(month_start(F.col("expense_date")).alias("month"), category_key(F.col("category")).alias("category")).agg(F.sum("total_amount").alias("a"))
    every = F.explode(F.sequence(F.lit(start), F.lit(add_months(as_of, 0)), F.expr("interval 1 month")))
    grid = sums.select("category").distinct().select("category", every.alias("month"))
    return grid.join(sums, ["month", "category"], "left").select("month", "category", F.coalesce("a", F.lit(0)).cast(TOTAL).alias("amount"))


def month_changes(receipts: DataFrame, as_of: date, months: int = 12, company: str | None = None) -> DataFrame:
    """Each month of the trend against the one before it."""
    w = Window.orderBy("month")  # at most 36 rows
    before = F.lag("amount").over(w)
    return monthly_trend(receipts, as_of, months, company).select("month", "amount", (F.col("amount") - before).cast(TOTAL).alias("delta"), F.round(pct_change(F.col("amount"), before), 6).alias("change_pct"))


def uncategorised(receipts: DataFrame, company: str | None = None) -> DataFrame:
    """Amount and number of receipts without a category, over the whole history, provisional dates too."""
    return of_company(receipts, company).where(no_category(F.col("category"))).agg(total(F.col("total_amount")).alias("amount"), F.count(F.lit(1)).alias("receipts"))


def history_totals(receipts: DataFrame, as_of: date, months: int = 12, company: str | None = None) -> DataFrame:
    """The sums of the trend's window."""
    return monthly_trend(receipts, as_of, months, company).agg(total(F.col("amount")).alias("amount"), F.sum("receipts").alias("receipts"))
