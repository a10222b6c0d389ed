"""The month's close report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_category
from .dashboard import TOTAL, in_window, of_company, total

STATUSES = ("PERFECT", "MANUAL", "DISCREPANCY")


def _month(receipts: DataFrame, start: date, end: date, company: str | None) -> DataFrame:
    return of_company(receipts, company).where(in_window(F.col("expense_date"), start, end))


def reconciliation_section(receipts: DataFrame, reconciliations: DataFrame, bank: DataFrame, start: date, end: date, company: str | None = None) -> DataFrame:
    """One row: receipts, matches by status, unreconciled, the discrepancies' amount, and what was paid in
    another month of the same year (receipts with provisional dates don't count there)."""
    rows = _month(receipts, start, end, company)
    links = rows.select(F.col("id").alias("receipt_id"), "total_amount", "expense_date", "date_provisional").join(reconciliations.select("receipt_id", "bank_id", "match_status"), "receipt_id").join(bank.select(F.col("id").alias("bank_id"), "transaction_date"), "bank_id", "left")
    s, d, b = F.col("match_status"), F.col("expense_date"), F.col("transaction_date")
    other = (F.year(d) == F.year(b)) & (F.month(d) != F.month(b)) & ~F.col("date_provisional")
    counts = links.agg(
        *[F.count_if(s == x).alias(x.lower()) for x in STATUSES], total(F.col("total_amount"), s == "DISCREPANCY").alias("discrepancy_amount"),
        F.count_if(other).alias("paid_in_other_period"), total(F.col("total_amount"), other).alias("paid_in_other_period_amount"),
    )
    out = rows.agg(F.count(F.lit(1)).alias("receipts")).join(counts)  # one row each
    return out.withColumn("unreconciled", F.greatest(F.col("receipts") - F.col("perfect") - F.col("manual"), F.lit(0)))


def reading_section(receipts: DataFrame, start: date, end: date, company: str | None = None) -> DataFrame:
    """Read by the system, verified by a person, still open."""
    s = F.col("extraction_status")
    return _month(receipts, start, end, company).agg(F.count_if(s == "AUTO_APROBADO").alias("by_system"), F.count_if(s == "APROBADO").alias("verified"), F.count_if(s.isin("REQUIERE_REVISION", "PENDIENTE")).alias("open"))


def verification_section(receipts: DataFrame, start: date, end: date, company: str | None = None) -> DataFrame:
    """The sample, what of it was reviewed, by whom (distinct, sorted) and when last."""
    s = F.col("spot_check_status")
    rows = _month(receipts, start, end, company).where(s.isNotNull())
    reviewers = F.array_join(F.sort_array(F.collect_set("spot_checked_by")), ", ")
    return rows.agg(F.count(F.lit(1)).alias("sample"), F.count_if(s != "PENDIENTE").alias("reviewed"), F.count_if(s == "PENDIENTE").alias("pending"), reviewers.alias("reviewers"), F.max(F.when(s != "PENDIENTE", F.col("created_on"))).alias("last_review"))


def pending_section(receipts: DataFrame, reconciliations: DataFrame, start: date, end: date, company: str | None = None) -> DataFrame:
    """Counts and amounts of what is not finished, whether there is any, and the reasons in words."""
    linked = reconciliations.groupBy("receipt_id").agg(F.bool_or(F.col("match_status").isin("PERFECT", "MANUAL")).alias("matched"), F.bool_or(F.col("match_status") == "DISCREPANCY").alias("off"))
    rows = _month(receipts, start, end, company).join(linked.withColumnRenamed("receipt_id", "id"), "id", "left")
    amount = F.col("total_amount")
    parts = {"uncategorised": no_category(F.col("category")), "undated": F.col("date_provisional"), "unreconciled": ~F.coalesce("matched", F.lit(False)), "discrepancies": F.coalesce("off", F.lit(False))}
    sums = rows.agg(*[x for n, c in parts.items() for x in (F.count_if(c).alias(n), total(amount, c).alias(f"{n}_amount"))])
    words = {"uncategorised": "sin categoria", "undated": "sin fecha", "unreconciled": "sin conciliar", "discrepancies": "con discrepancia"}
    text = F.concat_ws(", ", *[F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {w}"))) for n, w in words.items()])
    # the amount of unreconciled receipts is reported as 0, as it always has been
    return sums.withColumns({"unreconciled_amount": F.lit(0).cast(TOTAL), "has_pending": sum((F.col(n) for n in parts), F.lit(0)) > 0, "reasons": text})


def period_state(closed: Column, pending_at_close: Column, over: Column, has_pending: Column) -> Column:
    """A28."""
    return F.when(closed, F.when(pending_at_close > 0, "CERRADO_CON_PENDIENTES").otherwise("CERRADO")).when(~over | has_pending, "NO_CIERRA").otherwise("CIERRE_DISPONIBLE")


def states(receipts: DataFrame, reconciliations: DataFrame, closes: DataFrame, start: date, end: date, as_of: date) -> DataFrame:
    """Each company's state for the month, from its close row if it has one, else from what is open."""
    matched = reconciliations.where("match_status in ('PERFECT', 'MANUAL')").select(F.col("receipt_id").alias("id")).distinct().withColumn("matched", F.lit(True))
    rows = receipts.where(in_window(F.col("expense_date"), start, end)).join(matched, "id", "left")
    unfinished = no_category(F.col("category")) | F.col("date_provisional") | F.col("matched").isNull()
    open_rows = rows.groupBy("company_id").agg(F.count_if(unfinished).alias("open"))
    mine = closes.where(F.col("period") == f"{start:%Y-%m}").select("company_id", F.col("pending").alias("pending_at_close"))
    both = open_rows.join(mine, "company_id", "full")
    return both.select("company_id", F.coalesce("open", F.lit(0)).alias("open"), period_state(F.col("pending_at_close").isNotNull(), F.col("pending_at_close"), F.lit(as_of >= end), F.coalesce("open", F.lit(0)) > 0).alias("state"))


def report(receipts: DataFrame, reconciliations: DataFrame, bank: DataFrame, companies: DataFrame, company: str, start: date, end: date) -> DataFrame:
    """The report's sections as structs of one row; no row for a company that doesn't exist."""
    sections = {
        "reconciliation": reconciliation_section(receipts, reconciliations, bank, start, end, company), "reading": reading_section(receipts, start, end, company),
        "verification": verification_section(receipts, start, end, company), "pending": pending_section(receipts, reconciliations, start, end, company),
    }
    out = companies.where(F.col("company_id") == company).select("company_id").distinct()
    for name, section in sections.items():
        out = out.join(section.select(F.struct("*").alias(name)))  # one row each
    return out
