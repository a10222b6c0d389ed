"""Lists, queues and logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import no_category
from .dashboard import of_company

OPEN = ("REQUIERE_REVISION", "PENDIENTE")
SETTLED = ("AUTO_APROBADO", "APROBADO")
TWO = "decimal(18,2)"


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows; end order with an id so that pages are stable."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def receipt_list(receipts: DataFrame, company: str | None = None, only_open: bool = False, status: str | None = None, category: str | None = None, with_category: bool = False, without_category: bool = False) -> DataFrame:
    """Receipts of a tenant; only_open wins over status, a category over the two flags, and both flags together filter nothing."""
    rows = of_company(receipts, company)
    if only_open:
        rows = rows.where(F.col("extraction_status").isin(*OPEN))
    elif status is not None:
        rows = rows.where(F.col("extraction_status") == status)
    if category is not None:
        return rows.where(F.col("category") == category)
    if with_category != without_category:
        missing = no_category(F.col("category"))
        rows = rows.where(missing if without_category else ~missing)
    return rows


def review_queue(receipts: DataFrame, as_of: date, limit: int = 50, company: str | None = None) -> DataFrame:
    """Numbers of the open queue, and the mean age in whole days of its oldest receipts (a page), to one decimal."""
    rows = of_company(receipts, company).where(F.col("extraction_status").isin(*OPEN))
    counts = rows.agg(F.count_if(F.col("extraction_status") == OPEN[0]).alias("needs_review"), F.count_if(F.col("extraction_status") == OPEN[1]).alias("pending"), F.count(F.lit(1)).alias("total_open"))
    first = page(rows, [F.col("created_on"), F.col("id")], limit)
    ages = first.agg(F.round(F.avg(F.datediff(F.lit(as_of), "created_on")), 1).alias("mean_age_days"))
    return counts.join(ages)  # one row each


def spot_check_queue(receipts: DataFrame, as_of: date, company: str | None = None) -> DataFrame:
    """The sample's counts, and the age of its oldest open check."""
    s = F.col("spot_check_status")
    rows = of_company(receipts, company).where(s.isNotNull())
    return rows.agg(
        F.count_if(s == "PENDIENTE").alias("pending"), F.count_if(s != "PENDIENTE").alias("reviewed"), F.count_if(s == "CORRECTO").alias("correct"), F.count_if(s == "INCORRECTO").alias("incorrect"),
        F.datediff(F.lit(as_of), F.min(F.when(s == "PENDIENTE", F.col("created_on")))).alias("oldest_age_days"),
    )


def audit_log(audit: DataFrame, users: DataFrame | None = None, action: str | None = None, module: str | None = None, since: date | None = None, until: date | None = None) -> DataFrame:
    """Log entries of closed date ranges, with the users' e-mail where users (id, email) has it."""
    rows = audit
    for column, value in (("action", action), ("module", module)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("logged_on") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("logged_on") <= F.lit(until))
    return rows if users is None else rows.join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left")


def page_with_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of all rows; it is counted apart, so no window gathers the rows."""
    return page(rows, order, limit, offset).join(rows.agg(F.count(F.lit(1)).alias("total_rows")))


def scan_stats(files: DataFrame) -> DataFrame:
    """The ledger's counters in one scan."""
    s = F.col("status")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("attempts").alias("attempts"), F.count_if(s == "ERROR").alias("errors"), F.count_if(s == "PROCESADO").alias("processed"),
        F.count_if(s == "DUPLICADO").alias("duplicates"), F.count_if(s.isin("PENDIENTE", "ERROR")).alias("open"), F.count_if(F.col("last_error").contains("sobreescribe")).alias("stale"),
        F.count("receipt_id").alias("linked"), F.count_if(F.col("receipt_id").isNull()).alias("unlinked"), F.max(F.when(s == "PROCESADO", F.col("scanned_on"))).alias("newest"),
    )


def scan_files_with_receipts(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each file, with its receipt's provider, date and total where it has one."""
    r = receipts.select(F.col("id").alias("receipt_id"), "provider_name", "expense_date", "total_amount")
    return files.join(r, "receipt_id", "left").select("path", "status", "receipt_id", "provider_name", "expense_date", "total_amount")


def reconciliation_list(reconciliations: DataFrame, receipts: DataFrame, bank: DataFrame) -> DataFrame:
    """Reconciliations with both sides' amounts and dates, and their gaps; null where a side is missing."""
    r = receipts.select(F.col("id").alias("receipt_id"), "total_amount", "expense_date")
    b = bank.select(F.col("id").alias("bank_id"), "amount", "transaction_date")
    joined = reconciliations.join(r, "receipt_id", "left").join(b, "bank_id", "left")
    return joined.select("id", "match_status", "total_amount", "amount", F.abs(F.abs("total_amount") - F.abs("amount")).cast(TWO).alias("amount_gap"), F.abs(F.datediff("expense_date", "transaction_date")).alias("days_gap"))


def account_usage(accounts: DataFrame, receipts: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """How many receipts (and products) use each account, from one aggregation of each table."""
    used = receipts.where("account_id is not null").groupBy(F.col("account_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = accounts.join(used, "id", "left").select("id", "key", "name", F.coalesce("n", F.lit(0)).alias("receipts"))
    if products is not None:
        by = products.where("account_id is not null").groupBy(F.col("account_id").alias("id")).agg(F.count(F.lit(1)).alias("products"))
        out = out.join(by, "id", "left").withColumn("products", F.coalesce("products", F.lit(0)))
    return out


def authorization_queue(receipts: DataFrame, accounts: DataFrame, limit: int = 100) -> DataFrame:
    """Receipts that wait for authorization, newest first, with their account's key."""
    a = accounts.select(F.col("id").alias("account_id"), F.col("key").alias("account_key"))
    rows = receipts.where("authorization_status = 'PENDIENTE'").orderBy(F.desc("created_on"), "id").limit(limit)
    return rows.join(a, "account_id", "left").select("id", "created_on", "total_amount", "account_key")


def purchases_with_lines(purchases: DataFrame, lines: DataFrame) -> DataFrame:
    """Each purchase with the ordered list of its lines; purchases without lines have an empty list."""
    packed = lines.groupBy(F.col("purchase_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line_order", "product_id", "quantity", "total"))).alias("lines"))
    empty = F.array().cast(packed.schema["lines"].dataType)
    return purchases.join(packed, "id", "left").withColumn("lines", F.coalesce("lines", empty))


def newest_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows by order of each key. A ring buffer's content; Spark limits each task's groups before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def other_active_users(users: DataFrame, user_id: str) -> DataFrame:
    """How many other accounts are active; with 0 the last one must not be closed."""
    return users.where(F.col("active") & (F.col("id") != user_id)).agg(F.count(F.lit(1)).alias("others"))


def current_documents(documents: DataFrame) -> DataFrame:
    """The current version of each receipt's document and the length of its chain, by one aggregation."""
    rest = [c for c in documents.columns if c != "receipt_id"]
    newest = documents.groupBy("receipt_id").agg(F.max_by(F.struct(*rest), F.struct("version", "id")).alias("__d"), F.count(F.lit(1)).alias("versions"))
    return newest.select("receipt_id", "__d.*", "versions")
