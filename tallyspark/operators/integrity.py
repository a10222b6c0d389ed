"""Constraints as queries that return the rows which break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PERIOD, SHA256


def violations(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """key and rule of each row and rule (SQL conditions that must not be false) it breaks; all rules in one scan."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(condition), name) for name, condition in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (none null) that several rows share, and how many do."""
    whole = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


RECEIPT_RULES = {
    "settled_total": "extraction_status not in ('AUTO_APROBADO', 'APROBADO') or total_amount > 0",
    "settled_tax": "extraction_status not in ('AUTO_APROBADO', 'APROBADO') or (tax_amount >= 0 and tax_amount <= total_amount)",
}
SPOT_CHECK_RULES = {
    "value": "spot_check_status is null or spot_check_status in ('PENDIENTE', 'CORRECTO', 'INCORRECTO')",
    "signed": "spot_check_status is null or spot_check_status = 'PENDIENTE' or spot_checked_by is not null",
    "automatic_only": "spot_check_status is null or extraction_status = 'AUTO_APROBADO'",
}
RECONCILIATION_RULES = {"reviewer_and_date": "(reviewed_by is null) = (reviewed_on is null)"}
SCAN_RULES = {"status": "status in ('PENDIENTE', 'PROCESADO', 'DUPLICADO', 'ERROR', 'NO_SOPORTADO')", "attempts": "attempts >= 0"}
DOCUMENT_RULES = {"version": "version >= 1", "replacement_signed": "replaces is null or actor is not null"}
CLOSE_RULES = {"period": f"period rlike r'{PERIOD}'", "digest": f"digest is null or digest rlike r'{SHA256}'"}
PRODUCT_RULES = {"named": "trim(name) <> ''", "price": "reference_price is null or reference_price >= 0", "verified": "verified or origin = 'OCR'"}
PURCHASE_RULES = {"confirmed_iff_processed": "(state = 'PROCESADO') = (confirmed_by is not null and confirmed_on is not null)"}
LINE_RULES = {"quantity": "quantity > 0", "total": "total is null or total >= 0"}
LEDGER_RULES = {"kind": "kind in ('ENTRADA', 'SALIDA', 'AJUSTE')", "quantity": "quantity > 0", "actor": "actor is not null"}
ACCOUNT_RULES = {"key_upper": "key = upper(key)", "key_present": "trim(key) <> ''"}
AUTHORIZATION_RULES = {"state": "authorization_status in ('PENDIENTE', 'APROBADA', 'RECHAZADA')", "rejection_reason": "authorization_status <> 'RECHAZADA' or trim(coalesce(rejection_reason, '')) <> ''"}


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of an append-only table that were changed or deleted between two snapshots."""
    columns = [c for c in before.columns if c != key]
    old = before.select(key, F.struct(*columns).alias("old"))
    new = after.select(key, F.struct(*columns).alias("new"), F.lit(True).alias("there"))
    joined = old.join(new, key, "left")
    return joined.where(F.col("there").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(F.col(key).cast("string").alias("key"), F.when(F.col("there").isNull(), "deleted").otherwise("changed").alias("what"))


def backfilled_status(receipts: DataFrame) -> DataFrame:
    """The status and reasons that old rows get when the gate is introduced."""
    no_total, no_provider, no_category = F.coalesce("total_amount", F.lit(0)) <= 0, F.coalesce("provider_name", F.lit("")).isin("", "Unknown Provider"), F.trim(F.coalesce("category", F.lit(""))) == ""
    reasons = F.concat_ws("; ", F.when(no_total, "total_not_positive"), F.when(no_provider, "provider_missing"), F.when(no_category, "category_missing"))
    return receipts.select("id", F.when(no_total | no_provider, "PENDIENTE").when(no_category, "REQUIERE_REVISION").otherwise("APROBADO").alias("status"), F.when(reasons != "", reasons).alias("reasons"))
