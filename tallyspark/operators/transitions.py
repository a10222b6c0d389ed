"""State changes as functions of a table and a table of actions: (new table, refused actions).

Of several actions on one row the first by `seq` counts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gate import checks, gate


def _first(actions: DataFrame) -> DataFrame:
    rest = [c for c in actions.columns if c != "id"]
    return actions.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("__do"))


def review(receipts: DataFrame, actions: DataFrame, as_of: date) -> tuple[DataFrame, DataFrame]:
    """Actions (seq, id, action, actor, total_amount, provider_name, expense_date): approve, reject or request_info.

    Corrections that are not null replace what was read; a corrected date is no longer provisional. An
    approval must pass the checks. The reviewer is stamped where something changed. Only open receipts are reviewed.
    """
    rows = receipts.join(_first(actions), "id", "left")
    fixed = {c: F.coalesce(F.col(f"__do.{c}"), F.col(c)) for c in ("total_amount", "provider_name", "expense_date")}
    moved = sum(((F.col(f"__do.{c}").isNotNull()) & ~F.col(f"__do.{c}").eqNullSafe(F.col(c))).cast("int") for c in fixed) > 0
    rows = rows.withColumn("__moved", moved).withColumns({"date_provisional": F.col("date_provisional") & F.col("__do.expense_date").isNull(), **fixed})
    rows = rows.withColumn("__failures", checks(as_of)[1])
    act, is_open = F.col("__do.action"), F.col("extraction_status").isin("REQUIERE_REVISION", "PENDIENTE")
    refused = F.when(act.isNull(), None).when(~is_open, "not open").when((act == "approve") & (F.size("__failures") > 0), "checks failed").when(~act.isin("approve", "reject", "request_info"), "unknown action")
    rows = rows.withColumn("__refused", refused)
    ok = act.isNotNull() & F.col("__refused").isNull()
    status = F.when(ok & (act == "approve"), "APROBADO").when(ok & (act == "reject"), "RECHAZADO").when(ok, "REQUIERE_REVISION").otherwise(F.col("extraction_status"))
    stamped = ok & ((status != F.col("extraction_status")) | F.col("__moved"))
    original = receipts.select("id", F.struct(*fixed, "date_provisional").alias("__was"))
    rows = rows.join(original, "id")
    back = {c: F.when(ok | act.isNull(), F.col(c)).otherwise(F.col(f"__was.{c}")) for c in (*fixed, "date_provisional")}
    out = rows.withColumns({"__by": F.when(stamped, F.col("__do.actor")), "__status": status, **back}).withColumns({"extraction_status": F.col("__status"), "reviewed_by": F.col("__by")})
    return out.select(*receipts.columns, "reviewed_by") if "reviewed_by" not in receipts.columns else out.select(*receipts.columns), rows.where("__refused is not null").select("id", F.col("__refused").alias("reason"))


def edit(receipts: DataFrame, changes: DataFrame, as_of: date) -> DataFrame:
    """Changed fields (seq, id, total_amount, provider_name, expense_date; null: as it is); open receipts pass the gate again as manual entries."""
    rows = receipts.join(_first(changes), "id", "left")
    fixed = {c: F.coalesce(F.col(f"__do.{c}"), F.col(c)) for c in ("total_amount", "provider_name", "expense_date")}
    rows = rows.withColumns(fixed).withColumns({"__was": F.col("extraction_status"), "__confidence": F.col("confidence"), "__changed": F.col("__do.seq").isNotNull()}).drop("__do")
    gated = gate(rows, as_of, manual=True)
    again = F.col("__changed") & F.col("__was").isin("REQUIERE_REVISION", "PENDIENTE")
    return gated.withColumns({"extraction_status": F.when(again, F.col("extraction_status")).otherwise(F.col("__was")), "confidence": F.when(~again, F.col("__confidence"))}).select(*receipts.columns)


def spot_check(receipts: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (seq, id, verdict, fields, actor): only on automatic approvals of the sample; INCORRECTO must name fields."""
    rows = receipts.join(_first(verdicts), "id", "left")
    v = F.col("__do.verdict")
    refused = (
        F.when(v.isNull(), None).when((F.col("extraction_status") != "AUTO_APROBADO") | F.col("spot_check_status").isNull(), "not in the sample")
        .when(~v.isin("CORRECTO", "INCORRECTO"), "unknown verdict").when((v == "INCORRECTO") & (F.trim(F.coalesce("__do.fields", F.lit(""))) == ""), "no fields")
    )
    rows = rows.withColumn("__refused", refused)
    ok = v.isNotNull() & F.col("__refused").isNull()
    out = rows.withColumns({"spot_check_status": F.when(ok, v).otherwise(F.col("spot_check_status")), "spot_check_wrong_fields": F.when(ok & (v == "INCORRECTO"), F.col("__do.fields")).when(~ok, F.col("spot_check_wrong_fields")), "spot_checked_by": F.when(ok, F.col("__do.actor")).otherwise(F.col("spot_checked_by"))})
    return out.select(*receipts.columns), rows.where("__refused is not null").select("id", F.col("__refused").alias("reason"))


def categorise(receipts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set categories (seq, id, category; blank: none): the table, and one row with how many ids were asked for and found."""
    first = _first(changes)
    rows = receipts.join(first, "id", "left")
    new = F.when(F.trim(F.coalesce("__do.category", F.lit(""))) != "", F.col("__do.category"))
    counts = first.select("id").join(receipts.select("id", F.lit(1).alias("hit")), "id", "left").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("found"))
    return rows.withColumn("category", F.when(F.col("__do.seq").isNotNull(), new).otherwise(F.col("category"))).select(*receipts.columns), counts


def authorize(receipts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approve or reject expenses (seq, id, action, actor, reason); a rejection needs a reason, and settled ones stay."""
    rows = receipts.join(_first(actions), "id", "left")
    a = F.col("__do.action")
    refused = F.when(a.isNull(), None).when(F.col("authorization_status") != "PENDIENTE", "settled").when((a == "reject") & (F.trim(F.coalesce("__do.reason", F.lit(""))) == ""), "no reason").when(~a.isin("approve", "reject"), "unknown action")
    rows = rows.withColumn("__refused", refused)
    ok = a.isNotNull() & F.col("__refused").isNull()
    out = rows.withColumn("authorization_status", F.when(ok & (a == "approve"), "APROBADA").when(ok, "RECHAZADA").otherwise(F.col("authorization_status")))
    return out.select(*receipts.columns), rows.where("__refused is not null").select("id", F.col("__refused").alias("reason"))


def seeded(accounts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The catalogue's accounts (company_id, key, ...) that the company doesn't have yet, compared by whole key."""
    return catalogue.join(accounts.select("company_id", "key"), ["company_id", "key"], "left_anti")


def assign_accounts(receipts: DataFrame, assignments: DataFrame, accounts: DataFrame) -> DataFrame:
    """Set accounts (seq, id, account_id); the account's key becomes the category with it. Unknown accounts change nothing."""
    rows = receipts.join(_first(assignments).select("id", F.col("__do.account_id").alias("__a")), "id", "left").join(accounts.select(F.col("id").alias("__a"), F.col("key").alias("__key")), "__a", "left")
    known = F.col("__key").isNotNull()
    return rows.withColumns({"account_id": F.when(known, F.col("__a")).otherwise(F.col("account_id")), "category": F.when(known, F.col("__key")).otherwise(F.col("category"))}).select(*receipts.columns)


def product_guards(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Product changes (id, company_id, code, origin, verified) with a reason to refuse them: a code that another
    product of the company has, or an OCR product without a code that is to be verified."""
    owner = products.where("code is not null").groupBy("company_id", "code").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    rows = changes.join(owner, ["company_id", "code"], "left")
    taken = F.col("low").isNotNull() & ((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")))
    return rows.select("id", F.when(taken, "code taken").when((F.col("origin") == "OCR") & F.col("code").isNull() & F.col("verified"), "unverifiable").alias("reason"))
