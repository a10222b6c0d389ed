"""A run over the scanned folder: what becomes of each file, what may leave the folder, and the run's totals.

Readings come from elsewhere; a run is a function of the listing, the ledger, the receipts and their stored documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import duplicates_of

OPEN, SETTLED = ("PENDIENTE", "ERROR"), ("AUTO_APROBADO", "APROBADO")
#: Files that one run looks at, by path; the others wait for the next one.
CAP = 200


def first_files(found: DataFrame, cap: int | None) -> DataFrame:
    """The files of a run: the first by path."""
    return found if cap is None else found.orderBy("path").limit(cap)


def run_details(
    found: DataFrame, ledger: DataFrame, receipts: DataFrame, documents: DataFrame, company: str | None, cap: int | None = CAP, reread: bool = False, pending_only: bool = False, archive: bool = True
) -> DataFrame:
    """path, content_hash, action, status, receipt_id and retire of each file of the run.

    found: path, content_hash, file_type (unknown ones aren't supported), failed (no reader could read it).
    ledger: path, content_hash, status, receipt_id. receipts: id, extraction_status, reviewed.
    documents: receipt_id, version, sha256. Without a company the folder is only taken stock of: no receipts, nothing leaves.

    A processed file is read again only if reread, or if it still lacks a receipt and there is a company now;
    pending_only passes processed files over altogether. A receipt that a person has reviewed isn't overwritten.
    retire: RETIRADO (the newest stored document of its settled receipt is this very content), SIN_RESPALDO
    (settled, but not stored like that), BANDEJA (not settled), null (nothing to archive).
    """
    rows = first_files(found, cap)
    if pending_only:
        rows = rows.join(ledger.where("status = 'PROCESADO'").select("path"), "path", "left_anti")
    siblings = duplicates_of(rows, ledger).select("path", "sibling")
    old = ledger.select("path", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"), F.col("receipt_id").alias("old_receipt"))
    owner = receipts.select(F.col("id").alias("old_receipt"), "extraction_status", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.lit(True).alias("there"))
    newest = documents.groupBy(F.col("receipt_id").alias("old_receipt")).agg(F.max_by("sha256", "version").alias("kept_hash"))
    rows = rows.join(old, "path", "left").join(siblings, "path", "left").join(owner, "old_receipt", "left").join(newest, "old_receipt", "left")

    new, unowned = F.col("old_status").isNull(), F.col("old_receipt").isNull()
    attribute = unowned if company is not None else F.lit(False)
    left_alone = ~new & ~F.col("old_status").isin(*OPEN) & F.lit(not reread) & ~attribute
    outcomes: list[tuple[Column, str, Column | str]] = [
        (left_alone & (F.col("content_hash") == F.col("old_hash")), "SIN_CAMBIOS", F.col("old_status")), (left_alone, "OMITIDO", F.col("old_status")),
        (F.col("file_type") == "unknown", "OMITIDO", "NO_SOPORTADO"), (F.coalesce("failed", F.lit(False)), "ERROR", "ERROR"), (F.lit(company is None), "OMITIDO", "PROCESADO"),
        (new & F.col("sibling").isNotNull(), "OMITIDO", "DUPLICADO"), (new | unowned | F.col("there").isNull(), "CREADO", "PROCESADO"), (F.col("reviewed"), "OMITIDO", "PROCESADO"), (F.lit(True), "ACTUALIZADO", "PROCESADO"),
    ]
    first_true = F.lit(len(outcomes))
    for i in reversed(range(len(outcomes))):
        first_true = F.when(outcomes[i][0], i).otherwise(first_true)
    pick = lambda values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.col("__case") + 1)
    rows = rows.withColumn("__case", first_true).withColumns({"action": pick([o[1] for o in outcomes]), "status": pick([o[2] for o in outcomes])})

    made = F.substring(F.sha2(F.concat_ws("|", F.lit(company or ""), "path", "content_hash"), 256), 1, 32)
    rows = rows.withColumn("receipt_id", F.when(F.col("action") == "CREADO", made).when(F.col("status").isin("ERROR", "DUPLICADO", "NO_SOPORTADO"), F.lit(None)).otherwise(F.col("old_receipt")))
    subject = F.lit(archive and company is not None) & F.col("receipt_id").isNotNull()
    settled = F.col("extraction_status").isin(*SETTLED) & (F.col("action") != "CREADO")
    retire = F.when(subject, F.when(~F.coalesce(settled, F.lit(False)), "BANDEJA").when(F.col("kept_hash") == F.col("content_hash"), "RETIRADO").otherwise("SIN_RESPALDO"))
    return rows.select("path", "content_hash", "action", "status", "receipt_id", retire.alias("retire"))


def run_totals(found: DataFrame, details: DataFrame, cap: int | None = CAP) -> DataFrame:
    """One row: files seen and left to the next run, details by outcome, and how many leave the folder or stay for review."""
    seen = found.agg(F.count(F.lit(1)).alias("seen"))
    waiting = F.greatest(F.col("seen") - cap, F.lit(0)) if cap is not None else F.lit(0)
    action, status, retire = F.col("action"), F.col("status"), F.col("retire")
    conditions = {
        "created": action == "CREADO", "updated": action == "ACTUALIZADO", "unchanged": action == "SIN_CAMBIOS", "duplicates": (action == "OMITIDO") & (status == "DUPLICADO"),
        "unsupported": (action == "OMITIDO") & (status == "NO_SOPORTADO"), "failed": action == "ERROR", "in_tray": retire == "BANDEJA", "retired": retire == "RETIRADO",
    }
    counts = details.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    return seen.withColumn("waiting", waiting.cast("long")).join(counts)  # one row each
