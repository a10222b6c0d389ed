"""The folder scanner's ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOISE = r"(^|/)(\.|~\$|Thumbs\.db$|desktop\.ini$)|\.(tmp|part|crdownload)$"


def listing(spark: SparkSession, folder: str, max_bytes: int = 25 << 20, recursive: bool = True) -> DataFrame:
    """Path, file_size and content_hash of the files of a folder; noise and larger files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.where(~F.col("path").rlike(NOISE) & (F.col("length") <= max_bytes)).select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("content_hash"))


def scan_actions(found: DataFrame, ledger: DataFrame, force: bool = False, company: str | None = None) -> DataFrame:
    """What to do with each listed file, and which ledger rows have gone.

    NEW, DUPLICATE (a processed file of the same content has a receipt), UNCHANGED, CHANGED (processed, but its
    content is another: left alone unless force), REPROCESS (open or forced), MISSING (in the ledger only).
    """
    old = ledger.select("path", F.col("content_hash").alias("old_hash"), "status", "receipt_id")
    both = found.select("path", "content_hash").join(old, "path", "full")
    same = duplicates_of(found, ledger).select("path", "sibling")
    s = F.col("status")
    action = (
        F.when(F.col("content_hash").isNull(), "MISSING").when(F.col("old_hash").isNull(), F.when(F.col("sibling").isNotNull(), "DUPLICATE").otherwise("NEW"))
        .when(s.isin("PENDIENTE", "ERROR") | F.lit(force), "REPROCESS").when(F.col("content_hash") == F.col("old_hash"), "UNCHANGED").otherwise("CHANGED")
    )
    return both.join(same, "path", "left").select("path", action.alias("action"), "sibling")


def duplicates_of(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each listed file with the first other path (by name) that holds the same content, was processed and has a receipt."""
    done = ledger.where("status = 'PROCESADO' and receipt_id is not null")
    # the two smallest paths of a content are enough to find one that is not the file itself
    low = done.groupBy("content_hash").agg(F.min("path").alias("p1"))
    second = done.join(low, "content_hash").where("path <> p1").groupBy("content_hash").agg(F.min("path").alias("p2"))
    rows = found.select("path", "content_hash").join(low, "content_hash").join(second, "content_hash", "left")
    return rows.select("path", F.when(F.col("path") == F.col("p1"), F.col("p2")).otherwise(F.col("p1")).alias("sibling")).where("sibling is not null")


def run_summary(details: DataFrame, receipts: DataFrame) -> DataFrame:
    """One row about a run's details (seq, path, status, action, receipt_id). A receipt that several
    details name counts once, with the first; sums are null, not 0, where no receipt has a total."""
    first = details.where("receipt_id is not null").groupBy("receipt_id").agg(F.min("seq").alias("seq"))
    r = first.join(receipts.withColumnRenamed("id", "receipt_id"), "receipt_id")
    s, amount = F.col("extraction_status"), F.col("total_amount")
    has = F.coalesce(amount > 0, F.lit(False))
    money = lambda c: F.when(F.count_if(has) > 0, F.coalesce(F.sum(F.when(c & has, amount)), F.lit(0))).cast("decimal(18,2)")
    read = r.agg(
        money(F.lit(True)).alias("read_amount"), money(s == "AUTO_APROBADO").alias("trusted_amount"), money(s.isin("PENDIENTE", "REQUIERE_REVISION")).alias("review_amount"),
        F.count_if(has).alias("with_total"), F.count_if(~has).alias("without_total"), F.count_if(F.coalesce("provider_tax_id", F.lit("")) != "").alias("with_tax_id"), F.count_if(s.isin("PENDIENTE", "REQUIERE_REVISION")).alias("to_review"),
    )
    a, t = F.col("action"), F.col("status")
    seen = details.agg(
        F.count(F.lit(1)).alias("seen"), *[F.count_if(a == x).alias(n) for x, n in (("CREADO", "created"), ("ACTUALIZADO", "updated"), ("SIN_CAMBIOS", "unchanged"), ("ERROR", "failed"))],
        F.count_if(t == "DUPLICADO").alias("duplicates"), F.count_if(t == "NO_SOPORTADO").alias("unsupported"), F.count_if(F.col("receipt_id").isNull()).alias("without_receipt"),
    )
    out = seen.join(read)  # one row each
    return out.withColumn("needs_action", F.col("to_review") + F.col("failed") + F.col("unsupported") + F.col("without_receipt"))


def readings_per_engine(details: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts of a run by the engine that read them."""
    ids = details.where("receipt_id is not null").select(F.col("receipt_id").alias("id")).distinct()
    return receipts.join(ids, "id", "left_semi").where("confidence_source is not null").groupBy("confidence_source").agg(F.count(F.lit(1)).alias("n"))


def retirable(found: DataFrame, documents: DataFrame, receipts: DataFrame) -> DataFrame:
    """Files whose content is stored as the current document of a settled receipt: listed path and receipt."""
    newest = documents.groupBy("receipt_id").agg(F.max_by("sha256", "version").alias("content_hash"))
    settled = receipts.where("extraction_status in ('AUTO_APROBADO', 'APROBADO')").select(F.col("id").alias("receipt_id"))
    kept = newest.join(settled, "receipt_id", "left_semi").groupBy("content_hash").agg(F.min("receipt_id").alias("receipt_id"))
    return found.select("path", "content_hash").join(kept, "content_hash").select("path", "receipt_id")


def event_log(details: DataFrame, actor: str, on) -> DataFrame:
    """Rows to append to the event log."""
    return details.select("path", "action", F.lit(actor).alias("actor"), F.lit(on).alias("logged_on"))


def event_history(events: DataFrame) -> DataFrame:
    """Every event (path, happened_on, action, seq), numbered within its file from 1 by time and action, ties by seq."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("happened_on", "action", "seq")))


def reset_counts(tables: dict[str, DataFrame], human: dict[str, str]) -> DataFrame:
    """What a reset would delete: rows of each table, and how many of them hold human work (a condition by table)."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(human.get(name, "false"))).alias("human_rows")).select(F.lit(name).alias("entity"), "rows", "human_rows")
        out = one if out is None else out.unionByName(one)
    return out
