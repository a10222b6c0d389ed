"""The folder scanner as a stream (K01, K02): each micro-batch of new files is compared with the ledger and appended to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import NOISE, scan_actions

FILE = "path string, modificationTime timestamp, length long, content binary"


def scan_stream(spark: SparkSession, folder: str, ledger: str, checkpoint: str, max_files: int = 200, max_bytes: int = 25 << 20):
    """Start the scanner; ledger is a Parquet table (path, content_hash, status, receipt_id). Ends when the folder is read.

    At most max_files go into one batch. New files are added as processed, copies of processed ones as
    duplicates; a batch that is run again finds its files in the ledger and adds nothing.
    """

    def batch(found: DataFrame, _: int) -> None:
        known = spark.read.schema("path string, content_hash string, status string, receipt_id string").parquet(ledger)
        actions = scan_actions(found, known).where("action in ('NEW', 'DUPLICATE')")
        status = F.when(F.col("action") == "NEW", "PROCESADO").otherwise("DUPLICADO")
        found.join(actions, "path").select("path", "content_hash", status.alias("status"), F.lit(None).cast("string").alias("receipt_id")).write.mode("append").parquet(ledger)

    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(folder)
    found = files.where(~F.col("path").rlike(NOISE) & (F.col("length") <= max_bytes)).select("path", F.sha2("content", 256).alias("content_hash"))
    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
