"""The scanner's ledger as a folder of runs, and the lease that lets one run at a time write.

A run's rows are a folder named by its lease's number. It counts once Spark has marked it as whole, so a run that
dies before leaves nothing, and the same run again writes the same folder. Of the rows of one path the last run's holds: what
a run writes after its lease has passed to another is older than that one's rows, and isn't read once these are compacted: its files are new to the next run.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "path string, content_hash string, action string, status string, receipt_id string, retire string"


@dataclass(frozen=True)
class Lease:
    folder: str
    number: int


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _found(spark: SparkSession, pattern: str) -> list:
    p, files = _files(spark, pattern)
    return list(files.globStatus(p) or ())


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file, if there is none: of several callers one succeeds."""
    p, files = _files(spark, path)
    files.mkdirs(p.getParent())
    if files.getScheme() == "file":
        try:
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    from py4j.protocol import Py4JJavaError

    try:
        files.create(p, False).close()
    except Py4JJavaError:
        if files.exists(p):
            return False
        raise
    return True


def take(spark: SparkSession, folder: str, seconds: float) -> Lease | None:
    """The next lease, or None while another run holds one that is neither released nor older than `seconds` (by the files' times)."""
    held = {int(x.getPath().getName().split("-")[1]): x.getModificationTime() / 1000 for x in _found(spark, f"{folder}/leases/lease-*")}
    last = max(held, default=0)
    if held and not _found(spark, f"{folder}/leases/released-{last:09}") and time.time() - held[last] < seconds:
        return None
    return Lease(folder, last + 1) if _create(spark, f"{folder}/leases/lease-{last + 1:09}") else None


def renew(spark: SparkSession, lease: Lease) -> bool:
    """Keep a lease longer; False where another run has taken the next one."""
    path, files = _files(spark, f"{lease.folder}/leases/lease-{lease.number:09}")
    files.setTimes(path, int(time.time() * 1000), -1)
    return not _found(spark, f"{lease.folder}/leases/lease-{lease.number + 1:09}")


def release(spark: SparkSession, lease: Lease) -> None:
    _create(spark, f"{lease.folder}/leases/released-{lease.number:09}")


def _whole(spark: SparkSession, folder: str, kind: str) -> dict[int, str]:
    marks = [x.getPath().getParent() for x in _found(spark, f"{folder}/{kind}-*/_SUCCESS")]
    return {int(p.getName().split("-")[1]): p.toString() for p in marks}


def commit(details: DataFrame, lease: Lease) -> None:
    """Write a run's rows; once more does nothing."""
    spark = details.sparkSession
    if lease.number not in _whole(spark, lease.folder, "run"):
        details.select(*[c.split()[0] for c in ROW.split(", ")]).write.mode("overwrite").parquet(f"{lease.folder}/run-{lease.number:09}")


def ledger(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """path, content_hash, status and receipt_id by each path's last whole run (of those before a number)."""
    within = lambda found: {n: p for n, p in found.items() if before is None or n < before}
    bases = within(_whole(spark, folder, "base"))
    base = max(bases, default=0)
    parts = [(n, p) for n, p in sorted(within(_whole(spark, folder, "run")).items()) if n > base] + ([(base, bases[base])] if base else [])
    rows = spark.createDataFrame([], f"{ROW}, number long")
    if parts:
        number = F.regexp_extract(F.input_file_name(), r"/(?:run|base)-(\d+)/[^/]*$", 1).cast("long")
        rows = spark.read.schema(ROW).parquet(*[p for _, p in parts]).withColumn("number", number)
    last = rows.groupBy("path").agg(F.max_by(F.struct("content_hash", "status", "receipt_id"), "number").alias("r"))
    return last.select("path", "r.*")


def compact(spark: SparkSession, lease: Lease) -> None:
    """Write the ledger before this lease's run as one folder, which is read in place of the runs up to it."""
    number = lease.number - 1
    if number and number not in _whole(spark, lease.folder, "base"):
        ledger(spark, lease.folder, lease.number).write.mode("overwrite").parquet(f"{lease.folder}/base-{number:09}")
