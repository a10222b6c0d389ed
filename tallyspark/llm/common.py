"""What several operators share: the shared scratch folder, columns, labelled rows and hashing."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all is one process (tests), a folder of our own if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@functools.cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tallyspark-")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that no later result reads."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column | str) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def crc_bucket(key: str, buckets: int) -> Column:
    """crc32(key as text) mod buckets; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def unit_hash(*parts: Column) -> Column:
    """A keyed draw from the open unit interval, equal wherever and whenever it is computed."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(2**53)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Most rows of a side of ids (8 to 40 bytes each) that are sent to all executors; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def if_small(ids: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """ids, with a broadcast hint if they number at most limit (counted unless rows is known)."""
    n = ids.count() if rows is None else rows
    return F.broadcast(ids) if n <= limit else ids
