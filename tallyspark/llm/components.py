"""Connected components of link tables, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) of every node in links.

    Large-star and small-star steps alternate until the links form stars around the smallest nodes; each
    round is written to the shared folder. Nodes with very many links only meet joins whose skewed
    partitions Spark splits. Null ends and loops are passed over; no links give no rows.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e = stored(e, "links")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # every larger neighbour of u goes to the smallest of u's neighbours and itself
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        # u and its smaller neighbours go to the smallest of them
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "links")
        now = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        drop_stored(e)
        e = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
