"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. On each level every child draws an exponential variate with
the child's weight as its rate, from a hash of the row's key and the child's name; the smallest draw
wins. A child's chance is its share of the weights, and a changed weight moves rows only into or out
of that child: siblings' draws stay as they are. So movement stays inside the subtree that changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, unit_hash

ROWS_PER_BUCKET = 8192


@dataclass(frozen=True)
class Node:
    """A subtree: its name below its parent, its weight among its siblings, and either children or a shard number."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    def leaves(self) -> int:
        return 1 if self.shard is not None else sum(c.leaves() for c in self.children)


def balanced_tree(shards: int, regions: int = 2, racks: int = 3) -> Node:
    """Shards 0.. dealt over regions x racks; a subtree weighs as much as its shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    slots: list[list[list[Node]]] = [[[] for _ in range(racks)] for _ in range(regions)]
    for i in range(shards):
        slots[i % regions][i // regions % racks].append(Node(f"shard{i}", 1.0, (), i))
    tops = []
    for r, row in enumerate(slots):
        kids = tuple(Node(f"rack{k}", float(len(x)), tuple(x)) for k, x in enumerate(row) if x)
        if kids:
            tops.append(Node(f"region{r}", sum(k.weight for k in kids), kids))
    return Node("root", 1.0, tuple(tops))


def grown(tree: Node) -> Node:
    """One shard more, beside the siblings of the smallest rack. The weights above it stay, so rows move only from its siblings to it."""
    new = tree.leaves()
    racks = [(rack.leaves(), r, k) for r, region in enumerate(tree.children) for k, rack in enumerate(region.children)]
    _, r, k = min(racks)
    region = tree.children[r]
    rack = region.children[k]
    rack = replace(rack, children=(*rack.children, Node(f"shard{new}", 1.0, (), new)))
    region = replace(region, children=(*region.children[:k], rack, *region.children[k + 1 :]))
    return replace(tree, children=(*tree.children[:r], region, *tree.children[r + 1 :]))


def shard_of(key: Column, tree: Node, seed: int = 20) -> Column:
    """The shard of a key; a null key is a key of its own."""

    def descend(node: Node, path: str) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        if len(node.children) == 1:
            return descend(node.children[0], f"{path}/{node.children[0].name}")
        live = [(i, c) for i, c in enumerate(node.children) if c.weight > 0]
        draws = [F.struct((-F.log(unit_hash(F.lit(seed), F.lit(f"{path}/{c.name}"), key)) / c.weight).alias("d"), F.lit(i).alias("i")) for i, c in live]
        won = F.array_min(F.array(*draws))["i"]
        if all(c.shard is not None for _, c in live):
            return F.element_at(F.array(*[F.lit(c.shard if c.shard is not None else -1) for c in node.children]), won + 1)
        out = F.lit(None).cast("int")
        # one branch for each child; only the branch that won is evaluated
        for i, c in live:
            out = F.when(won == i, descend(c, f"{path}/{c.name}")).otherwise(out)
        return out

    return descend(tree, "").cast("int")


def assign_shards(df: DataFrame, key: str, tree: Node, seed: int = 20, shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """df with each row's shard, and the one it has with one shard more.

    Null keys share one shard; equal keys share a shard; an empty table stays empty; columns named
    like the two new ones are replaced.
    """
    return df.withColumns({shard: shard_of(F.col(key), tree, seed), grown_shard: shard_of(F.col(key), grown(tree), seed)})


def number_slots(df: DataFrame, key: str, ties: list[str], shard: str = "shard", slot: str = "slot", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Gapless positions 0.. inside each shard, without gathering a shard in one task.

    Rows of a shard are dealt into buckets by a hash of the key and numbered there; the counts of
    earlier buckets are added. Other columns stay, whatever their names; one named like the slot is replaced. The number of buckets follows the number of rows. Rows with equal key
    and ties are interchangeable.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    draw = unit_hash(F.lit(77), F.col(key), *[F.col(t) for t in ties])
    names = [c for c in df.columns if c != slot]
    bucket, inside, earlier = (fresh(df, c) for c in ("bucket", "inside", "earlier"))
    df = df.withColumn(bucket, F.floor(draw * buckets).cast("int"))
    sizes = df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(inside))
    sums = F.sum(inside).over(Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(shard, bucket, F.coalesce(sums, F.lit(0)).alias(earlier))
    place = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(draw, key, *ties))
    numbered = df.withColumn(inside, place).join(before, [shard, bucket])
    return numbered.select(*[F.col(f"`{c}`") for c in names], (F.col(earlier) + F.col(inside) - 1).cast("long").alias(slot))


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; a null text has none) and the text's unsigned crc32."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
