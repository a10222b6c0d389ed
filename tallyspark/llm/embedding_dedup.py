"""Near-duplicate embeddings by binary codes of random rotations.

Unit vectors are turned by a random rotation and kept as their signs, with the correction factor
<code, vector>. For another vector q, <code, q> / factor estimates the inner product without bias, and
its deviation is bounded by the factor (sqrt(1 - f^2) / f / sqrt(D - 1)); independent rotations are
averaged. Slices of the codes are buckets: their width follows the number of vectors, their number the
wanted recall at the threshold. Pairs of a bucket are thinned by counting differing bits, then by the
estimate's upper confidence bound; those that may reach the threshold are recomputed exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, mix64, stored
from .components import connected_components

SIMILAR = 0.95
#: Chance that a pair at the threshold shares a bucket; more similar pairs are surer.
RECALL = 0.9995
DEVIATIONS = 5.0
SKETCH = 256


@dataclass(frozen=True)
class Plan:
    """Bits of a bucket, number of buckets a vector is in, and bits of a sketch that may differ."""

    bits: int
    bands: int
    differing: int

    @staticmethod
    def of(vectors: int, similar: float = SIMILAR, recall: float = RECALL) -> "Plan":
        bits = max(math.ceil(math.log2(max(vectors, 2))), 8)
        differ = math.acos(similar) / math.pi
        bands = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
        return Plan(bits, bands, math.ceil(SKETCH * differ + DEVIATIONS * math.sqrt(SKETCH * differ * (1 - differ))))


class Rotations:
    """Random rotations by dimension, the same everywhere; enough of them for the wanted bits."""

    def __init__(self, bits: int, seed: int = 6):
        self.bits, self.seed = bits, seed
        self.made: dict[int, np.ndarray] = {}

    def of(self, d: int) -> np.ndarray:
        """(rotations, d, d)."""
        if d not in self.made:
            rng = np.random.default_rng([self.seed, d])
            qs = []
            for _ in range(max(1, -(-max(self.bits, SKETCH) // d))):
                q, r = np.linalg.qr(rng.standard_normal((d, d)))
                qs.append(q * np.sign(np.diag(r)))
            self.made[d] = np.stack(qs)
        return self.made[d]


def usable(vector) -> np.ndarray | None:
    """The unit vector in double precision; None if it is null, empty or zero, or has null or non-finite components."""
    if vector is None or not len(vector):
        return None
    x = np.asarray(vector, dtype=np.float64)  # null components become nan
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


CODED = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("unit", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("factors", T.BinaryType())]
    + [T.StructField(f"s{i}", T.LongType()) for i in range(SKETCH // 64)]
    + [T.StructField("bands", T.ArrayType(T.LongType()))]
)


def codes(vectors: DataFrame, plan: Plan, column: str = "embedding") -> DataFrame:
    """Each vector's key (k1, k2: of its exact components), unit form, code, factors, sketch and buckets; nulls for unusable ones."""

    def coded(batches):
        turn = Rotations(plan.bits * plan.bands)
        for batch in batches:
            rows = []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = usable(vector)
                if x is None:
                    rows.append((vec_id, *[None] * (len(CODED) - 1)))
                    continue
                turned = np.einsum("rij,j->ri", turn.of(len(x)), x)
                signs = turned >= 0
                factors = np.abs(turned).sum(1) / math.sqrt(len(x))
                flat = signs.ravel().astype(np.uint8)
                slices = flat[: plan.bits * plan.bands].reshape(plan.bands, plan.bits)
                values = slices.astype(np.uint64) @ (np.uint64(1) << np.arange(plan.bits, dtype=np.uint64))
                bands = mix64(values * np.uint64(4096) + np.arange(plan.bands, dtype=np.uint64) + mix64(np.full(plan.bands, len(x), np.uint64)))
                sketch = np.frombuffer(np.packbits(flat[:SKETCH]).tobytes(), ">i8").tolist()
                raw = (np.asarray(vector, dtype=np.float64) + 0.0).tobytes()
                key = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()
                rows.append((vec_id, *key, x.tobytes(), np.packbits(flat).tobytes(), factors.tobytes(), *sketch, bands.view(np.int64)))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.int64()] * (SKETCH // 64) + [pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=CODED.names)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(coded, CODED)


def estimates(code: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of coded vectors with rotated ones, and one standard deviation of them.

    code: signs as +-1 (pairs, rotations, d); factors (pairs, rotations); turned (pairs, rotations, d)."""
    d = turned.shape[2]
    each = np.einsum("prd,prd->pr", code, turned) / math.sqrt(d) / factors
    spread = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(d - 1, 1))
    return each.mean(1), np.sqrt((spread**2).sum(1)) / turned.shape[1]


def _may_reach(pairs: DataFrame, plan: Plan, similar: float) -> DataFrame:
    """Pairs (a, b, code, factors of a; unit of b) whose estimate's upper bound reaches the threshold."""

    def bounded(batches):
        turn = Rotations(plan.bits * plan.bands)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            by_width: dict[int, list[int]] = {}
            units = [np.frombuffer(x.as_py()) for x in batch.column("unit")]
            for i, x in enumerate(units):
                by_width.setdefault(len(x), []).append(i)
            for d, rows in by_width.items():
                q = turn.of(d)
                turned = np.einsum("rij,pj->pri", q, np.stack([units[i] for i in rows]))
                bits = np.stack([np.unpackbits(np.frombuffer(batch.column("code")[i].as_py(), np.uint8))[: q.shape[0] * d] for i in rows])
                factors = np.stack([np.frombuffer(batch.column("factors")[i].as_py()) for i in rows])
                middle, deviation = estimates(bits.reshape(len(rows), -1, d) * 2.0 - 1.0, factors, turned)
                keep[rows] = middle + DEVIATIONS * deviation >= similar
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(bounded, "a long, b long")


def _exact(pairs: DataFrame, similar: float) -> DataFrame:
    def compare(batches):
        for batch in batches:
            cosine = [float(np.frombuffer(x.as_py()) @ np.frombuffer(y.as_py())) for x, y in zip(batch.column("ua"), batch.column("ub"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array([c >= similar for c in cosine], pa.bool_()))

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(vectors: DataFrame, column: str = "embedding", similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do those of
    different lengths with each other. Equal vectors are one class: they count as links of each other and
    are never expanded to pairs. Rows that repeat an id with other vectors are vectors of their own. Rows that repeat both id and vector count once; rows with a null id link
    with nothing and have a null component. No pair below the threshold links; a pair at it is found with
    the chance given, and surer the more similar it is. An empty table gives an empty result.
    """
    plan = Plan.of(vectors.count(), similar, recall)
    coded = stored(codes(vectors, plan, column), "codes")
    whole = coded.where("k1 is not null and vec_id is not null")
    sketch = [f"s{i}" for i in range(SKETCH // 64)]
    firsts = [F.min_by(F.struct("unit", "code", "factors", "bands", *sketch), "vec_id").alias("x")]
    # rep is a class's own number, least the smallest id among its vectors: an id may name several vectors
    grouped = whole.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("size"), *firsts)
    classes = stored(grouped.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), "least", "size", "x.*"), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "rep", *sketch)
    x, y = members.alias("x"), members.alias("y")
    differing = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in sketch), F.lit(0))
    near = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (differing <= plan.differing))
    pairs = near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    rows = classes.select(F.col("rep").alias("a"), "code", "factors")
    others = classes.select(F.col("rep").alias("b"), "unit")
    likely = _may_reach(pairs.join(rows, "a").join(others, "b").select("a", "b", "code", "factors", "unit"), plan, similar)
    left, right = classes.select(F.col("rep").alias("a"), F.col("unit").alias("ua")), classes.select(F.col("rep").alias("b"), F.col("unit").alias("ub"))
    links = stored(_exact(likely.join(left, "a").join(right, "b").select("a", "b", "ua", "ub"), similar), "links")
    components = connected_components(links).select(F.col("node").alias("rep"), "component")
    sizes = classes.select("rep", "size")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    found = classes.select("k1", "k2", "rep", "least", "size").join(reached, "rep", "left").join(components, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    found = found.join(found.groupBy("root").agg(F.min("least").alias("smallest")), "root")
    found = stored(found.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"), F.col("smallest").alias("component")), "found")
    drop_stored(classes)
    drop_stored(links)
    out = coded.select("vec_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    real = F.col("vec_id").isNotNull()
    component = F.when(real, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(real, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
