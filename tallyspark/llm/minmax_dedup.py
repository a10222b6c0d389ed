"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles: of five words in the pipeline's stage, of four in op 10. Under each of 48 permutations both the minimum and the
maximum are kept, 96 values for 48 hash evaluations; groups of four make 24 bands. Documents with
equal sets are one class. In each band's bucket every class is paired with the bucket's smallest one;
pairs that the sizes or the one-bit sketches of the values rule out (five standard deviations below
0.8) go, the likeliest two of a class are confirmed on their full sets. Buckets that then still hold several clusters form groups,
one for each most frequent cluster. In groups of a few classes all pairs across clusters are tried. In larger ones
sets are written as departures from the group's consensus, and only classes that share rare departures are compared
(difference_links); this finds every link, without pairing all that is merely alike. Components follow from the confirmed links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, fresh, if_small, mix64, stored
from .components import connected_components
from .sentencepiece_codec import small_batches
from .text_features import text_bytes

#: Words of a shingle unless told otherwise; op 10 asks for four.
WORDS = 5
PERMUTATIONS, BAND = 48, 4
SIMILAR_PERCENT = 80
#: Most differing bits of two sketches of 96 bits: 9.6 are expected at 0.8, with a deviation of 2.9.
SKETCH_BITS = 24
#: How many of the hubs that a class meets, those with the most similar sketches, are confirmed.
HUB_TESTS = 2
#: Groups of so many classes are compared pair by pair, so a class meets fewer than that; larger ones by departures from their consensus.
SMALL_GROUP = 32
BLOCK = 1 << 14
WORD_CACHE = 300_000

_MULTIPLIERS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(raw: bytes, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; fewer words are one shingle, no words none."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        h = mix64(h * _STEP + w[j : n - width + 1 + j])
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation: PERMUTATIONS x 2 values."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(h), BLOCK):
        x = h[at : at + BLOCK, None] * _MULTIPLIERS
        x ^= x >> np.uint64(32)
        x *= _STEP
        low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    return np.stack([low, high], axis=1)


def bands_and_sketch(values: np.ndarray) -> tuple[np.ndarray, int, int]:
    """24 band hashes, each of two permutations' minima and maxima, and one bit of every value, as two numbers."""
    rows = values.reshape(-1, BAND)
    out = np.arange(len(rows), dtype=np.uint64)
    for j in range(BAND):
        out = mix64(out * _STEP + rows[:, j])
    bits = (mix64(values) & np.uint64(1)).astype(np.uint8)
    low, high = (int.from_bytes(np.packbits(bits[:, j]).tobytes(), "big") for j in (0, 1))
    return out.view(np.int64), low, high


SIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def _text_key(docs: DataFrame) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(docs["text"])


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, t (a key of the text), n (shingles), k1 and k2 (a 128-bit key of the set), s1 and s2 (its sketch), bands; null bands for an empty set."""
    small_batches(docs.sparkSession)

    def signed(batches):
        hashes = WordHashes()
        for batch in batches:
            n, k1, k2, s1, s2, bands = [], [], [], [], [], []
            for x in batch.column("raw"):
                h = shingles(x.as_py(), hashes, words)
                n.append(len(h))
                if len(h):
                    b, low, high = bands_and_sketch(signature(h))
                    k1.append(h.sum().view(np.int64).item())
                    k2.append(mix64(h ^ _STEP).sum().view(np.int64).item())
                    bands.append(b)
                    s1.append(low)
                    s2.append(high)
                else:
                    for column in (k1, k2, s1, s2, bands):
                        column.append(None)
            longs = [pa.array(c, pa.int64()) for c in (n, k1, k2, s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *longs, pa.array(bands, pa.list_(pa.int64()))], names=SIGNED.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs).alias("t"), text_bytes().alias("raw")).mapInArrow(signed, SIGNED)


def classes_of(signed: DataFrame) -> DataFrame:
    """The distinct sets: k1, k2, n, node (a number of the class's own), rep (the id and text key of one of its rows), sketch and bands.

    Nodes are numbers given while the table is written, so they hold for whoever reads it."""
    whole = signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n")
    found = whole.agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands"))
    return stored(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def shingle_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int, repeated: bool) -> DataFrame:
    """node, n and h (the sorted shingle hashes) of the classes in nodes, each text read once. repeated: docs has equal rows."""
    wanted = classes.join(nodes, "node", "left_semi").select("rep.doc_id", "rep.t", "node")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs).alias("t"), text_bytes().alias("raw"))

    def hashed(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(x.as_py(), hashes, words).view(np.int64) for x in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(h) for h in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "h"])

    found = texts.join(if_small(stored(wanted, "wanted")), ["doc_id", "t"]).select("node", "raw").mapInArrow(hashed, "node long, n long, h array<long>")
    return stored(found.dropDuplicates(["node"]) if repeated else found, "sets")


def _differing_bits(x: str, y: str) -> Column:
    return F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) + F.bit_count(F.col(f"{x}.s2").bitwiseXOR(F.col(f"{y}.s2")))


def _may_link(x: str, y: str) -> Column:
    """By their sizes and sketches, two classes may be similar enough."""
    n = [F.col(f"{s}.n") for s in (x, y)]
    return (F.least(*n) * 100 >= F.greatest(*n) * SIMILAR_PERCENT) & (_differing_bits(x, y) <= SKETCH_BITS)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")), sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where(100 * F.col("both") >= SIMILAR_PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


class _Clusters:
    """Which classes are known to be connected. Links found later join whole clusters: only those are contracted again."""

    def __init__(self):
        self.table: DataFrame | None = None  # node, c; classes without links are their own

    def of(self, rows: DataFrame, column: str = "node", name: str = "c") -> DataFrame:
        if self.table is None:
            return rows.withColumn(name, F.col(column))
        return rows.join(self.table.select(F.col("node").alias(column), F.col("c").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def add(self, links: DataFrame) -> None:
        between = self.of(self.of(links.select("a", "b"), "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
        joined = connected_components(between).select("node", F.col("component").alias("c"))
        if self.table is None:
            self.table = stored(joined, "clusters")
            return
        moved = joined.select(F.col("node").alias("c"), F.col("c").alias("to"))
        kept = self.table.join(moved, "c", "left").select("node", F.coalesce("to", "c").alias("c"))
        before, self.table = self.table, stored(kept.unionByName(joined.join(self.table, "node", "left_anti")), "clusters")
        drop_stored(before)


def _open_groups(members: DataFrame, clusters: _Clusters) -> DataFrame:
    """home, node, c and x of the classes whose buckets hold several clusters; home: the most frequent cluster of a bucket.

    Buckets of one home are one group, in which a class counts once."""
    placed = stored(clusters.of(members), "placed")
    sizes = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("n", F.negate("c"))).alias("home"), F.count(F.lit(1)).alias("several")).where("several > 1").select("bucket", "home")
    groups = stored(placed.join(homes, "bucket").select("home", "node", "c", "x").dropDuplicates(["home", "node"]), "groups")
    drop_stored(placed)
    return groups


def _likeliest(met: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b, bits) the n with the fewest differing bits for each b. A b meets one hub in each of its bands."""
    best = met.groupBy("b").agg(F.slice(F.sort_array(F.collect_set(F.struct("bits", "a"))), 1, n).alias("best")).select("b", F.explode("best.a").alias("a"))
    return stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "hub-pairs")


def _small_pairs(groups: DataFrame) -> DataFrame:
    """Pairs across clusters in groups of at most SMALL_GROUP classes, as far as sizes and sketches let them link."""
    y = groups.select("home", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("x").alias("y"))
    met = groups.join(y, (groups["home"] == y["home"]) & (F.col("node") < F.col("b")) & (F.col("c") != F.col("cb")) & _may_link("x", "y"))
    return stored(met.select(F.col("node").alias("a"), "b").distinct(), "small-pairs")


def difference_links(groups: DataFrame, sets: DataFrame, clusters: _Clusters) -> DataFrame | None:
    """All links across clusters in groups (home, node, c) of any size; clusters gets those with the groups' centres.

    The consensus R of a group holds the shingles of more than half of its sets, and D(x) = x xor R is how
    x departs from it; D(x) xor D(y) = x xor y. With p = SIMILAR_PERCENT, x and y are similar enough if and only if
        |D(x) & D(y)| >= (g(x) + g(y)) / (2 (100 + p)),  g(x) = (100 + p) |D(x)| - (100 - p) |x|.
    The centre has the least g; whoever has g(x) + g(y) <= 0 for some y is surely linked with it. All other
    pairs have to share departures, of which most are a set's own: of the shared ones, rarest first, a prefix that is
    longer than what may miss is looked up. Pairs that meet there are tested on their departures, which is exact.
    """
    up, down = 100 + SIMILAR_PERCENT, 100 - SIMILAR_PERCENT
    members = stored(groups.select("home", "node").join(sets, "node"), "members")
    counted = stored(members.select("home", F.explode("h").alias("e")).groupBy("home", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "counted")
    sizes = stored(members.groupBy("home").agg(F.count(F.lit(1)).alias("size")), "sizes")
    common = counted.join(sizes, "home").withColumn("typical", 2 * F.col("f") > F.col("size"))
    consensus = common.where("typical").groupBy("home").agg(F.collect_list("e").alias("r"))
    r = F.coalesce("r", F.array().cast("array<long>"))
    parted = members.join(consensus, "home", "left").select("home", "node", "n", F.concat(F.array_except("h", r), F.array_except(r, F.col("h"))).alias("d"))
    parted = stored(parted.withColumn("g", up * F.size("d") - down * F.col("n")), "departures")

    def overlap(x: Column, y: Column, gs: Column) -> Column:
        return 2 * up * F.size(F.array_intersect(x, y)) >= gs

    centre = parted.groupBy("home").agg(F.min_by(F.struct("node", "g", "d"), F.struct("g", "node")).alias("m"))
    met = parted.join(centre, "home").where((F.col("node") != F.col("m.node")) & overlap(F.col("d"), F.col("m.d"), F.col("g") + F.col("m.g")))
    links = stored(met.select(F.col("m.node").alias("a"), F.col("node").alias("b")), "centre-links")
    if not links.isEmpty():
        clusters.add(links)
    drop_stored(members)
    # home is now the centre's cluster; away has what lies in others
    placed = stored(clusters.of(parted.select("home", "node", "g")), "placed")
    homes = centre.select("home", F.col("m.node").alias("node")).join(placed.select("home", "node", "c"), ["home", "node"]).select("home", F.col("c").alias("hc"))
    sided = placed.join(homes, "home").withColumn("away", F.col("c") != F.col("hc"))
    least = sided.groupBy("home").agg(F.min(F.when(F.col("away"), F.col("g"))).alias("ga"), F.min(F.when(~F.col("away"), F.col("g"))).alias("gh")).where("ga is not null")
    sided = stored(sided.join(least, "home").select("home", "node", "c", "g", "away", "ga", "gh"), "sided")
    if sided.isEmpty():
        return None
    departed = F.when(F.col("typical"), F.col("size") - F.col("f")).otherwise(F.col("f"))
    rarity = common.select("home", "e", departed.alias("f")).where("f > 1")
    shared = parted.select("home", "node", F.explode("d").alias("e")).join(rarity, ["home", "e"])
    lists = shared.groupBy("home", "node").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("s")).join(sided, ["home", "node"])

    def prefix(other: str) -> Column:
        """The shared departures but those that may be missed: ceil((g + other) / (2 up)) - 1 of them."""
        needed = F.greatest(F.ceil((F.col("g") + F.col(other)) / (2.0 * up) - 1e-9), F.lit(1))
        return F.slice(F.transform("s", lambda x: x["e"]), F.lit(1), F.greatest(F.size("s") - needed + 1, F.lit(0)).cast("int"))

    lists = stored(lists.select("home", "node", "c", "away", F.when(F.col("away"), prefix("gh")).otherwise(prefix("ga")).alias("across"), F.when(F.col("away"), prefix("ga")).alias("among")), "prefixes")
    across = lists.select("home", "node", "away", F.explode("across").alias("e"))
    among = lists.where("away").select("home", "node", "c", F.explode("among").alias("e"))
    one = across.where("away").select("home", "e", F.col("node").alias("a")).join(across.where("not away").select("home", "e", F.col("node").alias("b")), ["home", "e"])
    x, y = among.select("home", "e", F.col("node").alias("a"), F.col("c").alias("ca")), among.select(F.col("home").alias("home2"), F.col("e").alias("e2"), F.col("node").alias("b"), F.col("c").alias("cb"))
    two = x.join(y, (x["home"] == y["home2"]) & (x["e"] == y["e2"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    pairs = stored(one.select("home", "a", "b").unionByName(two.select("home", "a", "b")).distinct(), "candidates")
    for used in (counted, placed, sided, lists):
        drop_stored(used)
    if pairs.isEmpty():
        return None
    side = lambda at: parted.select("home", F.col("node").alias(at), F.col("d").alias(f"d{at}"), F.col("g").alias(f"g{at}"))
    tested = pairs.join(side("b"), ["home", "b"]).join(side("a"), ["home", "a"])
    return stored(tested.where(overlap(F.col("da"), F.col("db"), F.col("ga") + F.col("gb"))).select("a", "b").distinct(), "departure-links")


def linked_classes(classes: DataFrame, docs: DataFrame, words: int, repeated: bool) -> _Clusters:
    """The clusters of classes (node, n, s1, s2, bands)."""
    members = classes.select(F.explode("bands").alias("bucket"), "node", F.struct("node", "n", "s1", "s2").alias("x"))
    hubs = members.groupBy("bucket").agg(F.min("x").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "hub")
    clusters = _Clusters()
    members = stored(members.join(hubs, "bucket"), "bucket-members")
    pairs = members.where(F.col("x.node") != F.col("hub.node")).where(_may_link("x", "hub")).select(F.col("hub.node").alias("a"), F.col("x.node").alias("b"), _differing_bits("x", "hub").alias("bits"))
    todo = _likeliest(pairs, HUB_TESTS)
    members = members.select("bucket", "node", "x")
    sets = shingle_sets(todo.select(F.col("a").alias("node")).unionByName(todo.select(F.col("b").alias("node"))).distinct(), classes, docs, words, repeated)
    if not todo.isEmpty():
        clusters.add(stored(confirmed(todo, sets), "links"))
    drop_stored(sets)
    groups = _open_groups(members, clusters)
    large = stored(groups.groupBy("home").count().where(F.col("count") > SMALL_GROUP).select("home"), "large")
    pairs = _small_pairs(groups.join(large, "home", "left_anti"))
    wide = groups.join(large, "home", "left_semi").select("home", "node", "c")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(wide.select("node")).distinct()
    sets = shingle_sets(nodes, classes, docs, words, repeated)
    if not pairs.isEmpty():
        clusters.add(stored(confirmed(pairs, sets), "links"))
    if not large.isEmpty():
        more = difference_links(wide, sets, clusters)
        if more is not None and not more.isEmpty():
            clusters.add(more)
    for used in (members, groups, pairs, sets):
        drop_stored(used)
    return clusters


def _labelled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t, n, component_id, and first (the row's text key is the first of its component's rows with that id) of every row."""
    signed = stored(signatures(docs, words), "signatures")
    classes = classes_of(signed)
    # rows that repeat an id and its text; none in ordinary tables
    repeated = not signed.groupBy("doc_id", "t").count().where("count > 1 and doc_id is not null").isEmpty()
    clusters = linked_classes(classes, docs, words, repeated)
    placed = stored(clusters.of(classes.select("k1", "k2", "n", "node", "rep")), "placed")
    drop_stored(classes)
    least = placed.groupBy("c").agg(F.min("rep").alias("least"))
    reps = placed.join(least, "c").select("k1", "k2", "n", "least")
    rows = signed.select("doc_id", "t", "n", "k1", "k2").join(reps, ["k1", "k2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    return rows.select("doc_id", "t", "n", component.alias("component_id"), (F.col("least").isNull() | (F.struct("doc_id", "t") == F.col("least"))).alias("first"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row of docs (doc_id, text).

    Documents link where 100 * intersection >= 80 * union of their sets of shingles of so many words. Null, empty and wordless texts have
    no shingles and link with nothing. Rows with a null id link with nothing: component_id null, kept False.
    Rows that repeat an id are judged by the text of each: an id doesn't link them. Copies count as one class and are never expanded to pairs;
    an empty table gives an empty result.
    """
    rows = _labelled(docs, words)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, with their columns: one of each group, that with the smallest id (of rows that repeat it, one).

    Rows with a null id and rows without shingles belong to no group and stay.
    """
    found = stored(_labelled(docs, words), "duplicates")
    names = [docs[f"`{c}`"] for c in docs.columns]
    dropped = stored(found.where("doc_id is not null and not first or doc_id <> component_id").select("doc_id", "t").distinct(), "dropped")
    doc_id, t = fresh(docs, "id"), fresh(docs, "t")
    keyed = docs.withColumns({doc_id: docs["doc_id"].cast("long"), t: _text_key(docs)})
    gone = if_small(dropped.select(F.col("doc_id").alias(doc_id), F.col("t").alias(t)))
    again = found.where("first and n > 0 and doc_id = component_id").groupBy("doc_id", "t").count().where("count > 1").select(F.col("doc_id").alias(doc_id), F.col("t").alias(t))
    out = keyed.join(gone, [doc_id, t], "left_anti")
    if not again.isEmpty():
        again = stored(again, "again")
        once = out.join(again, [doc_id, t], "left_semi").dropDuplicates([doc_id, t])
        out = out.join(again, [doc_id, t], "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
