"""Columns that are named like inner ones, and four operators recomputed row by row in plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import embedding_dedup, mixing, quality, sharding
from tallyspark.llm.common import scratch_dir
from tallyspark.llm.queries import QUERIES

TEXTS = [(1, "a b c"), (1, "a b c"), (2, ""), (None, "x y"), (None, None), (3, "word " * 30), (4, "An ordinary sentence, with commas. And another one.")]


def docs(spark, extra):
    """The texts with columns of these names, each with a value of its own."""
    return spark.createDataFrame([(i, t, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(TEXTS)], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in extra)}")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_columns_survive(spark):
    df = docs(spark, ["quality", "score", "__quality"])
    assert rows(quality.keep_good(df, labels(spark), threshold=0.0)) == rows(df)
    df = docs(spark, ["membership", "Copies", "copy", "n_tokens", "p"])
    kept = mixing.resample(df, labels(spark), {"good": 1.0}, keep=0.0)
    assert kept.columns == df.columns and rows(kept) == rows(df)
    df = docs(spark, ["bucket", "inside", "Earlier", "__b"]).withColumns({"crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "slot": F.lit("old")})
    placed = sharding.number_slots(sharding.assign_shards(df, "doc_id", sharding.balanced_tree(3)), "doc_id", ["crc"])
    assert rows(placed.drop("shard", "grown_shard", "slot")) == rows(df.drop("slot"))
    for _, group in placed.toPandas().groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))


def test_mix_of_odd_rows(spark):
    out = mixing.mix(docs(spark, ["rate"]), labels(spark), {"good": 0.8, "poor": 0.1, "toxic": 0.1}).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 0), (0, 2), (1, 3), (1, 3), (2, 0), (3, 30), (4, 8)]
    assert all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-6 for r in out)
    assert len({r.rate for r in out if r.doc_id == 1}) == 1


def test_out_of_reach_targets_are_told(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (10, [0.9, 0.1, 0.0])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss a target"):
        fitted = mixing.fit_rates(df, {"good": 0.2, "poor": 0.4, "toxic": 0.4}, keep=0.5)
    assert len(fitted.steps) < 100 and fitted.misses[-1] > 0.1


def test_op4_against_plain_projected_gradient(spark, sf_dir):
    """The least-squares rates from the posteriors, by many small steps without momentum on the driver."""
    out = QUERIES["op4_soft_mixing"](spark, sf_dir).collect()
    n = np.array([r.n_tokens for r in out], float)
    a = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in out]) * n[:, None] / n.sum()
    target, r = np.array([0.90, 0.06, 0.04]), np.ones(len(n))
    metric = np.linalg.pinv(a.T @ a, rcond=1e-10)
    for _ in range(2000):
        r = np.maximum(0, r - 0.5 * a @ (metric @ (a.T @ r - target)))
    got = np.array([x.rate for x in out])
    assert (got >= 0).all() and np.abs(a.T @ got - target).max() < 2e-3 and np.abs(a.T @ r - target).max() < 2e-3
    # both lie near the projection of 1: the objective is flat there, so rates are compared by the tokens that they move
    assert float((n * np.abs(got - r)).sum() / n.sum()) < 0.05


def test_op8_against_a_descent_in_python(spark, sf_dir):
    """The tree is walked from the root with the exponential draws of each child."""
    table = QUERIES["op8_hash_tree"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    some = random.Random(1).sample(table, 60)

    def paths(node, path=""):
        for c in node.children:
            yield f"{path}/{c.name}"
            yield from paths(c, f"{path}/{c.name}")

    for tree, column in ((sharding.balanced_tree(24), "shard"), (sharding.grown(sharding.balanced_tree(24)), "grown_shard")):
        names = sorted(set(paths(tree)))
        hashes = spark.createDataFrame([(r.doc_id,) for r in some], "doc_id long").select("doc_id", *[F.xxhash64(F.lit(20), F.lit(p), "doc_id").alias(p) for p in names]).collect()
        for row in hashes:
            node, path = tree, ""
            while node.shard is None:
                draw = lambda c: -math.log(((row[f"{path}/{c.name}"] % 2**64 >> 11) + 0.5) / 2**53) / c.weight  # noqa: B023, E731
                node = min(node.children, key=draw)
                path += f"/{node.name}"
            assert next(r[column] for r in some if r.doc_id == row["doc_id"]) == node.shard
    slots = {}
    for r in table:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_features(raw):
    """shape_features by loops."""
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"#$%&*", b"|", b"\"'=:;-_", b"()[]{}<>", b"@/\\+~^`", bytes(range(128, 256))]
    words = raw.split()
    if not words:
        return [0.0] * 20 + [1.0]
    lines = [x for x in raw.split(b"\n") if x]
    shares = [math.sqrt(sum(x in s for x in raw) / len(raw)) for s in sets]
    twice = sum(a == b for a, b in zip(words, words[1:]))
    return [*shares, math.log1p(len(raw)) / 10, math.log1p(len(words)) / 10, min(len(raw) / len(words), 40) / 10, len(set(words)) / len(words), len(set(lines)) / len(lines), math.sqrt(twice / len(words)), 0.0]


def test_op9_against_plain_scores(spark, sf_dir):
    documents, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, marks)
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for r in QUERIES["op9_quality_pu"](spark, sf_dir).collect():
        x = [min(max((f - m) / s, -8), 8) for f, m, s in zip(plain_features(texts[r.doc_id]), model.mean, model.scale)]
        z = sum(v * w for v, w in zip([*x, *[v * v / 4 for v in x]], model.weights)) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-min(max(z, -50), 50)))) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_one_id_with_two_vectors(spark):
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([(5, x), (5, y), (6, y), (7, x), (8, None)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 0, 8, True)]
    assert embedding_dedup.Plan.of(10**9).bits == 30  # buckets stay small however many vectors there are


class _Session:
    """What scratch_dir asks of a session."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-of-the-test", "getConf": staticmethod(dict)})


def test_no_local_folder_beyond_one_process():
    with pytest.raises(RuntimeError, match="share"):
        scratch_dir(_Session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="share"):
        scratch_dir(_Session("local-cluster[2,1,1024]"))
    assert scratch_dir(_Session("local[4]")) == scratch_dir(_Session("local[4]"))
