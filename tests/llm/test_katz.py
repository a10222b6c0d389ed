import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import katz


def brute(rows):
    """The model by plain dictionaries: (scores by position, p(word, context), vocabulary)."""
    texts = [((t or "").encode().lower().split() + [katz.END], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t in rows]
    c1, c2 = Counter(), Counter()
    for words, held in texts:
        if not held:
            c1.update(words)
            c2.update(zip([None, *words], words))
    n, v = sum(c1.values()), len(c1)
    kinds = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(kinds(c1)), katz.discounts(kinds(c2))
    keep = lambda c, d: c * (d[c - 1] if c <= 5 else 1.0)
    left = n - sum(keep(c, d1) for c in c1.values())
    whole = n if left > 0 else n + 1
    p1 = lambda w: (keep(c1[w], d1) / whole if c1[w] else (left / n if left > 0 else 1 / (n + 1))) if n else 1.0
    after = defaultdict(dict)
    for (h, w), c in c2.items():
        after[h][w] = c

    def p(w, h):
        if h not in after:
            return p1(w)
        seen = after[h]
        total, kept = sum(seen.values()), sum(keep(c, d2) for c in seen.values())
        below = total if total - kept > 1e-9 else total + 1
        if w in seen:
            return keep(seen[w], d2) / below
        return (1 - kept / below) / (1 - sum(map(p1, seen))) * p1(w)

    scores = [(len(ws), sum(c1[w] > 0 for w in ws), n, sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), sum(math.log10(p(w, h)) for h, w in zip([None, *ws], ws))) for ws, _ in texts]
    return scores, p, list(c1), after


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in katz.score_documents(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    want = sorted(((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, *s) for (i, _), s in zip(rows, brute(rows)[0])), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return got


def test_scores_equal_brute_force(spark, monkeypatch):
    rows = corpus(150) + [(1000, None), (1001, ""), (1002, "  \t\n "), (1003, "W1 w1 É É unseen" * 3), (None, "w1 w2"), (7, "w1 w1 w1"), (7, "w1 w1 w1"), (1004, "w0 " * 3000)]
    compare(spark, rows)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(katz, "LEAST_BUCKETS", 3)
    compare(spark, rows)


def test_each_context_sums_to_one():
    _, p, vocabulary, after = brute(corpus(80))
    for h in [*list(after)[:20], "never seen"]:
        assert sum(p(w, h) for w in [*vocabulary, "unseen"]) == pytest.approx(1, abs=1e-9)


def test_empty_and_untrained(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    [row] = katz.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a c", 6, "y")], "doc_id long, text string, block int, keys string")
    assert katz.score_documents(df).columns == katz.SCORED.names


def test_discounts():
    assert katz.discounts([0, 0, 0, 0, 0, 0]) == [1 - 0.5 / r for r in range(1, 6)]
    zipf = katz.discounts([1000, 400, 220, 140, 95, 70])
    assert all(0 < d < 1 for d in zipf)


def test_model_is_better_than_its_base_on_held_out_texts(spark, sf_dir):
    rows = katz.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_totals_beyond_32_bits(spark):
    """A pair that three blocks count 2 000 000 000 times each."""
    words = katz.Words.of([(6_000_000_001, 1), (5, 2)], 3)
    keys, much = np.array([0, 4], np.int64), 2_000_000_000
    rows = [(b, 0, katz.PAIRS, katz.pack_sorted(keys), katz.pack(np.array([much, 1], np.int32))) for b in range(3)]
    counted = katz._counted(spark.createDataFrame(rows, katz.ROW), words).collect()
    assert [katz.unpack(r["keys"], np.int64).tolist() for r in counted if r["kind"] == katz.PAIRS] == [[3 * much, 3]] * 3
    assert [katz.unpack(r["counts"], np.int64).tolist() for r in counted if r["kind"] == katz.MODEL] == [[3 * much, 3]]
    assert {r["h"]: r["rest"] for r in counted if r["kind"] == katz.CONTEXTS} == {0: 3 * much, 1: 0}


def test_a_block_is_scored_at_once(spark, monkeypatch):
    """What depends on a word alone is computed for each distinct word of a block, not for each document."""
    words = katz.Words.of([(1, 3), (4, 2)], 2)
    asked = []
    monkeypatch.setattr(katz.Words, "count", lambda self, ids, f=katz.Words.count: asked.append(len(ids)) or f(self, ids))
    ids = np.array([0, 1, -1, 4])
    block = katz.Block([7, None, 9], np.array([False, True, False]), np.array([3, 1, 4]), np.array([1, 2, 0, 0, 1, 3, 1, 0], np.uint32), ids)
    assert katz._pairs(block, words.size).tolist() == [26, -1, -1, 25, 26, 9, 21, 5]
    contexts, place = katz._contexts(block, words.size)
    assert contexts.tolist() == [1, 4, 5] and place[[1, 3, 4]].tolist() == [0, 1, 2] and place[[0, 2]].tolist() == [3, 3]
    keys, counts = katz._asked(block, katz._pairs(block, words.size))
    assert dict(zip(keys.tolist(), counts.tolist())) == {26: 2, 25: 0, 9: 1, 21: 1, 5: 1} and not asked
