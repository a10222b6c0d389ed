"""Op 13 against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyspark.llm import spelling_variants as sv


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def made(seed, letters):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(40)]
    docs = []
    for k in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(stems[: rng.choice((2, 5, 40))])
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((k, rng.choice((" ", ", ", "-")).join(words)))
    return [*docs, (None, docs[0][1]), (98, None), (99, ""), (0, docs[0][1]), (100, "é÷×ÿÀÉ " * 3 + "÷" * 9 + " " + "÷" * 9)]


@pytest.mark.parametrize(("seed", "letters", "group"), [(1, "ab", 20_000), (2, "abcdeé", 20_000), (3, "ab", 3)])
def test_as_all_pairs(spark, seed, letters, group, monkeypatch):
    monkeypatch.setattr(sv, "GROUP", group)
    monkeypatch.setattr(sv, "SHARD", 200)
    docs = made(seed, letters)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = sorted((tuple(r) for r in sv.spelling_variants(table).collect()), key=lambda r: r[0])
    assert got == plain(docs) and any(r[1] for r in got)


def test_long_ways_to_the_root(spark):
    words = ["aaaaaaab", "aaaaaaabb", "aaaaaaabbb", "aaaaaaabbbb", "aaaaaaabbbbb", "aaaaaaabbbbbb"]
    table = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(words)], "word string, n long")
    assert {r.word: r.root for r in sv.variants(table).collect()} == dict.fromkeys(words, words[-1])


def test_empty(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
