import random

import corpus_pipeline
from tallyspark.llm import minmax_dedup


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))}


def similar(a, b, k):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_the_stage_keeps_what_brute_force_on_five_words_keeps(spark, sf_dir):
    rng, texts = random.Random(5), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts.append(" ".join(base))
        for edits in (2, 3, 4):
            copy = list(base)
            for j in range(edits):
                copy[10 + 30 * j] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    kept = {}
    for k in (4, 5):
        parent = list(range(len(texts)))
        sets = [shingles(t, k) for t in texts]

        def find(i):
            return i if parent[i] == i else find(parent[i])

        for a in range(len(texts)):
            for b in range(a):
                if similar(sets[a], sets[b], k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        kept[k] = {i for i in range(len(texts)) if find(i) == i}
    assert kept[4] < kept[5]  # the texts tell four words from five
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()} == kept[5]
    # op 10's width, on the operator itself
    assert {r.doc_id for r in minmax_dedup.keep_one(docs, words=4).collect()} == kept[4]
