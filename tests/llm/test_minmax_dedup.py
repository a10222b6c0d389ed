import random

import pytest

from tallyspark.llm import minmax_dedup as m


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(i, set()).update({tuple(w[j : j + 4]) for j in range(max(len(w) - 3, 1))} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))) for i in range(60)]
    base = rng.choices(vocabulary, k=150)
    # a large group of copies of one text, many of which are alike but link with none
    rows += [(1000 + i, mutated(rng, base, rng.randint(0, 14))) for i in range(150)]
    rows += [(2000 + i, rows[0][1].upper()) for i in range(30)]
    return rows + [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "One two"), (3004, "one  TWO"), (3005, "É a"), (3006, "é a")]


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for i, (n, component) in want.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, i == component)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(empty).count() == 0 and m.keep_one(empty).count() == 0
    rows = [(None, "a b c d e", 1), (2, "a b c d e", 2), (2, "a b c d e", 3), (1, "A b c d e", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    found = sorted((r.doc_id or 0, r.component_id, r.kept) for r in m.near_duplicates(df).collect())
    assert found == [(0, None, False), (1, 1, True), (2, 1, False), (2, 1, False)]
    kept = m.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]


def test_minima_and_maxima_estimate_without_bias():
    import numpy as np

    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.sort(x[:200]), np.sort(x[50:])  # 150 of 300 in common
        errors.append((m.signature(a) == m.signature(b)).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.03


def test_links_by_departures_are_all_links(spark):
    """Against all pairs, for sets around one consensus and for such as have none."""
    rng = random.Random(9)
    sets = []
    for home in (1, 2):
        core = rng.sample(range(10**6), 60)
        for _ in range(60):
            own = set(core) if home == 1 else set(rng.sample(core, 40))
            for _ in range(rng.randint(0, 12)):
                own.discard(rng.choice(core))
                own.add(rng.choice(core) + rng.choice([10**7, 10**8 + rng.randrange(10**6)]))
            sets.append((home, len(sets), sorted(own)))
    groups = spark.createDataFrame([(h, n, n) for h, n, _ in sets], "home long, node long, c long")
    table = spark.createDataFrame([(n, len(s), s) for _, n, s in sets], "node long, n long, h array<long>")
    clusters = m._Clusters()
    more = m.difference_links(groups, table, clusters)
    if more is not None and not more.isEmpty():
        clusters.add(more)
    got = {r.node: r.c for r in clusters.table.collect()}
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for h, a, x in sets:
        for k, b, y in sets[:a]:
            both = len(set(x) & set(y))
            if h == k and 100 * both >= 80 * (len(x) + len(y) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {n: got.get(n, n) for _, n, _ in sets} == {n: find(n) for _, n, _ in sets}


def test_repeated_ids_lose_no_text(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (6, "v w x y z"), (7, "a b c d e"), (7, "a b c d e"), (8, "k l m n o"), (8, "k l m n o"), (9, None), (9, " ")]
    df = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id long, T int")
    kept = m.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, "a b c d e"), (5, "v w x y z"), (8, "k l m n o"), (9, ""), (9, " ")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(df).collect())
    assert found == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (7, 1, 5, False), (8, 1, 8, True), (8, 1, 8, True), (9, 0, 9, True), (9, 0, 9, True)]


def test_recall_just_above_the_threshold(spark):
    """Planted pairs with similarities from 0.80 to 0.85: at least nine of ten are found; none below 0.80 is."""
    rng = random.Random(8)
    rows, wanted, below = [], set(), set()
    for i in range(150):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(112, 140))]
        copy = list(base)
        for j in range(3 if i % 5 else 4):
            copy[8 + 20 * j] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        a, b = ({tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (base, copy))
        similarity = len(a & b) / len(a | b)
        (wanted if 0.80 <= similarity < 0.85 else below if similarity < 0.80 else set()).add(2 * i)
    assert len(wanted) > 80 and len(below) > 10
    got = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    found = {i for i in wanted | below if got[i] == got[i + 1]}
    assert len(found & wanted) >= 0.9 * len(wanted) and not found & below
