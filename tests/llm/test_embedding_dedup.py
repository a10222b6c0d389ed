import math

import numpy as np

from tallyspark.llm import embedding_dedup as e


def brute(rows):
    units = {i: e.usable(v) for i, v in rows if i is not None}
    ids = [i for i in sorted(units) if units[i] is not None]
    links, parent = {i: 0 for i in units}, {i: i for i in units}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in units}


def vectors(seed=1, d=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(d).tolist()) for i in range(80)]
    for i in range(80, 160):
        base, noise = np.array(rows[i % 9][1]), rng.standard_normal(d)
        near = base / np.linalg.norm(base) + 0.15 * noise / np.linalg.norm(noise) * rng.integers(1, 3)
        rows.append((i, (near * rng.uniform(0.1, 9)).tolist()))
    rows += [(200 + i, rows[3][1]) for i in range(10)]
    return rows + [(300, None), (301, []), (302, [0.0] * d), (303, [math.nan] * d), (304, [None] + [1.0] * (d - 1)), (305, [1.0, 2.0]), (306, [2.0, 4.0])]


def test_equals_brute_force(spark):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, bucket int"
    assert e.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 2.0], 1)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in e.near_duplicates(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    turn = e.Rotations(256).of(64)
    errors, inside = [], 0
    for _ in range(300):
        x, q = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 64)))
        q = 0.7 * x + 0.7 * q
        q /= np.linalg.norm(q)
        tx, tq = (np.einsum("rij,j->ri", turn, v) for v in (x, q))
        factors = np.abs(tx).sum(1) / 8
        middle, deviation = e.estimates(np.where(tx >= 0, 1.0, -1.0)[None], factors[None], tq[None])
        errors.append(middle[0] - x @ q)
        inside += abs(errors[-1]) <= 3 * deviation[0]
    assert abs(np.mean(errors)) < 0.01 and inside >= 290
