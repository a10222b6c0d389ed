"""Fits with bounded rates: ceilings that are met, and targets out of reach, which are fitted to the end."""

import warnings

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing
from tallyspark.llm.queries import TARGET_SHARES


def fitted(spark, rows, shares, **bounds):
    """The fit, and the rows' totals by domain at its rates."""
    df = spark.createDataFrame([(int(n), [float(x) for x in p]) for n, p in rows], "n_tokens long, p array<double>")
    fit = mixing.fit_rates(df, shares, **bounds)
    got = df.select("n_tokens", "p", fit.rate(F.col("n_tokens"), F.col("p")).alias("r")).collect()
    return fit, got, np.sum([[x * r.n_tokens * r.r for x in r.p] for r in got], 0) / sum(n for n, _ in rows)


def test_ceilings_are_met_beside_soft_posteriors(spark):
    """Toxic documents hold good tokens too, which nothing makes up for where no document repeats."""
    rng = np.random.default_rng(1)
    rows = [(rng.integers(50, 400), p) for p in [*rng.dirichlet([60, 0.1, 1], 180), *rng.dirichlet([3, 0.1, 7], 30)]]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit, got, totals = fitted(spark, rows, TARGET_SHARES, keep=0.5, most=1.0, ceilings=mixing.DOMAINS[1:])
    share = totals / totals.sum()
    assert fit.steps and share[1] <= 0.061 and abs(share[2] - 0.04) <= 2e-3
    assert all(0 <= r.r <= 1 and (r.r == 1 or r.p[0] < 0.5) for r in got)


@pytest.mark.parametrize("replayed", [5, 32])
def test_bounded_fits_end_at_the_nearest(spark, monkeypatch, replayed):
    monkeypatch.setattr(mixing, "REPLAYED", replayed)
    rng = np.random.default_rng(5)
    rows = [(rng.integers(20, 300), p) for p in rng.dirichlet([4, 4, 2.6], 120)]
    shares = {"good": 0.54, "poor": 0.12, "toxic": 0.34}
    with pytest.warns(UserWarning, match="miss a target"):
        fit, _, totals = fitted(spark, rows, shares, keep=0.5, most=1.0, ceilings=mixing.DOMAINS[1:])
    # many plain steps, without momentum
    n = np.array([n for n, _ in rows], float)
    p = np.array([p for _, p in rows])
    a, least = p * n[:, None] / n.sum(), np.where(p[:, 0] >= 0.5, 1.0, 0.0)
    gram, rules, r = a.T @ a, np.array([np.eye(3)[i] - list(shares.values())[i] for i in (1, 2)]), np.ones(len(n))
    off = lambda x: x - mixing.within_ceilings(x, gram, rules)
    for _ in range(5000):
        r = np.clip(r - a @ np.linalg.solve(gram, off(a.T @ r)), least, 1)
    assert np.abs(off(totals) - off(a.T @ r)).max() <= 1e-3
    assert abs(fit.misses[-1] - np.abs(off(a.T @ r)).max()) <= 1e-3 and len(fit.steps) > 5


def test_nearest_mix_within_ceilings():
    rng = np.random.default_rng(0)
    rules = np.array([[-0.06, 0.94, -0.06], [-0.04, -0.04, 0.96]])
    for _ in range(50):
        b = rng.normal(size=(3, 3))
        gram, x = b @ b.T, rng.random(3)
        best = mixing.within_ceilings(x, gram, rules)
        assert (rules @ best).max() <= 2e-9
        metric = np.linalg.inv(gram)
        far = lambda y: (y - x) @ metric @ (y - x)
        for _ in range(200):
            y = best + rng.normal(size=3) * 10 ** rng.uniform(-3, 0)
            if (rules @ y).max() <= 0:
                assert far(y) >= far(best) * (1 - 1e-6) - 1e-9


def test_nothing_to_tell_documents_apart(spark):
    """Without labels all posteriors are equal; no rates change a share, and nothing is thinned."""
    with pytest.warns(UserWarning, match="miss a target"):
        fit, got, _ = fitted(spark, [(10, [1 / 3] * 3), (25, [1 / 3] * 3)], TARGET_SHARES, keep=0.5, most=1.0, ceilings=mixing.DOMAINS[1:])
    assert not fit.steps and [r.r for r in got] == [1.0, 1.0]


def test_the_stage_meets_its_shares(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        kept = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    assert 0 < kept.count() < docs.count()
