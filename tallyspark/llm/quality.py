"""Quality classifier from positive and unlabelled texts.

Trusted positives are training documents labelled good; all training documents stand for the web,
unlabelled. The share of good ones among them (the class prior) is estimated from the upper tails of
a first classifier's scores, and a logistic model minimises the non-negative unbiased risk
    prior * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - prior * E_P[loss(g, -)]).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, fresh
from .sentencepiece_codec import small_batches
from .text_features import SHAPE_NAMES, gathered_shapes, sampled, shape_features, text_bytes

#: Bounds of the samples that the model is fitted on: labelled positives, and unlabelled documents.
POSITIVE_ROWS, UNLABELLED_ROWS = 6000, 6000
FOLDS, THRESHOLD = 5, 0.3


@dataclass(frozen=True)
class Model:
    """A logistic model over standardised shape features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = expand((features - self.mean) / self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def expand(x: np.ndarray) -> np.ndarray:
    x = np.clip(x.astype(np.float64), -8, 8)
    return np.concatenate([x, x * x / 4], axis=1)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by full-batch Adam. Where the
    negative part falls below zero, a step goes along its own gradient upwards, as the estimator's authors propose."""
    w = np.zeros(p.shape[1] + 1)
    p1, u1 = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p1 @ w), _sigmoid(u1 @ w)
        positive = prior * (p1.T @ (sp - 1)) / len(p)
        negative = (u1.T @ su) / len(u) - prior * (p1.T @ sp) / len(p)
        risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gradient = positive + negative if risk >= 0 else -negative
        gradient = gradient + decay * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled: the smallest ratio of upper tails, at the threshold whose
    confidence bound is best (tails of held-out scores of a classifier of positives against unlabelled)."""
    if not len(score_p) or not len(score_u):
        return 0.5
    at = np.unique(score_p)
    tail_p = 1 - np.searchsorted(np.sort(score_p), at, side="left") / len(score_p)
    tail_u = 1 - np.searchsorted(np.sort(score_u), at, side="left") / len(score_u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(score_u)) + 1 / np.sqrt(len(score_p)))
    keep = tail_p > 0
    best = np.argmin((tail_u[keep] + slack) / tail_p[keep])
    return float(np.clip(tail_u[keep][best] / tail_p[keep][best], 0.02, 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model from features of both samples; without positives or unlabelled rows, one that scores 0.5 throughout."""
    width = len(SHAPE_NAMES)
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0, 0.5)
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 0.02)
    p, u = expand((positives - mean) / scale), expand((unlabelled - mean) / scale)
    if prior is None:
        # positives against unlabelled on the even rows; the tails are read on the odd ones
        w, b = fit_nnpu(p[::2], u[::2], 0.5, steps=300)
        prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b)
    w, b = fit_nnpu(p, u, prior)
    return Model(mean, scale, w, b, prior)


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on bounded samples of docs (doc_id, text) outside held_out; of labels (doc_id, quality) only the positives are read.

    Rows with a null id give no sample; repeated labels count once; a document labelled both ways is no positive.
    """
    small_batches(docs.sparkSession)
    held = crc_bucket("doc_id", FOLDS) == 0 if held_out is None else held_out
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    p = sampled(good.where(~held), "doc_id", positive_rows, 91).select("doc_id", F.lit(1).alias("g"))
    u = sampled(docs.where("doc_id is not null").where(~held).select("doc_id"), "doc_id", unlabelled_rows, 92).distinct().select("doc_id", F.lit(0).alias("g"))
    chosen = F.broadcast(p.unionAll(u))  # at most positive_rows + unlabelled_rows ids
    groups, features = gathered_shapes(docs.select("doc_id", "text").join(chosen, "doc_id"), "g")
    return fit(features[groups == 1], features[groups == 0])


def score_documents(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 from the whole text; a null or empty text is scored by the model too. A column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(raw: pa.Array) -> pa.Array:
        features = np.array([shape_features(x.as_py()) for x in raw]).reshape(len(raw), -1)
        return pa.array(model.score(features) if len(raw) else [], pa.float64())

    return docs.withColumn(score, scored(text_bytes()))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. A null id counts as empty text for the hash, so it is held_out, and is scored like others."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score at least threshold."""
    names = docs.columns
    quality = fresh(docs, "quality")
    scored = score_documents(docs, train(docs, labels), quality)
    return scored.where(F.col(quality) >= threshold).select(*[f"`{c}`" for c in names])
