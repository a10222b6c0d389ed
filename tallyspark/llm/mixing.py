"""Mixing documents to target weights by soft membership.

A classifier fitted on a labelled table gives each document posteriors over domains. A document's
tokens count towards domain d by its posterior of d. Nonnegative rates r (expected copies of each
document) are fitted so that the domains' expected token totals A r match targets T:
    minimise (A r - T)' W (A r - T) / 2 over r >= 0, from r = 1, with W = inverse(A A').
In that metric the gradient's Lipschitz constant is 1, so accelerated projected gradient steps of length 1
are r' = max(0, y - A' W (A y - T)), y' = r' + b (r' - r), from y = r = 1. Each step is one distributed sum
(A y follows from the sums A r); a document's rate follows from its own row of A and the short list of
multipliers W (A y - T) of the steps so far, so no vector of rates is ever gathered.

Where shares are only ceilings, T is the mix within them that is nearest to A y in that metric: half the squared
distance to a convex set has the gradient W (A y - T) and the same Lipschitz constant.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, stored, unit_hash
from .sentencepiece_codec import small_batches
from .text_features import WORD_BUCKETS, WordBuckets, gathered_words, hashed_words, sampled, text_bytes

DOMAINS = ("good", "poor", "toxic")
#: Bound of the labelled sample that the classifier is fitted on.
LABELLED_ROWS = 4000


def domain_of(quality: Column, toxic: Column) -> Column:
    """The index in DOMAINS of a labelled document: toxic before poor before good; null where nothing is labelled."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality.isNotNull() | toxic.isNotNull(), 0)


@dataclass(frozen=True)
class SoftmaxModel:
    """weights (WORD_BUCKETS x domains) and biases over hashed words."""

    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, raw: bytes, buckets: WordBuckets) -> tuple[int, np.ndarray]:
        ids, x, n = hashed_words(raw, buckets)
        z = self.bias + (x @ self.weights[ids] if n else 0)
        e = np.exp(z - z.max())
        return n, e / e.sum()


def fit_softmax(domain: np.ndarray, x: np.ndarray, domains: int, steps: int = 120, rate: float = 0.3, decay: float = 1e-5) -> SoftmaxModel:
    """Softmax regression by full-batch Adam; domains without rows get a small prior mass only."""
    counts = np.bincount(domain, minlength=domains) + 0.5
    w, b = np.zeros((x.shape[1], domains), np.float32), np.log(counts / counts.sum()).astype(np.float32)
    if not len(domain):
        return SoftmaxModel(w, b)
    target = np.eye(domains, dtype=np.float32)[domain]
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        z = x @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        off = (e / e.sum(1, keepdims=True) - target) / len(domain)
        gw, gb = x.T @ off + decay * w, off.sum(0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return SoftmaxModel(w, b)


def train_domains(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> SoftmaxModel:
    """Fit on at most rows labelled documents of docs (doc_id, text); labels has doc_id, quality and toxic."""
    small_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).select("doc_id", domain_of(F.col("q"), F.col("t")).alias("g")).where("g is not null")
    chosen = F.broadcast(sampled(marked, "doc_id", rows, 41))  # at most rows ids
    domain, x = gathered_words(docs.select("doc_id", "text").join(chosen, "doc_id"), "g")
    return fit_softmax(domain, x, len(DOMAINS))


def with_posteriors(docs: DataFrame, model: SoftmaxModel, column: str = "membership") -> DataFrame:
    """docs with a struct of n_tokens (words) and p, the posteriors of the DOMAINS. Null and empty texts have no tokens and the prior's posteriors."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n_tokens: bigint, p: array<double>>")
    def membership(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, fitted = WordBuckets(), shared.value
        for raw in batches:
            found = [fitted.posterior(x.as_py(), buckets) for x in raw]
            tokens = pa.array([n for n, _ in found], pa.int64())
            p = pa.array([q.astype(np.float64) for _, q in found], pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([tokens, p], names=["n_tokens", "p"])

    return docs.withColumn(column, membership(text_bytes()))


@dataclass
class Fit:
    """The multipliers of all steps, scaled to the tokens' unit, and how far totals were from targets after each.
    keep: documents whose posterior of the first domain is at least this have rates of at least 1 (None: only r >= 0);
    most: no rate is above this."""

    unit: float
    keep: float | None = None
    most: float | None = None
    steps: list[tuple[list[float], float]] = field(default_factory=list)  # multipliers, and momentum after the step
    misses: list[float] = field(default_factory=list)

    def least(self, p: Column) -> Column:
        """The least rate that a document may have."""
        return F.lit(0.0) if self.keep is None else F.when(F.element_at(p, 1) >= self.keep, 1.0).otherwise(0.0)

    def state(self, n_tokens: Column, p: Column, since: int = 0, start: Column | None = None) -> Column:
        """A document's rate r and where its next step begins (y), by the steps since the one at which they were start."""
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")) if start is None else start
        if len(self.steps) == since:
            return start
        a = F.transform(p, lambda q: q * n_tokens.cast("double") / F.lit(self.unit))
        history = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in m]).alias("m"), F.lit(b).alias("b")) for m, b in self.steps[since:]])

        def step(state: Column, h: Column) -> Column:
            moved = F.aggregate(F.zip_with(a, h["m"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            r = F.greatest(self.least(p), state["y"] - moved)
            r = r if self.most is None else F.least(F.lit(self.most), r)
            return F.struct(r.alias("r"), (r + h["b"] * (r - state["r"])).alias("y"))

        return F.aggregate(history, start, step)

    def rate(self, n_tokens: Column, p: Column) -> Column:
        """The fitted rate of a document, from its own tokens and posteriors."""
        return self.state(n_tokens, p)["r"] if self.steps else F.lit(1.0)


def within_ceilings(totals: np.ndarray, gram: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The point with rules @ point <= 0 that is nearest to totals in the metric of gram's inverse: it lies on a face of those, which are few."""
    points = []
    for face in chain.from_iterable(combinations(range(len(rules)), n) for n in range(len(rules) + 1)):
        c = rules[list(face)]
        pull = np.linalg.pinv(c @ gram @ c.T) @ (c @ totals)
        point = totals - gram @ c.T @ pull
        points.append((float((rules @ point).max(initial=1e-9)), float(pull @ (c @ gram @ c.T) @ pull), point))
    return min(points, key=lambda x: x[:2])[2]


#: So many steps are replayed for a document in each sum; earlier ones are kept as its state in a stored table.
REPLAYED = 32


def fit_rates(memberships: DataFrame, shares: dict[str, float], budget: float = 1.0, most_steps: int = 100, patience: int = 16, tolerance: float = 1e-3, keep: float | None = None, most: float | None = None, ceilings: tuple[str, ...] = ()) -> Fit:
    """Fit rates to memberships (n_tokens, p).

    shares: the share of all expected tokens that each domain is to have, summing to 1; budget: expected
    tokens as a multiple of those there are. Ends when each domain's total is within tolerance of its
    target, relative to the budget, which misses[-1] tells. keep projects onto rates of at least 1 for documents
    of the first domain instead of 0, so targets below what they hold are not reached; most projects onto rates
    up to it. With ceilings, the shares of those domains are upper bounds of theirs, and the other domains and the budget
    are free; if all documents have the same posteriors, as without labels, no rates change a share, and all are 1.
    With most, a target that the bounds put out of reach is told by a warning, once the miss is proven to be within tolerance of
    the least that any rates reach; there is no limit of steps. Without most, where the nearest may need rates without bound, the fit also ends when
    patience steps brought the largest miss no nearer, or after most_steps, and then warns.
    An empty table or one without tokens: all rates 1.
    """
    k = len(DOMAINS)
    if abs(sum(shares.get(d, 0.0) for d in DOMAINS) - 1) > 1e-9 or set(shares) - set(DOMAINS):
        raise ValueError(f"shares of {DOMAINS} that sum to 1 are needed")
    rows, start, since = memberships.select("n_tokens", "p"), None, 0
    n, p = F.col("n_tokens").cast("double"), [F.element_at("p", i + 1) for i in range(k)]
    grams = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("rows"), *[F.sum(n * q).alias(f"t{i}") for i, q in enumerate(p)], *[F.sum(n * n * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in grams]).first()
    if not row["n"]:
        return Fit(1.0)
    total = float(row["n"])
    fitted = Fit(unit=total, keep=keep, most=most)
    gram = np.zeros((k, k))
    for i, j in grams:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] / total**2
    metric = np.linalg.pinv(gram, rcond=1e-10)
    goal = np.array([shares.get(d, 0.0) for d in DOMAINS])
    rules = np.array([np.eye(k)[i] - goal[i] for i, d in enumerate(DOMAINS) if d in ceilings]).reshape(-1, k)

    def target(totals: np.ndarray) -> np.ndarray:
        return within_ceilings(totals, gram, rules) if ceilings else goal * budget

    now = np.array([row[f"t{i}"] for i in range(k)]) / total
    fixed = bool(ceilings) and np.linalg.matrix_rank(gram, tol=1e-12 * np.trace(gram)) < 2
    at, t, far = now, 1.0, []  # the totals of y, the momentum's sequence and half the squared distances
    while True:
        off = now - target(now)
        pull = metric @ off
        fitted.misses.append(float(np.abs(off).max()))
        far.append(float(off @ pull) / 2)
        if fitted.misses[-1] <= tolerance * budget or fixed:
            break
        if most is None and (len(fitted.steps) >= most_steps or len(fitted.misses) > patience and min(fitted.misses[-patience:]) > 0.99 * min(fitted.misses[:-patience])):
            break
        if len(far) > 1 and far[-1] > far[-2]:
            t = 1.0  # the momentum overshot
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = float((t - 1) / after)
        if len(fitted.steps) - since == REPLAYED:
            before, rows = rows, stored(rows.select("n_tokens", "p", fitted.state(F.col("n_tokens"), F.col("p"), since, start).alias("state")), "rates")
            start, since = F.col("state"), len(fitted.steps)
            if since > REPLAYED:
                drop_stored(before)
        fitted.steps.append(((metric @ (at - target(at))).tolist(), momentum))
        # no rates within the bounds lower the pull's product with the totals beyond this sum
        slope = sum(F.lit(float(v)) * n * q / F.lit(total) for v, q in zip(pull, p, strict=True))
        floor = F.sum(F.least(fitted.least(F.col("p")) * slope, F.lit(most) * slope)) if most is not None else F.lit(None)
        sums = rows.withColumn("__r", fitted.state(F.col("n_tokens"), F.col("p"), since, start)["r"]).agg(*[F.sum(F.col("__r") * n * q).alias(f"t{i}") for i, q in enumerate(p)], floor.alias("floor")).first()
        # the half squared distance is above its least by the difference at most, and the miss, in the metric, from the least's by the root of twice that
        if most is not None and np.sqrt(2 * max(0.0, float(pull @ now) - sums["floor"]) * gram.max()) <= tolerance * budget:
            fitted.steps.pop()
            break
        before, now, t = now, np.array([sums[f"t{i}"] for i in range(k)]) / total, after
        at = now + momentum * (now - before)
    if since:
        drop_stored(rows)
    if fitted.misses[-1] > tolerance * budget:
        warnings.warn(f"the rates miss a target by {fitted.misses[-1]:.4f} of all tokens after {len(fitted.steps)} steps", stacklevel=2)
    return fitted


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], budget: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, posterior of each domain and rate for every row of docs (repeated rows each)."""
    model = train_domains(docs, labels)
    rows = stored(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "membership.n_tokens", "membership.p"), "memberships")
    fitted = fit_rates(rows, shares, budget)
    return rows.select("doc_id", "n_tokens", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], fitted.rate(F.col("n_tokens"), F.col("p")).alias("rate"))


def resample(docs: DataFrame, labels: DataFrame, shares: dict[str, float], budget: float = 1.0, keep: float | None = 0.5, most: float | None = 1.0, ceilings: tuple[str, ...] = DOMAINS[1:], seed: int = 4) -> DataFrame:
    """Rows of docs, with their columns, each as often as its rate: the whole part, and once more by a keyed draw against the rest.

    By default no row repeats, documents that are likely good stay, and the other domains' shares are upper bounds.
    """
    names = docs.columns
    model = train_domains(docs, labels)
    rows = stored(with_posteriors(docs.select("doc_id", "text"), model).select("membership.n_tokens", "membership.p"), "memberships")
    fitted = fit_rates(rows, shares, budget, keep=keep, most=most, ceilings=ceilings)
    drop_stored(rows)
    membership, copies_of, copy = (fresh(docs, c) for c in ("membership", "copies", "copy"))
    marked = with_posteriors(docs, model, membership)
    rate = fitted.rate(F.col(f"{membership}.n_tokens"), F.col(f"{membership}.p"))
    draw = unit_hash(F.lit(seed), F.col("doc_id"), F.crc32(text_bytes()))
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")
    marked = marked.withColumn(copies_of, copies).where(F.col(copies_of) > 0)
    return marked.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies_of)))).select(*[f"`{c}`" for c in names])
