"""Mixing reasons to target weights when a record belongs softly to several domains.

A classifier learned from a labelled table gives each record a probability for each domain. Rates are nonnegative numbers of
times to use each record such that the expected tokens of each domain are the target shares of all tokens, as near to using
every record once as that allows. They are found by projected gradient steps of least squares over all records.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows
from fraudloom.llm.features import common_only, contained
from fraudloom.llm.ordinal import labelled_bags
from fraudloom.session import materialize


@dataclass
class DomainModel:
    weights: np.ndarray  # buckets x domains

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weights[contained(t, len(self.weights))].sum(axis=0) for t in texts])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[np.ndarray], classes: np.ndarray, prior: np.ndarray, buckets: int, epochs: int = 6, rate: float = 0.1) -> DomainModel:
    """Softmax regression with per-weight step sizes on a sample that may be dealt unevenly; ``prior`` restores the classes' shares."""
    bags = common_only(bags, buckets)
    rng = np.random.default_rng(5)
    k = len(prior)
    w, seen = np.zeros((buckets, k)), np.full(buckets, 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at = bags[i]
            z = w[at].sum(axis=0)
            p = np.exp(z - z.max())
            g = -p / p.sum()
            g[classes[i]] += 1
            seen[at] += (g * g).sum()
            w[at] += rate * g / np.sqrt(seen[at])[:, None]
    drawn = np.bincount(classes, minlength=k)
    w[0] += np.log(np.maximum(prior, 1e-9)) - np.log(np.maximum(drawn / max(1, drawn.sum()), 1e-9))
    return DomainModel(w.astype(np.float32))


def domain_posteriors(records: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = 2500, buckets: int = 1 << 18) -> DataFrame:
    """Add ``posterior`` (array, in the order of ``domains``) and ``n_tokens`` (words between whitespace) to records."""
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    known = labelled.filter(F.col("domain").isin(domains)).select("event_id", index.cast("int").alias("k"))
    shares = {r["k"]: r["n"] for r in known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as domains
    names = {"posterior": T.ArrayType(T.DoubleType()), "n_tokens": T.LongType()}
    count = lambda texts: [len((t or "").encode(errors="replace").split()) for t in texts]
    bags, classes = labelled_bags(records, known, "k", per_domain, list(range(len(domains))), buckets)
    if not bags:
        return map_rows(records, ["reason"], names, lambda texts: ([[1 / len(domains)] * len(domains)] * len(texts), count(texts)))
    prior = np.array([shares.get(k, 0) for k in range(len(domains))], float)
    here = records.sparkSession.sparkContext.broadcast(fit(bags, classes, prior / prior.sum(), buckets))  # buckets x domains floats
    return map_rows(records, ["reason"], names, lambda texts: (here.value.posteriors(texts).tolist(), count(texts)))


def _rates(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given steps: each moves along the gradient and is cut at zero."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0.0, rate - posterior @ step)
    return rate


def fit_rates(soft: DataFrame, targets: np.ndarray, rounds: int = 40, tolerance: float = 1e-4) -> list[np.ndarray]:
    """Gradient steps (one short vector each) that give every record its rate.

    The residual is the expected share of tokens of each domain less its target, whitened by the token-weighted second moments
    of the posteriors; in the records' token-weighted metric the gradient of half its square is the posterior times the whitened residual and
    its Lipschitz constant is one, so the step length is one. A record's rate follows from its posterior and
    the steps so far: a round is one pass that sums a few numbers, and no state is kept between rounds.
    """
    k = len(targets)

    def summed(steps: list[np.ndarray]):
        def part(batches):
            total, moments = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                p = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
                if len(n):
                    total += (n * _rates(p, steps)) @ p
                    moments += (p * n[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([total, moments.reshape(-1)]))], ["i", "v"])
        got = soft.select("posterior", "n_tokens").mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k + k * k)
        for r in got:
            out[r["i"]] = r["v"]
        return out[:k], out[k:].reshape(k, k)

    steps: list[np.ndarray] = []
    for _ in range(rounds):
        total, moments = summed(steps)
        tokens = moments.sum()  # posteriors sum to one
        if tokens <= 0:
            return steps
        residual = total / tokens - targets
        if np.abs(residual).max() <= tolerance:
            return steps
        steps.append(np.linalg.solve(moments / tokens + 1e-9 * np.eye(k), residual))
    return steps


def mix_sources(records: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = 2500) -> DataFrame:
    """Rate of every record so that expected domain tokens match ``targets``.

    ``records``: ``event_id``, ``reason`` and whatever else passes through; ``labelled``: ``event_id``, ``domain`` for some of them;
    ``targets``: share of tokens by domain, scaled to sum to one. Adds ``n_tokens``, ``posterior`` and ``rate``, the expected number of
    times to use the record (0 leaves it out). Targets outside what nonnegative rates can reach are met as nearly as least squares allow.

    Learning takes at most ``per_domain`` labels of each domain, and of these the ones whose record is there; labels with a null or unlisted domain or an unknown id
    are ignored, and a record labelled twice counts for each label. Without labels all posteriors are equal and every rate stays one
    unless the targets are uneven, which then cannot be met. Null and empty texts have no tokens and rate as their posterior says; repeated
    rows are rated alike; an empty table gives an empty result. Input columns with the result's names are replaced.
    """
    domains = sorted(targets)
    goal = np.array([targets[d] for d in domains], float)
    goal /= goal.sum()
    extra = [c for c in records.columns if c.lower() not in ("posterior", "n_tokens", "rate")]
    soft = materialize(domain_posteriors(records.select(*extra), labelled, domains, per_domain), "domain-posteriors")
    steps = fit_rates(soft, goal)
    return map_rows(soft, ["posterior"], {"rate": T.DoubleType()}, lambda p: [_rates(np.array(p, float).reshape(-1, len(domains)), steps)])
