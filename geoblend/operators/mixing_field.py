"""Correlated outputs: the sources' own fields as mixtures of shared latent fields.

value = slope * prior + intercept + sum_q W[source, q] g_q(x) + noise, with latent fields g_q of one kernel, so two sources'
fields have covariance (W W')[a, b] k(x, x'). Everything follows from field.source_sums(), one M x M block for each source from
one pass; the stacked posterior of all latent fields and the mixing matrix are small solves on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Source
from .field import Field, Posterior, cholesky, predict, solve_spd

Parts = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def residual_moments(rows: DataFrame, at: list[str], sources: list[str]) -> DataFrame:
    """source_a, source_b, n, covariance, correlation of the residuals (value less prior) of each pair of sources over the
    places `at` that have both, from one grouping of rows(at, source, value, prior). A source's rows at a place are averaged;
    rows with a null take no part; a pair that never meets has n 0 and nulls. One row per pair, each source with itself too."""
    r = F.col("value") - F.col("prior")
    wide = rows.groupBy(*at).agg(*[F.avg(F.when(F.col("source") == s, r)).alias(f"_r{i}") for i, s in enumerate(sources)])
    pairs = [(i, j) for i in range(len(sources)) for j in range(i, len(sources))]
    sums = []
    for i, j in pairs:
        a, b = F.col(f"_r{i}"), F.col(f"_r{j}")
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        sums += [F.count(a).alias(f"n{i}_{j}"), F.covar_pop(a, b).alias(f"c{i}_{j}"), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"k{i}_{j}")]
    one = wide.agg(*sums)
    table = [F.struct(F.lit(sources[i]).alias("source_a"), F.lit(sources[j]).alias("source_b"), F.col(f"n{i}_{j}").alias("n"), F.col(f"c{i}_{j}").alias("covariance"), F.col(f"k{i}_{j}").alias("correlation")) for i, j in pairs]
    return one.select(F.inline(F.array(*table)))


@dataclass(frozen=True)
class Mixture:
    """Weights (sources x latent fields) with the sources' slopes on the prior, intercepts and noises."""

    field: Field
    sources: tuple[Source, ...]
    weights: np.ndarray

    def covariance(self) -> np.ndarray:
        """Covariance of the sources' fields at one place."""
        return self.weights @ self.weights.T * self.field.variance


@dataclass(frozen=True)
class Latent:
    """Posterior weights of the latent fields: mean (Q, M), covariance (Q, M, Q, M)."""

    mixture: Mixture
    mean: np.ndarray
    cov: np.ndarray

    def of(self, name: str) -> Posterior:
        """The posterior of one source's field, for predict(), joint_draws() and the rest; its baseline stays with the caller."""
        m = self.mixture
        w = m.weights[[s.name for s in m.sources].index(name)]
        size = max(float(w @ w), 1e-12)
        own = replace(m.field, variance=m.field.variance * size, jitter=m.field.jitter * size)
        k = m.field.gram() + m.field.jitter * np.eye(len(m.field.points))
        spread = np.einsum("p,piqj,q->ij", w, self.cov, w, optimize=True)
        return Posterior(own, w @ self.mean / size, (size * solve_spd(k, np.eye(len(k))) - spread) / size**2)


def start_mixture(f: Field, sources: list[Source], moments: list[tuple[str, str, float | None]], latent: int | None = None) -> Mixture:
    """A mixing matrix from the residual covariances (source_a, source_b, covariance): noise is taken off the diagonal (a tenth
    of it stays at least), missing pairs count as uncorrelated, and the largest `latent` eigenvectors (default all) stay."""
    names = [s.name for s in sources]
    b = np.zeros((len(names),) * 2)
    for x, y, c in moments:
        if x in names and y in names and c is not None:
            b[names.index(x), names.index(y)] = b[names.index(y), names.index(x)] = c
    for i, s in enumerate(sources):
        b[i, i] = max(b[i, i] - s.noise**2, 0.1 * b[i, i]) or s.noise**2
    values, vectors = np.linalg.eigh(b)
    keep = np.argsort(values)[::-1][: latent or len(names)]
    return Mixture(f, tuple(sources), vectors[:, keep] * np.sqrt(np.maximum(values[keep], 1e-6 * max(values.max(), 1e-12)) / f.variance))


def _system(parts: Parts, m: Mixture, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Precision and right side of the stacked weights of all latent fields."""
    q = m.weights.shape[1]
    left, right = np.kron(np.eye(q), k), np.zeros(q * len(k))
    for s, w in zip(m.sources, m.weights):
        if s.name in parts:
            a, b, _ = parts[s.name]
            left += np.kron(np.outer(w, w) / s.noise**2, a)
            right += np.kron(w / s.noise**2, b @ [1.0, -s.slope, -s.intercept])
    return left, right


def latent_posterior(parts: Parts, m: Mixture) -> Latent:
    n, q = len(m.field.points), m.weights.shape[1]
    left, right = _system(parts, m, m.field.gram() + m.field.jitter * np.eye(n))
    cov = solve_spd(left, np.eye(q * n))
    return Latent(m, (cov @ right).reshape(q, n), ((cov + cov.T) / 2).reshape(q, n, q, n))


def mixture_evidence(parts: Parts, m: Mixture) -> float:
    """Collapsed lower bound of the log marginal likelihood of all sources' rows."""
    k = m.field.gram() + m.field.jitter * np.eye(len(m.field.points))
    left, right = _system(parts, m, k)
    log_det = lambda c: 2 * np.log(np.diag(cholesky(c, 1e-10))).sum()
    out = log_det(left) - m.weights.shape[1] * log_det(k) - right @ solve_spd(left, right)
    for s, w in zip(m.sources, m.weights):
        if s.name in parts:
            a, _, z = parts[s.name]
            c, n = np.array([1.0, -s.slope, -s.intercept]), z[2, 2]
            out += n * np.log(2 * np.pi * s.noise**2) + (c @ z @ c + w @ w * (n * m.field.variance - np.trace(solve_spd(k, a)))) / s.noise**2
    return float(-0.5 * out)


def learned_mixture(parts: Parts, m: Mixture, rounds: int = 50, keep: tuple[str, ...] = (), least_noise: float = 1e-3, tolerance: float = 1e-8) -> tuple[Mixture, list[float]]:
    """Mixing weights, slopes, intercepts and noises by expectation maximisation on the sums of field.source_sums(), and the
    evidence before each round and at the end, which never falls. A round takes the latent fields' posterior, then for each
    source the least squares of its values on (prior, 1, latent fields) in expectation. Sources in `keep` keep slope and
    intercept (a sparse source's line on the prior is poorly known away from its rows); one without rows stays as it is. Rounds
    end where the evidence gains less than the tolerance's share of it. Where values do not depend on place weights go to 0."""
    history, n = [mixture_evidence(parts, m)], len(m.field.points)
    k_inv = solve_spd(m.field.gram() + m.field.jitter * np.eye(n), np.eye(n))
    for _ in range(rounds):
        post = latent_posterior(parts, m)
        moments = np.einsum("pi,qj->piqj", post.mean, post.mean) + post.cov
        sources, weights = [], []
        for s, w in zip(m.sources, m.weights):
            if s.name in parts:
                a, b, z = parts[s.name]
                inner = np.einsum("ij,piqj->pq", a, moments) + np.eye(len(w)) * (z[2, 2] * m.field.variance - np.sum(k_inv * a))
                cross = post.mean @ b  # latent fields times value, prior, 1
                square = np.block([[z[1:, 1:], cross[:, 1:].T], [cross[:, 1:], inner]])
                right = np.concatenate([z[1:, 0], cross[:, 0]])
                fixed = np.array([s.slope, s.intercept])
                if s.name in keep:
                    best = np.concatenate([fixed, np.linalg.lstsq(inner, right[2:] - square[2:, :2] @ fixed, rcond=1e-12)[0]])
                else:
                    best = np.linalg.lstsq(square, right, rcond=1e-12)[0]
                rest = (z[0, 0] - 2 * best @ right + best @ square @ best) / z[2, 2]
                s, w = replace(s, slope=float(best[0]), intercept=float(best[1]), noise=float(max(np.sqrt(max(rest, 0.0)), least_noise))), best[2:]
            sources.append(s)
            weights.append(w)
        m = replace(m, sources=tuple(sources), weights=np.array(weights))
        history.append(mixture_evidence(parts, m))
        if history[-1] - history[-2] <= tolerance * abs(history[-1]):
            break
    return m, history


def without(parts: Parts, taken: Parts) -> Parts:
    """The sums less those of rows taken out, by source; a source left without rows goes."""
    out = {s: tuple(x - y for x, y in zip(p, taken[s])) if s in taken else p for s, p in parts.items()}
    return {s: p for s, p in out.items() if p[2][2, 2] > 0.5}


def predict_outputs(rows: DataFrame, outputs: dict[str, tuple[Latent, str]], key: str, noise: bool = True) -> DataFrame:
    """Adds mean and std at rows(x, y, t, covariates, prior): outputs names the posterior and the source for each value of the
    key. noise adds the source's own. Rows of other keys and rows with a null coordinate get nulls, without a prior no mean."""
    table = []
    for k, (post, name) in outputs.items():
        s = next(s for s in post.mixture.sources if s.name == name)
        table.append((k, s.slope, s.intercept, s.noise if noise else 0.0))
    extra = rows.sparkSession.createDataFrame(table, "_key string, _slope double, _intercept double, _noise double")
    found = predict(rows, {k: post.of(name) for k, (post, name) in outputs.items()}, key=key)
    met = found.join(F.broadcast(extra), F.col(key).cast("string") == F.col("_key"), "left")  # one row a key
    mean = F.col("mean") + (F.coalesce("_slope", F.lit(1.0)) - 1) * F.col("prior") + F.coalesce("_intercept", F.lit(0.0))
    return met.withColumns({"mean": mean, "std": F.sqrt(F.col("std") ** 2 + F.coalesce("_noise", F.lit(0.0)) ** 2)}).drop("_key", "_slope", "_intercept", "_noise")
