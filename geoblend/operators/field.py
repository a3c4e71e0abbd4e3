"""Sparse Gaussian-process field from distributed sufficient statistics.

For Gaussian sources with linear links, the optimal inducing posterior needs only A = sum k k' a^2 / s^2 and
b = sum k a (y - c - a prior) / s^2 over rows, with k the kernel between a row and M inducing points. Tasks add their rows
into one M x M block per key; blocks are summed in two grouped steps, and the M x M solves run on the driver. Keys are
sources, days, stations or parameter candidates, so one pass serves them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import global_rank, hash_unit
from ..functions.scalars import interval
from ..functions.threads import use_one_thread
from ..sources.tables import Source, dealt, path_exists, written

use_one_thread()

try:
    from _md5 import md5  # of short texts over twice as fast as hashlib's, which sets up a context of OpenSSL for each
except ImportError:
    from hashlib import md5


def _matern32(d: np.ndarray) -> np.ndarray:
    s = np.sqrt(3) * d
    e = np.exp(-s)
    s += 1
    s *= e
    return s


CORRELATION = {
    "matern12": lambda d: np.exp(-d),
    "matern32": _matern32,
    "matern52": lambda d: (1 + np.sqrt(5) * d + 5 / 3 * d * d) * np.exp(-np.sqrt(5) * d),
    "rbf": lambda d: np.exp(-0.5 * d * d),
}
COORDS = ("x", "y", "t")
#: Rows that meet the inducing points at once in sums and predictions.
ROWS = 1_000
#: Rows of a step of the information sums: the factors of many fields' kernels stay in a core's cache.
SUM_ROWS = 250
#: Pairs of a step of Field.product().
PRODUCT_PAIRS = 50_000


@dataclass(frozen=True)
class Field:
    """Kernel parameters and inducing points (M, 3 + covariates) in scaled coordinates. The kernel is a product over place,
    time and covariates; space is one length scale or one for each axis, each covariate has a length scale of its own."""

    points: np.ndarray
    space: float | tuple[float, float] = 0.3
    time: float = 0.3
    variance: float = 1.0
    kernel: str = "matern32"
    time_kernel: str = "matern12"
    jitter: float = 1e-6
    covariates: tuple[str, ...] = ()
    lengths: tuple[float, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*COORDS, *self.covariates]

    def cov(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        scaled = lambda i, length: (a[:, None, i] - b[None, :, i]) / length
        along, across = np.broadcast_to(self.space, 2)
        k = self.variance * CORRELATION[self.kernel](np.hypot(scaled(0, along), scaled(1, across)))
        if len({*a[:, 2], *b[:, 2]}) > 1:  # at one time the factor is 1
            k = k * CORRELATION[self.time_kernel](np.abs(scaled(2, self.time)))
        if self.covariates:
            k = k * CORRELATION["rbf"](np.sqrt(sum(scaled(3 + i, length) ** 2 for i, length in enumerate(self.lengths))))
        return k

    def product(self, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        """cov(a, b) @ v for places and times alone, in steps of few rows of a, whose arrays stay in a core's cache."""
        along, across = np.broadcast_to(self.space, 2)
        (ax, ay), (bx, by) = ((x[:, 0] / along, x[:, 1] / across) for x in (a, b))
        times, out, step = len({*a[:, 2], *b[:, 2]}) > 1, np.empty(len(a)), max(1, PRODUCT_PAIRS // max(len(b), 1))
        d, e = np.empty((2, step, len(b)))
        for i in range(0, len(a), step):
            own = slice(i, i + step)
            x, y = d[: len(ax[own])], e[: len(ax[own])]
            np.subtract(ax[own, None], bx, out=x)
            np.subtract(ay[own, None], by, out=y)
            np.sqrt(np.add(np.multiply(x, x, out=x), np.multiply(y, y, out=y), out=x), out=x)
            k = CORRELATION[self.kernel](x)
            if times:
                k *= CORRELATION[self.time_kernel](np.abs(a[own, None, 2] - b[:, 2]) / self.time)
            out[own] = k @ v
        return self.variance * out

    def factors(self) -> list[tuple]:
        """What tells the kernel's factors apart, but for the variance: place, time and each covariate with its length scales."""
        along, across = np.broadcast_to(self.space, 2)
        own = [(0, "place", self.kernel, float(along), float(across)), (2, "time", self.time_kernel, self.time)]
        return own + [(3 + i, c, "rbf", length) for i, (c, length) in enumerate(zip(self.covariates, self.lengths))]

    def correlations(self, a: np.ndarray, known: dict[tuple, np.ndarray]) -> np.ndarray:
        """cov(a, points) for variance 1. Factors and their products are kept in `known` for fields with the same points; places,
        times and values that follow each other in a, or times that occur often, are computed once."""
        done: tuple = ()
        for factor in self.factors():
            at, before = factor[0], done
            done = (*done, factor)
            if done in known:
                continue
            if factor not in known:
                if ("places", at) not in known:
                    x = a[:, :2] if at == 0 else a[:, at : at + 1]
                    new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)] if at != 2 else None
                    first, where = (np.flatnonzero(new), np.cumsum(new) - 1) if at != 2 else np.unique(x[:, 0], return_index=True, return_inverse=True)[1:]
                    known["places", at] = x[first], where
                x, where = known["places", at]
                if at == 0:
                    d = np.hypot((x[:, :1] - self.points[:, 0]) / factor[3], (x[:, 1:] - self.points[:, 1]) / factor[4])
                else:
                    d = np.abs(x - self.points[:, at]) / factor[3]
                k = CORRELATION[factor[2]](d)
                known[factor] = k if len(x) == len(a) and at != 2 else k[where]
            known[done] = known[before] * known[factor] if before else known[factor]
        return known[done]

    def scales(self) -> dict[str, float]:
        """Length scales by coordinate and covariate, and the variance."""
        along, across = np.broadcast_to(self.space, 2)
        return {"x": float(along), "y": float(across), "t": self.time, **dict(zip(self.covariates, self.lengths)), "variance": self.variance}

    def with_scales(self, p: dict[str, float]) -> Field:
        return replace(self, space=(p["x"], p["y"]), time=p["t"], lengths=tuple(p[c] for c in self.covariates), variance=p["variance"])

    def gram(self) -> np.ndarray:
        return self.cov(self.points, self.points)


@dataclass(frozen=True)
class Sums:
    """A, b, quadratic and log-noise sums of one key."""

    a: np.ndarray
    b: np.ndarray
    n: int = 0
    square: float = 0.0
    log_noise: float = 0.0
    precision: float = 0.0

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.a + o.a, self.b + o.b, self.n + o.n, self.square + o.square, self.log_noise + o.log_noise, self.precision + o.precision)

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.a - o.a, self.b - o.b, self.n - o.n, self.square - o.square, self.log_noise - o.log_noise, self.precision - o.precision)


def cholesky(m: np.ndarray, jitter: float = 1e-6) -> np.ndarray:
    """Cholesky factor with growing jitter."""
    for _ in range(5):
        try:
            return np.linalg.cholesky(m + jitter * np.eye(len(m)))
        except np.linalg.LinAlgError:
            jitter *= 10
    raise np.linalg.LinAlgError("not positive definite")


def solve_spd(m: np.ndarray, b: np.ndarray, jitter: float = 1e-10) -> np.ndarray:
    c = cholesky(m, jitter)
    return np.linalg.solve(c.T, np.linalg.solve(c, b))


BLOCK = "key string, a binary, b binary, n long, square double, log_noise double, precision double"


def _add_blocks(pdf: pd.DataFrame) -> tuple:
    total = lambda c: np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes()
    return total("a"), total("b"), int(pdf["n"].sum()), *(float(pdf[c].sum()) for c in ("square", "log_noise", "precision"))


def information_sums(rows: DataFrame, fields: Field | dict[str, Field], key: str | None = None, parts: int = 16, most_keys: int = 256) -> dict[str, Sums]:
    """Sums by key of rows(x, y, t, the fields' covariates, value, prior, slope, intercept, noise[, key]). With several named
    fields, a key is 'name' or 'name|key'. Rows with a null are skipped. A task holds the blocks of at most `most_keys` keys.
    Fields that differ in the variance only share their sums; those with the same points share the kernel's equal factors."""
    named = fields if isinstance(fields, dict) else {"": fields}
    cols = [*dict.fromkeys(c for f in named.values() for c in f.columns), "value", "prior", "slope", "intercept", "noise"]
    df = rows.select(*[F.col(c).cast("double").alias(c) for c in cols], (F.col(key).cast("string") if key else F.lit("")).alias("key")).dropna()
    # By number: the fields of variance 1, and those of them that share points and columns.
    units: list[Field] = []
    unit_of = {}
    together: dict[tuple, list[int]] = {}
    for name, f in named.items():
        shape = f.points.tobytes(), tuple(f.columns), tuple(f.factors())
        if shape not in unit_of.values():
            together.setdefault(shape[:2], []).append(len(units))
            units.append(replace(f, variance=1.0))
        unit_of[name] = shape
    number = {shape: i for i, shape in enumerate(dict.fromkeys(unit_of.values()))}

    def blocks_of(acc: dict[str, Sums]) -> pd.DataFrame:
        rows = [(k, s.a.tobytes(), s.b.tobytes(), s.n, s.square, s.log_noise, s.precision) for k, s in acc.items()]
        return pd.DataFrame(rows, columns=["key", "a", "b", "n", "square", "log_noise", "precision"])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, Sums] = {}
        for pdf in batches:
            for k, g in ((k, whole.iloc[i : i + SUM_ROWS]) for k, whole in (pdf.groupby("key") if key else [("", pdf)]) for i in range(0, len(whole), SUM_ROWS)):
                w = g["slope"].to_numpy() / g["noise"].to_numpy()
                r = (g["value"].to_numpy() - g["intercept"].to_numpy()) / g["noise"].to_numpy() - w * g["prior"].to_numpy()
                scalars = len(g), float(r @ r), float(np.log(g["noise"].to_numpy() ** 2).sum()), float(w @ w)
                for (_, columns), own in together.items():
                    x, known = g[list(columns)].to_numpy(), {}
                    for i in own:
                        kx = units[i].correlations(x, known) * w[:, None]
                        one, tag = Sums(kx.T @ kx, kx.T @ r, *scalars), f"{i}|{k}"
                        acc[tag] = acc[tag] + one if tag in acc else one
                        if len(acc) >= most_keys:
                            yield blocks_of(acc)
                            acc = {}
        if acc:
            yield blocks_of(acc)

    def add(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(keys[0], *_add_blocks(pdf))], columns=["key", "a", "b", "n", "square", "log_noise", "precision"])

    blocks = df.mapInPandas(local, BLOCK).withColumn("part", (F.spark_partition_id() % parts).cast("int"))
    summed = blocks.groupBy("key", "part").applyInPandas(add, BLOCK).groupBy("key").applyInPandas(add, BLOCK)
    found: dict[int, dict[str, Sums]] = {}
    for r in summed.collect():  # one M x M block per key
        i, k = r["key"].split("|", 1)
        b = np.frombuffer(r["b"])
        found.setdefault(int(i), {})[k] = Sums(np.frombuffer(r["a"]).reshape(len(b), len(b)), b, r["n"], r["square"], r["log_noise"], r["precision"])
    out = {}
    for name, f in named.items():
        for k, s in found.get(number[unit_of[name]], {}).items():
            v = f.variance
            out[f"{name}|{k}" if name and key else name or k] = Sums(s.a * v**2, s.b * v, s.n, s.square, s.log_noise, s.precision * v)
    return out


@dataclass(frozen=True)
class Posterior:
    """Weights alpha and variance correction C: mean k alpha, variance k(x, x) - k C k'."""

    field: Field
    alpha: np.ndarray
    correction: np.ndarray

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) > ROWS:  # a step's arrays are ROWS x M whatever a batch holds
            parts = [self.at(x[i : i + ROWS]) for i in range(0, len(x), ROWS)]
            return np.concatenate([m for m, _ in parts]), np.concatenate([v for _, v in parts])
        k = self.field.cov(x, self.field.points)
        return k @ self.alpha, np.maximum(self.field.variance - np.einsum("ij,jk,ik->i", k, self.correction, k, optimize=True), 1e-12)


def fit(sums: Sums, f: Field) -> Posterior:
    k = f.gram()
    k = k + f.jitter * np.eye(len(k))
    m = k + sums.a
    eye = np.eye(len(k))
    return Posterior(f, solve_spd(m, sums.b), solve_spd(k, eye) - solve_spd(m, eye))


def evidence(sums: Sums, f: Field) -> float:
    """Collapsed lower bound of the log marginal likelihood."""
    k = f.gram()
    k = k + f.jitter * np.eye(len(k))
    m = k + sums.a
    log_det = lambda c: 2 * np.log(np.diag(cholesky(c, 1e-10))).sum()
    fit_term = sums.square - sums.b @ solve_spd(m, sums.b)
    trace = sums.precision - np.trace(solve_spd(k, sums.a))
    return float(-0.5 * (sums.n * np.log(2 * np.pi) + sums.log_noise + log_det(m) - log_det(k) + fit_term + trace))


def select_field(rows: DataFrame, candidates: dict[str, Field]) -> tuple[str, dict[str, float]]:
    """The candidate of most evidence, and the evidence of each, from one pass over the rows."""
    sums = information_sums(rows, candidates)
    scores = {n: evidence(sums[n], f) for n, f in candidates.items() if n in sums}
    return max(scores, key=scores.get), scores


def tuned_field(rows: DataFrame, f: Field, rounds: int = 6, factor: float = 3.0) -> tuple[Field, list[dict[str, float]]]:
    """The field with each coordinate's and covariate's length scale and the variance moved to more evidence, and what
    each round held. A round tries every parameter up and down by the factor, and all the last round's good moves at
    once, in one pass over the rows; without a better candidate the factor shrinks. Evidence never falls. What an earlier
    round has scored is not summed again."""
    now, joint, history, known = f.scales(), None, [], {}
    for _ in range(rounds):
        tries = {"now": now} | {f"{n} {way}": {**now, n: now[n] * factor**way} for n in now for way in (1, -1)} | ({"all": joint} if joint else {})
        new = {k: p for k, p in tries.items() if tuple(p.values()) not in known}
        found = select_field(rows, {k: f.with_scales(p) for k, p in new.items()})[1] if new else {}
        known |= {tuple(new[k].values()): v for k, v in found.items()}
        scores = {k: known[tuple(p.values())] for k, p in tries.items() if tuple(p.values()) in known}
        best = max(scores, key=scores.get)
        good = [k for k in scores if " " in k and scores[k] > scores["now"]]
        joint = dict(now)
        for k in sorted(good, key=scores.get):  # of a parameter's two ways the better one is last
            name = k.rsplit(" ", 1)[0]
            joint[name] = tries[k][name]
        now, joint = tries[best], joint if len(good) > 1 else None
        factor = factor if best != "now" else math.sqrt(factor)
        history.append({**now, "evidence": scores[best]})
    return f.with_scales(now), history


def with_source(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """Adds slope, intercept, noise of long rows' source; rows of unregistered sources go."""
    table = rows.sparkSession.createDataFrame([(s.name, s.slope, s.intercept, s.noise) for s in sources], "source string, slope double, intercept double, noise double")
    return rows.join(F.broadcast(table), "source")


SOURCE_BLOCK = "key string, a binary, b binary, m binary"


def source_sums(rows: DataFrame, f: Field, parts: int = 16) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By source, from one pass over rows(x, y, t, covariates, value, prior, source): sums of k k', of k times (value, prior,
    1), and of the products of (value, prior, 1) with each other. Any slope, intercept and noise follow from them."""
    df = rows.select(*[F.col(c).cast("double").alias(c) for c in (*f.columns, "value", "prior")], F.col("source").cast("string").alias("key")).dropna()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for key, g in pdf.groupby("key"):
                kx, z = f.cov(g[f.columns].to_numpy(), f.points), np.column_stack([g["value"], g["prior"], np.ones(len(g))])
                own = [kx.T @ kx, kx.T @ z, z.T @ z]
                acc[key] = [x + y for x, y in zip(acc[key], own)] if key in acc else own
        yield pd.DataFrame([(k, *(x.tobytes() for x in v)) for k, v in acc.items()], columns=["key", "a", "b", "m"])

    def add(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(keys[0], *(np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes() for c in ("a", "b", "m")))], columns=["key", "a", "b", "m"])

    blocks = df.mapInPandas(local, SOURCE_BLOCK).withColumn("part", (F.spark_partition_id() % parts).cast("int"))
    summed = blocks.groupBy("key", "part").applyInPandas(add, SOURCE_BLOCK).groupBy("key").applyInPandas(add, SOURCE_BLOCK)
    n = len(f.points)  # one block of a source reaches the driver
    return {r["key"]: (np.frombuffer(r["a"]).reshape(n, n), np.frombuffer(r["b"]).reshape(n, 3), np.frombuffer(r["m"]).reshape(3, 3)) for r in summed.collect()}


def sums_of(parts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], sources: list[Source], f: Field) -> Sums:
    """The information sums of all rows under the sources' slopes, intercepts and noises."""
    total = Sums(np.zeros((len(f.points),) * 2), np.zeros(len(f.points)))
    for s in sources:
        if s.name in parts:
            a, b, m = parts[s.name]
            w, c, n = 1 / s.noise**2, np.array([1.0, -s.slope, -s.intercept]), m[2, 2]
            total = total + Sums(a * s.slope**2 * w, b @ c * s.slope * w, int(n), float(c @ m @ c * w), float(-n * np.log(w)), float(n * s.slope**2 * w * f.variance))
    return total


def learned_sources(rows: DataFrame, f: Field, sources: list[Source], reference: str, rounds: int = 30, least_noise: float = 1e-3) -> tuple[list[Source], list[dict]]:
    """Slope, intercept and noise of each source by expectation maximisation, and what each round held. The reference keeps
    its slope and intercept. One pass over the rows gives the sums; each round takes the field's posterior under the
    present values and then the values of most expected likelihood, so the evidence never falls."""
    parts, history = source_sums(rows, f), []
    for i in range(rounds + 1):
        sums = sums_of(parts, sources, f)
        history += [{"round": i, "source": s.name, "slope": s.slope, "intercept": s.intercept, "noise": s.noise, "evidence": evidence(sums, f)} for s in sources]
        if i == rounds:
            break
        post, new = fit(sums, f), []
        for s in sources:
            if s.name not in parts:
                new.append(s)
                continue
            a, b, m = parts[s.name]
            n = m[2, 2]
            # Moments of z = prior + field under the posterior, with the value y.
            z, yz = m[1, 2] + post.alpha @ b[:, 2], m[0, 1] + post.alpha @ b[:, 0]
            zz = m[1, 1] + 2 * post.alpha @ b[:, 1] + post.alpha @ a @ post.alpha + n * f.variance - np.sum(post.correction * a)
            slope, intercept = s.slope, s.intercept
            if s.name != reference:
                spread = zz - z * z / n
                slope = max((yz - m[0, 2] * z / n) / spread, 1e-6) if spread > 0 else slope  # links rise
                intercept = (m[0, 2] - slope * z) / n
            square = m[0, 0] + slope**2 * zz + n * intercept**2 - 2 * slope * yz - 2 * intercept * m[0, 2] + 2 * slope * intercept * z
            new.append(replace(s, slope=float(slope), intercept=float(intercept), noise=float(max(np.sqrt(max(square / n, 0.0)), least_noise))))
        sources = new
    return sources, history


def predict(rows: DataFrame, posterior: Posterior | dict[str, Posterior], key: str | None = None, noise: float | None = None) -> DataFrame:
    """Adds mean (prior + field) and std at rows(x, y, t, covariates, prior); noise adds a source's variance. With several posteriors
    a row uses that of its key."""
    posts = posterior if isinstance(posterior, dict) else {"": posterior}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", mean double, std double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean, var = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            which = pdf[key].astype(str).to_numpy() if key else np.full(len(pdf), "")
            for k, p in posts.items():
                own = which == k
                if own.any():
                    mean[own], var[own] = p.at(pdf.loc[own, p.field.columns].to_numpy(dtype=float))
            std = np.sqrt(var + (noise or 0.0) ** 2)
            yield pdf.assign(mean=mean + pdf["prior"].to_numpy(dtype=float), std=std)

    return rows.mapInPandas(run, schema)


def exported(df: DataFrame, shift: float = 0.0, scale: float = 1.0, levels: tuple[float, ...] = (0.95,), mean: str = "mean", std: str = "std") -> DataFrame:
    """Predictions in the target's own units (mean * scale + shift, std * scale) with their central intervals."""
    out = df.withColumns({mean: F.col(mean) * scale + shift, std: F.col(std) * scale})
    return out.select("*", *interval(F.col(mean), F.col(std), levels))


def leave_key_out(rows: DataFrame, total: Sums, f: Field, key: str, noise: float | None = None) -> DataFrame:
    """Adds mean and std at rows(key, x, y, t, value, prior, slope, intercept, noise) from a field fitted without the rows
    of the same key. Tasks get whole keys in order and take the r rows of each out of the total by a downdate of rank r of
    the inverses computed once, the keys of one size together; only keys with more rows than inducing points subtract
    their sums and solve anew."""
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema) + ", mean double, std double"
    k = f.gram() + f.jitter * np.eye(len(f.points))
    k_inv, m_inv = (solve_spd(m, np.eye(len(k))) for m in (k, k + total.a))

    def keys_of(pdf: pd.DataFrame) -> np.ndarray:
        """Where the runs of equal keys begin, and the end."""
        codes = pd.factorize(pdf[key], use_na_sentinel=False)[0]
        return np.concatenate([np.flatnonzero(np.diff(codes, prepend=-1)), [len(pdf)]])

    def left_out(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[f.columns].to_numpy(dtype=float)
        a, s2 = pdf["slope"].to_numpy(), pdf["noise"].to_numpy() ** 2
        r = pdf["value"].to_numpy() - pdf["intercept"].to_numpy() - a * pdf["prior"].to_numpy()
        w, v = a * a / s2, a * r / s2
        mean, var = np.empty(len(pdf)), np.empty(len(pdf))
        starts = keys_of(pdf)
        sizes = np.diff(starts)
        for i in np.flatnonzero(sizes > len(f.points)):
            own = slice(starts[i], starts[i + 1])
            kx = f.cov(x[own], f.points)
            mean[own], var[own] = fit(total - Sums(kx.T @ (kx * w[own, None]), kx.T @ v[own]), f).at(x[own])
        for n in np.unique(sizes[sizes <= len(f.points)]):
            all_of = starts[:-1][sizes == n]
            for at in range(0, len(all_of), max(1, ROWS // n)):
                own = all_of[at : at + max(1, ROWS // n), None] + np.arange(n)
                kx = f.cov(x[own.ravel()], f.points)
                g = kx @ m_inv
                # What the others leave of g' kx and of the mean: s (1 - w s)^-1 w is the downdate.
                s, gb = g.reshape(*own.shape, -1) @ kx.reshape(*own.shape, -1).transpose(0, 2, 1), (g @ total.b).reshape(own.shape)
                ws, wb = w[own][:, :, None] * s, (w[own] * gb)[:, :, None]
                q = np.linalg.solve(np.eye(n) - ws, np.concatenate([ws, wb], axis=2))
                t = s + s @ q[:, :, :-1]
                mean[own] = gb + (s @ q[:, :, -1:])[:, :, 0] - (t @ v[own][:, :, None])[:, :, 0]
                var[own] = np.maximum(f.variance - np.einsum("ij,ij->i", kx @ k_inv, kx).reshape(own.shape) + np.diagonal(t, axis1=1, axis2=2), 1e-12)
        return pdf.assign(mean=mean + pdf["prior"].to_numpy(dtype=float), std=np.sqrt(var + (noise or 0.0) ** 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last key so far, which may go on in the next batch
        for pdf in (b for b in batches if len(b)):
            last = keys_of(pdf)[-2]
            if last == 0 and held:
                both = pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]], ignore_index=True)
                if len(keys_of(both)) == 2:
                    held.append(pdf)
                    continue
            done = [*held, pdf.iloc[:last]]
            held = [pdf.iloc[last:]]
            if sum(map(len, done)):
                yield left_out(pd.concat(done, ignore_index=True))
        if held:
            yield left_out(pd.concat(held, ignore_index=True))

    return dealt(rows, key).sortWithinPartitions(key).mapInPandas(run, schema)


def samples(df: DataFrame, keys: list[str], n: int = 64, seed: int = 1, name: str = "samples") -> DataFrame:
    """Marginal posterior draws per row, an array of n normals from hashes (reproducible): hash_unit() of the keys, a tag with
    the draw's index and the seed. Tasks take the digests batch by batch."""
    tails = [("|" * bool(keys) + f"{tag}{i}|{seed}").encode() for tag in "ab" for i in range(1, n + 1)]
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary")
    given = df.withColumns({"_text": text, "_mean": F.col("mean").cast("double"), "_std": F.col("std").cast("double")})
    step, names = max(1, 200_000 // n), [*(c for c in df.columns if c != name), name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                digests = b"".join([md5(x + tail).digest()[:4] for x in batch.column("_text").to_pylist() for tail in tails])
                u = np.frombuffer(digests, dtype=">u4").reshape(-1, 2 * n) / 2.0**32 + 2.0**-33
                mean, std = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in ("_mean", "_std"))
                draw = mean + std * np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n:])
                none = batch.column("_mean").is_null().to_numpy(zero_copy_only=False) | batch.column("_std").is_null().to_numpy(zero_copy_only=False)
                drawn = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(batch) + 1, n, dtype=np.int32)), pa.array(draw.ravel(), mask=np.repeat(none, n)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), drawn], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name) + f", `{name}` array<double>"
    return given.mapInArrow(run, schema)


def joint_draws(p: Posterior, n: int, seed: int = 1) -> np.ndarray:
    """Draws (M, n) of the posterior's weights: the field of draw s is k(x) w_s everywhere, so places of a draw fit together."""
    k = p.field.gram()
    spread = solve_spd(k + p.field.jitter * np.eye(len(k)), np.eye(len(k))) - p.correction  # (K + A)^-1
    spread = (spread + spread.T) / 2
    return p.alpha[:, None] + cholesky(spread, 1e-12) @ np.random.default_rng(seed).normal(size=(len(k), n))


def joint_samples(rows: DataFrame, p: Posterior, n: int = 64, seed: int = 1, name: str = "samples") -> DataFrame:
    """Adds an array of n joint draws at rows(x, y, t, covariates, prior), prior included. The draws of the inducing state are
    made once and go with the tasks (M x n numbers), so element s of all rows is one field; what the inducing points do not
    determine is left out (samples() draws rows apart from each other with their full variance)."""
    weights = joint_draws(p, n, seed)
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema) + f", `{name}` array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = p.field.cov(pdf[p.field.columns].to_numpy(dtype=float), p.field.points) @ weights + pdf["prior"].to_numpy(dtype=float)[:, None]
            yield pdf.assign(**{name: list(drawn)})

    return rows.mapInPandas(run, schema)


def mean_of_draws(df: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """by, n, mean and std of the group's mean over the draws."""
    each = df.select(*by, F.posexplode(samples).alias("_s", "_v")).groupBy(*by, "_s").agg(F.avg("_v").alias("_m"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"))


# --- inducing points -------------------------------------------------------------------------------------------------


def even_points(rows: DataFrame, n_space: int, n_time: int) -> np.ndarray:
    """Evenly spaced picks of the distinct locations (by x, y) crossed with those of the distinct times."""

    def picks(df: DataFrame, cols: list[str], n: int) -> list:
        ranked = global_rank(df.select(*cols).distinct(), cols, "_k")
        many = ranked.agg(F.max("_k")).first()[0] or 0
        wanted = sorted({int(i) for i in np.linspace(0, many - 1, min(n, many))})
        return [tuple(r[c] for c in cols) for r in ranked.filter((F.col("_k") - 1).isin(wanted)).orderBy("_k").collect()]

    places, times = picks(rows, ["x", "y"], n_space), picks(rows, ["t"], n_time)
    return np.array([(*s, *t) for s in places for t in times], dtype=float)


def kmeans_points(rows: DataFrame, m: int, seed: int = 1, columns: tuple[str, ...] = COORDS, lengths: tuple[float, ...] | None = None) -> np.ndarray:
    """Cluster centres of the distinct rows, in units of the columns' length scales."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    lengths = lengths or (1.0,) * len(columns)
    table = rows.select(*[(F.col(c) / x).alias(c) for c, x in zip(columns, lengths)]).dropna().distinct().orderBy(*columns)
    points = VectorAssembler(inputCols=list(columns), outputCol="features").transform(table)
    return np.array(KMeans(k=m, seed=seed).fit(points).clusterCenters()) * np.array(lengths)


def hashed_points(rows: DataFrame, m: int, seed: int = 1, columns: tuple[str, ...] = COORDS) -> np.ndarray:
    """The first m distinct rows by hash."""
    table = rows.select(*columns).dropna().distinct().withColumn("_h", hash_unit(seed, *columns)).orderBy("_h", *columns).limit(m)
    return np.array([tuple(r[c] for c in columns) for r in table.collect()], dtype=float).reshape(-1, len(columns))


def regular_points(n_space: int, n_time: int) -> np.ndarray:
    axis, times = np.linspace(0, 1, n_space), np.linspace(0, 1, n_time)
    return np.array([(a, b, t) for a in axis for b in axis for t in times])


# --- day by day ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DayStates:
    """Residual inducing states by day: mean and covariance, with what the filter predicted before the day's data."""

    field: Field
    days: list[int]
    mean: np.ndarray
    cov: np.ndarray
    predicted_mean: np.ndarray
    predicted_cov: np.ndarray
    factors: np.ndarray
    counts: list[int] = field(default_factory=list)
    log_likelihood: float = 0.0


def sequential_filter(rows: DataFrame, f: Field, days: list[int], length: float = 5.0, day: str = "day") -> DayStates:
    """Decaying states over days from per-day sums: one pass over the rows, then a loop of M x M steps on the driver.

    The field's time kernel is not used within a day. Days without data only propagate; the state decays to the prior
    (0 in residual terms) with exp(-dt / length), the process noise keeps the field's variance.
    """
    spatial = spatial_part(f)
    sums = information_sums(rows.withColumn("t", F.lit(0.0)), spatial, key=day)
    return day_states(spatial, filter_steps({int(d): s for d, s in sums.items()}, spatial, days, length))


def spatial_part(f: Field) -> Field:
    return replace(f, points=np.column_stack([f.points[:, :2], np.zeros(len(f.points)), f.points[:, 3:]]))


@dataclass(frozen=True)
class DayStep:
    """One day: its sums, its state after and before its data, the decay into it, and its log-likelihood."""

    day: int
    sums: Sums
    mean: np.ndarray
    cov: np.ndarray
    predicted_mean: np.ndarray
    predicted_cov: np.ndarray
    factor: float
    log_likelihood: float


def filter_steps(sums: dict[int, Sums], spatial: Field, days: list[int], length: float, start: DayStep | None = None) -> list[DayStep]:
    """The filter over days in order, from the day before the first of them or from the prior."""
    m = len(spatial.points)
    k = spatial.gram() + spatial.jitter * np.eye(m)
    k_inv = solve_spd(k, np.eye(m))
    log_det = lambda c: 2 * np.log(np.diag(cholesky(c, 1e-10))).sum()
    mean, cov, last, out = (start.mean, start.cov, start.day, []) if start else (np.zeros(m), k.copy(), None, [])
    for d in days:
        a = float(np.exp(-(d - last) / length)) if last is not None else 0.0
        mean, cov, last, score = a * mean, a * a * cov + (1 - a * a) * k, d, 0.0
        pm, pp, s = mean, cov, sums.get(d, Sums(np.zeros((m, m)), np.zeros(m)))
        if s.n:
            # Rows see the state through H = k_x K^-1, so H'H sums are K^-1 A K^-1.
            info, rhs = k_inv @ s.a @ k_inv, k_inv @ s.b
            prior_inv = solve_spd(cov, np.eye(m))
            new = solve_spd(prior_inv + info, np.eye(m))
            new_mean = new @ (prior_inv @ mean + rhs)
            score = float(-0.5 * (s.n * np.log(2 * np.pi) + s.log_noise + log_det(cov) - log_det(new) + s.square + mean @ prior_inv @ mean - new_mean @ (prior_inv + info) @ new_mean))
            mean, cov = new_mean, (new + new.T) / 2
        out.append(DayStep(d, s, mean, cov, pm, pp, a, score))
    return out


def day_states(spatial: Field, steps: list[DayStep]) -> DayStates:
    m = len(spatial.points)
    stack = lambda c, *shape: np.array([getattr(s, c) for s in steps]).reshape(len(steps), *shape)
    return DayStates(
        spatial, [s.day for s in steps], stack("mean", m), stack("cov", m, m), stack("predicted_mean", m), stack("predicted_cov", m, m), stack("factor"),
        [s.sums.n for s in steps], float(sum(s.log_likelihood for s in steps)),
    )


ARRAYS = ("mean", "cov", "predicted_mean", "predicted_cov")
KEPT = "day int, n long, a binary, b binary, square double, log_noise double, precision double, " + ", ".join(f"{c} binary" for c in ARRAYS) + ", factor double, log_likelihood double"


def kept_steps(spark, path: str, m: int) -> tuple[dict[int, DayStep], int]:
    """The latest version of each day in a kept table, and the table's latest version."""
    if not path_exists(spark, path):
        return {}, 0
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c not in ("day", "version")]
    rows = table.groupBy("day").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("x")).collect()  # one row a day
    array = lambda b: np.frombuffer(b).reshape(-1, m).squeeze()
    out = {}
    for r in rows:
        x = r["x"]
        sums = Sums(np.frombuffer(x["a"]).reshape(m, m), np.frombuffer(x["b"]), x["n"], x["square"], x["log_noise"], x["precision"])
        out[r["day"]] = DayStep(r["day"], sums, *(array(x[c]).reshape((m, m) if "cov" in c else (m,)) for c in ARRAYS), x["factor"], x["log_likelihood"])
    return out, max((r["version"] for r in rows), default=0)


def add_days(rows: DataFrame, path: str, f: Field, length: float = 5.0, day: str = "day") -> DayStates:
    """sequential_filter() with the states kept in a table at `path`: rows are those of new days, or further rows of known days.
    Only they are read; days from the first one touched on are filtered anew from the state before it, and written as a
    new version. So days added one by one, in any order, give the states of all rows at once."""
    spark, spatial = rows.sparkSession, spatial_part(f)
    kept, version = kept_steps(spark, path, len(f.points))
    new = {int(d): s for d, s in information_sums(rows.withColumn("t", F.lit(0.0)), spatial, key=day).items()}
    if new:
        first = min(new)
        before = max((d for d in kept if d < first), default=None)
        days = sorted(d for d in {*kept, *new} if d >= first)
        sums = {d: kept[d].sums + new[d] if d in kept and d in new else new[d] if d in new else kept[d].sums for d in days}
        steps = filter_steps(sums, spatial, days, length, kept.get(before))
        table = [(s.day, s.sums.n, s.sums.a.tobytes(), s.sums.b.tobytes(), s.sums.square, s.sums.log_noise, s.sums.precision, *(getattr(s, c).tobytes() for c in ARRAYS), s.factor, s.log_likelihood) for s in steps]
        spark.createDataFrame(table, KEPT).coalesce(1).write.parquet(f"{path}/version={version + 1}")
        kept |= {s.day: s for s in steps}
    return day_states(spatial, [kept[d] for d in sorted(kept)])


def smooth_states(s: DayStates) -> DayStates:
    """Backward smoother of the day states."""
    mean, cov = s.mean.copy(), s.cov.copy()
    for i in range(len(s.days) - 2, -1, -1):
        gain = solve_spd(s.predicted_cov[i + 1], s.factors[i + 1] * s.cov[i]).T
        mean[i] = s.mean[i] + gain @ (mean[i + 1] - s.predicted_mean[i + 1])
        cov[i] = s.cov[i] + gain @ (cov[i + 1] - s.predicted_cov[i + 1]) @ gain.T
    return replace(s, mean=mean, cov=cov)


def predict_states(rows: DataFrame, s: DayStates, day: str = "day", var_floor: float = 0.5, smoothed: DayStates | None = None) -> DataFrame:
    """Adds mean, std, n_obs at rows(x, y, covariates, prior, day): the nearest known day's state; var_floor * k(x, x) is added to the
    variance. With smoothed states of the same days also smooth_mean, smooth_std, in the same pass."""
    k = s.field.gram()
    k_inv = solve_spd(k + s.field.jitter * np.eye(len(k)), np.eye(len(k)))
    days = np.array(s.days)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", mean double, std double, n_obs int" + ", smooth_mean double, smooth_std double" * (smoothed is not None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.abs(pdf[day].to_numpy(dtype=float)[:, None] - days[None, :]).argmin(axis=1)
            x = pdf.assign(t=0.0)[s.field.columns].to_numpy(dtype=float)
            h = s.field.cov(x, s.field.points) @ k_inv
            explained = np.einsum("ij,ij->i", h, s.field.cov(x, s.field.points))
            prior, new = pdf["prior"].to_numpy(dtype=float), {}
            for name, states in (("", s), *([("smooth_", smoothed)] if smoothed is not None else [])):
                mean, var = np.empty(len(pdf)), np.empty(len(pdf))
                for i in np.unique(at):
                    own = at == i
                    mean[own] = h[own] @ states.mean[i]
                    var[own] = np.einsum("ij,jk,ik->i", h[own], states.cov[i], h[own], optimize=True)
                var = np.maximum(var + np.maximum(s.field.variance - explained, 0) + var_floor * s.field.variance, 1e-12)
                new |= {f"{name}mean": mean + prior, f"{name}std": np.sqrt(var)} | ({} if name else {"n_obs": np.array(s.counts, dtype=np.int32)[at]})
            yield pdf.assign(**new)

    return rows.mapInPandas(run, schema)


# --- kriging of any number of stations -------------------------------------------------------------------------------

#: Points of a block, and inducing points of the preconditioner at most.
BLOCK_POINTS = 2_000
PRECONDITIONER = 500
#: Pairs of blocks of a task, up to so many tasks; beyond, tasks grow.
TASK_PAIRS = 4
MOST_TASKS = 2_000


def point_blocks(rows: DataFrame, columns: list[str], block: int = BLOCK_POINTS) -> DataFrame:
    """block, data (len(columns) x points doubles): rows dealt by hash to blocks of about `block` points."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(columns)[columns].to_numpy(dtype=float).T
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "data": [np.ascontiguousarray(data).tobytes()]})

    n = rows.count()
    table = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(-(-n // block) or 1)).cast("int"))
    return written(table.groupBy("block").applyInPandas(pack, "block int, data binary"), "kriging-points")


def _sum_blocks(partial: DataFrame, name: str) -> DataFrame:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], name: [np.sum([np.frombuffer(x) for x in pdf[name]], axis=0).tobytes()]})

    return partial.groupBy("block").applyInPandas(add, f"block int, {name} binary")


def kernel_product(targets: DataFrame, sources: DataFrame, n_sources: int, f: Field, name: str = "q") -> DataFrame:
    """block, name: kernel of the targets' points with all sources' points, times the sources' values: targets(block, at),
    sources(block, at, v). Every target block meets every source block (rows of the join are blocks, not points)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = []
            for a, b, v in zip(pdf["at"], pdf["_at"], pdf["_v"]):
                own, other = np.frombuffer(a).reshape(3, -1).T, np.frombuffer(b).reshape(3, -1).T
                q.append(f.product(own, other, np.frombuffer(v)).tobytes())
            yield pd.DataFrame({"block": pdf["block"], name: q})

    # Tasks follow the pairs of blocks, not their bytes: a source block is sent once for each of `salts` shares of the targets.
    n_targets = targets.count()
    tasks = min(-(-n_targets * n_sources // TASK_PAIRS), MOST_TASKS) or 1
    salts = max(1, min(n_targets, -(-4 * tasks // max(n_sources, 1))))
    key = ["_block", "_salt"]
    asked = targets.select("block", "at", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(n_sources - 1))).alias("_block"))
    given = sources.select(F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("at").alias("_at"), F.col("v").alias("_v"))
    met = asked.repartition(tasks, *key).join(given.repartition(tasks, *key), key)
    return _sum_blocks(met.select("block", "at", "_at", "_v").mapInPandas(run, f"block int, {name} binary"), name)


def _blockwise(df: DataFrame, run, schema: str) -> DataFrame:
    """run(row of arrays) -> values of the schema, for each block."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [run({c: np.frombuffer(v) if isinstance(v, bytes) else v for c, v in r.items()}) for r in pdf.to_dict("records")]
            yield pd.DataFrame([[v.tobytes() if isinstance(v, np.ndarray) else v for v in r] for r in rows], columns=[x.split()[0] for x in schema.split(", ")])

    return df.mapInPandas(each, schema)


def solve_process(points: DataFrame, f: Field, noise: float, tolerance: float = 1e-9, most: int = 500) -> tuple[DataFrame, int]:
    """block, at, v: the weights w of (K + noise^2 I) w = value at points(x, y, t, value), and the rounds it took. Conjugate
    gradients: a round is one product of the kernel by blocks and one update of the written vectors; what the driver holds are
    scalars and the preconditioner's sums over PRECONDITIONER points at most (the low-rank process of points in hash order,
    which is exact when it holds them all)."""
    columns = ["x", "y", "t", "value"]
    blocks = point_blocks(points, columns)
    n_blocks = blocks.agg(F.max("block")).first()[0]
    n_blocks = 0 if n_blocks is None else n_blocks + 1
    names = ("at", "v", "r", "p", "q")
    state = _blockwise(blocks, lambda r: (r["block"], r["data"][: len(r["data"]) // 4 * 3].copy(), 0 * r["data"][-(len(r["data"]) // 4) :], r["data"][-(len(r["data"]) // 4) :].copy()), "block int, at binary, v binary, r binary")
    state = written(state, "kriging-state")
    low = replace(f, points=hashed_points(points, PRECONDITIONER))
    s2, m = noise**2, len(low.points)
    where = lambda at: at.reshape(3, -1).T

    def sums(r) -> tuple:
        k = low.cov(where(r["at"]), low.points)
        return r["block"], k.T @ k, k.T @ r["r"], float(r["r"] @ r["r"])

    first = _blockwise(state, sums, "block int, a binary, u binary, rr double").withColumn("block", F.lit(0))
    total = first.groupBy("block").applyInPandas(lambda pdf: pd.DataFrame({"block": [0], "a": [np.sum([np.frombuffer(x) for x in pdf["a"]], axis=0).tobytes()], "u": [np.sum([np.frombuffer(x) for x in pdf["u"]], axis=0).tobytes()], "rr": [pdf["rr"].sum()]}), "block int, a binary, u binary, rr double").first()
    if total is None:
        return state.select("block", "at", "v"), 0
    gram = low.gram() + f.jitter * np.eye(m)
    inner = s2 * gram + np.frombuffer(total["a"]).reshape(m, m)
    u, rr = np.frombuffer(total["u"]), total["rr"]
    start = rr
    beta, rz, rounds = 0.0, None, 0
    state = written(state.withColumn("p", F.col("v")), "kriging-state")
    while rounds < most and rr > tolerance**2 * start:
        c = solve_spd(inner, u)
        new = (rr - u @ c) / s2  # r P^-1 r without a pass
        beta, rz = (new / rz if rz is not None else 0.0), new

        def direction(r, c=c, beta=beta) -> tuple:
            z = (r["r"] - low.cov(where(r["at"]), low.points) @ c) / s2
            return r["block"], r["at"], r["v"], r["r"], z + beta * r["p"]

        moved = written(_blockwise(state, direction, "block int, at binary, v binary, r binary, p binary"), "kriging-direction")
        product = kernel_product(moved.select("block", "at"), moved.select("block", "at", F.col("p").alias("v")), n_blocks, f)
        met = written(moved.join(product, "block").select("block", *names), "kriging-product")
        pq = _blockwise(met, lambda r: (float(r["p"] @ (r["q"] + s2 * r["p"])),), "pq double").agg(F.sum("pq")).first()[0]
        alpha = rz / pq

        def update(r, alpha=alpha) -> tuple:
            return r["block"], r["at"], r["v"] + alpha * r["p"], r["r"] - alpha * (r["q"] + s2 * r["p"]), r["p"]

        state = written(_blockwise(met, update, "block int, at binary, v binary, r binary, p binary"), "kriging-state")
        parts = _blockwise(state, lambda r: (low.cov(where(r["at"]), low.points).T @ r["r"], float(r["r"] @ r["r"])), "u binary, rr double")
        one = parts.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(lambda pdf: pd.DataFrame({"u": [np.sum([np.frombuffer(x) for x in pdf["u"]], axis=0).tobytes()], "rr": [pdf["rr"].sum()]}), "u binary, rr double").first()
        u, rr, rounds = np.frombuffer(one["u"]), one["rr"], rounds + 1
    return state.select("block", "at", "v"), rounds


def regression_kriging(day_rows: DataFrame, grid: DataFrame, f: Field, noise: float = 1.0) -> DataFrame:
    """One day: observations on baseline by least squares, residuals interpolated by the process of all stations, value at
    grid(x, y, baseline). The process is solved by conjugate gradients over blocks at any number of stations, and met by the
    grid block by block. Fewer than 5 stations give the regression only."""
    fitted = day_rows.agg(F.regr_slope("value", "baseline").alias("a"), F.regr_intercept("value", "baseline").alias("b"), F.count(F.lit(1)).alias("n")).first()
    a, b = (fitted["a"], fitted["b"]) if fitted["a"] is not None else (1.0, 0.0)
    line = a * F.col("baseline") + b
    if fitted["n"] < 5:
        return grid.withColumn("mean", line)
    residuals = written(day_rows.select("x", "y", F.lit(0.0).alias("t"), (F.col("value") - line).alias("value")), "kriging-residuals")
    weights, _ = solve_process(residuals, f, noise)
    weights = written(weights, "kriging-weights")
    places = written(grid.withColumn("_id", F.monotonically_increasing_id()), "kriging-grid")
    blocks = point_blocks(places.select("x", "y", F.lit(0.0).alias("t"), F.col("_id").alias("id")), ["x", "y", "t", "id"])
    asked = _blockwise(blocks, lambda r: (r["block"], r["data"][: len(r["data"]) // 4 * 3].copy(), r["data"][-(len(r["data"]) // 4) :].copy()), "block int, at binary, id binary")
    asked = written(asked, "kriging-places")
    met = asked.join(kernel_product(asked.select("block", "at"), weights, weights.agg(F.max("block")).first()[0] + 1, f), "block")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, q in zip(pdf["id"], pdf["q"]):
                yield pd.DataFrame({"_id": np.frombuffer(i).astype(np.int64), "_q": np.frombuffer(q)})

    found = met.select("id", "q").mapInPandas(rows, "_id long, _q double")
    return places.join(found, "_id").withColumn("mean", line + F.col("_q")).select(*grid.columns, "mean")
