"""Distance weights of many points by a tree of boxes: exact near a cell, by sums at nodes of the boxes farther out.

The points lie in square boxes of levels up to `depth`, four of a level in one of the level above. A box holds the sums of
weights and of values that stand for its points at q x q Chebyshev nodes, so that any function smooth over the box has
the same sum. A cell meets the points of its own box and the eight around one by one, and of the boxes farther out, on
each level, those that are not beside its own box but lie in the boxes beside its parent's: at most 27 a level. So a
cell's work grows with the number of levels, not with the points.

Error: a box met through its nodes is at least its own side away. For d^-p the interpolation error falls by a factor of
3 + 8^0.5 = 5.8 with each node an axis (the nearest singularity lies three half sides off its centre): with q = 12 below
1e-8 of a weight, and so of the sum of weights, and of the weighted values' absolute sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt, written

NODES = 12
#: Points of a lowest box on average; cells or points of a packed row at most.
LEAF = 1_000
CHUNK = 2_000
DEEPEST = 14


def nodes(q: int) -> np.ndarray:
    """Chebyshev nodes in [-1, 1]."""
    return np.cos((2 * np.arange(q) + 1) * np.pi / (2 * q))


def interpolation(x: np.ndarray, q: int) -> np.ndarray:
    """Weights (len(x), q) of the nodes for places x in [-1, 1]."""
    k, t = np.arange(1, q), nodes(q)
    chebyshev = lambda v: np.cos(k[None, :] * np.arccos(np.clip(v, -1, 1))[:, None])
    return 1 / q + 2 / q * chebyshev(x) @ chebyshev(t).T


def _spread(x: np.ndarray, y: np.ndarray, q: int) -> np.ndarray:
    """Weights (points, q * q) of a box's nodes for places in [-1, 1]^2."""
    return (interpolation(x, q)[:, :, None] * interpolation(y, q)[:, None, :]).reshape(len(x), q * q)


def _packed(df: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """i, j, data: rows(i, j, columns as double) in packed pieces of at most `chunk` rows of one box, sorted first."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (i, j), g in pdf.groupby(["i", "j"], sort=False):
                data = g[columns].to_numpy(dtype=float)
                out += [(i, j, data[a : a + chunk].tobytes()) for a in range(0, len(data), chunk)]
            yield pd.DataFrame(out, columns=["i", "j", "data"])

    return df.repartition("i", "j").sortWithinPartitions("i", "j").select("i", "j", *columns).mapInPandas(pack, "i long, j long, data binary")


def _add(pdf: pd.DataFrame, key: list[str], names: list[str]) -> pd.DataFrame:
    one = pdf.iloc[:1][key].copy()
    for n in names:
        one[n] = [np.sum([np.frombuffer(b) for b in pdf[n]], axis=0).tobytes()]
    return one


def box_sums(points: DataFrame, depth: int, side: float, q: int = NODES) -> DataFrame:
    """level, i, j, w, v: node sums of 1 and of the value for the boxes of levels 2 to depth; points(i, j, x, y, value)."""

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (i, j), g in pdf.groupby(["i", "j"]):
                own = _spread(2 * (g["x"].to_numpy() / side - i) - 1, 2 * (g["y"].to_numpy() / side - j) - 1, q)
                out.append((i, j, own.sum(axis=0).tobytes(), (own.T @ g["value"].to_numpy()).tobytes()))
            yield pd.DataFrame(out, columns=["i", "j", "w", "v"])

    kind, key = "i long, j long, w binary, v binary", ["i", "j"]
    # A task's points of a box are one row, so no box gathers its points.
    level = points.select("i", "j", "x", "y", "value").mapInPandas(lowest, kind).groupBy(*key).applyInPandas(lambda pdf: _add(pdf, key, ["w", "v"]), kind)
    out = None
    for k in range(depth, 1, -1):
        level = written(level, "far-boxes")
        named = level.select(F.lit(k).alias("level"), "i", "j", "w", "v")
        out = named if out is None else out.union(named)

        def raised(pdf: pd.DataFrame) -> pd.DataFrame:
            t, sums = nodes(q), []
            for i, j, w, v in zip(pdf["i"], pdf["j"], pdf["w"], pdf["v"]):
                x, y = np.repeat((t + 2 * (i % 2) - 1) / 2, q), np.tile((t + 2 * (j % 2) - 1) / 2, q)  # a child's nodes in its parent
                move = _spread(x, y, q).T
                sums.append((move @ np.frombuffer(w), move @ np.frombuffer(v)))
            w, v = (np.sum([s[k] for s in sums], axis=0).tobytes() for k in (0, 1))
            return pd.DataFrame({"i": [int(pdf["i"].iloc[0]) // 2], "j": [int(pdf["j"].iloc[0]) // 2], "w": [w], "v": [v]})

        level = level.groupBy(F.floor(F.col("i") / 2), F.floor(F.col("j") / 2)).applyInPandas(raised, kind)
    return out


def tree_depth(n: int, extent: tuple[float, float], width: float, leaf: int = LEAF) -> int:
    """The depth at which a lowest box holds `leaf` of n points that are even in the square of this width, or more, where the
    boxes over the points' own extent would hold over twice as many: of a narrow strip's square only those along it have points."""
    even = int(min(DEEPEST, max(0, math.ceil(math.log(max(1, n / leaf), 4)))))
    over = lambda k: math.prod(max(1, math.ceil(e * 2**k / width)) for e in extent)
    return next((k for k in range(even, DEEPEST) if n <= 2 * leaf * over(k)), DEEPEST) if max(extent) > 0 else even


def idw_sums(cells: DataFrame, points: DataFrame, n_points: int, power: float, exact: float, scale: tuple[float, float], q: int = NODES, leaf: int = LEAF) -> DataFrame:
    """_id, _w, _wv, _hit, _at, _pairs of cells(_id, latitude, longitude) against points(ord, latitude, longitude, value): the
    sums of weights and of weighted values, whether a point is at the cell and the value of the first one, and the
    number of pairs (with points or nodes) that were met for it."""
    span = [F.min(c) for c in ("latitude", "longitude")] + [F.max(c) for c in ("latitude", "longitude")]
    a, b = points.agg(*span).first(), cells.agg(*span).first()
    low = [min(v for v in (a[k], b[k]) if v is not None) for k in (0, 1)]
    high = [max(v for v in (a[k], b[k]) if v is not None) for k in (2, 3)]
    width = max((high[0] - low[0]) * scale[0], (high[1] - low[1]) * scale[1], 1e-9) * (1 + 1e-9)
    q = q + 2 * (power > 2)  # steeper weights keep the error with more nodes
    depth = tree_depth(n_points, tuple((a[k + 2] - a[k]) * scale[k] if a[k] is not None else 0.0 for k in (0, 1)), width, leaf)
    side = width / 2**depth
    x, y = (F.col("longitude") - low[1]) * scale[1], (F.col("latitude") - low[0]) * scale[0]
    place = {"x": x, "y": y, "i": F.floor(x / side), "j": F.floor(y / side)}
    first = F.min(F.struct("ord", "value")).alias("_f")
    # Points at one place: all weigh, and the first by ord is the one that a cell there gets.
    spots = points.withColumns(place)
    firsts = spots.groupBy("x", "y").agg(first).select("x", "y", F.col("_f.value").alias("first"))
    spots = written(spots.join(firsts, ["x", "y"]), "far-points")
    asked = written(_packed(cells.filter("latitude is not null and longitude is not null").withColumns(place), ["_id", "x", "y"]).withColumn("_c", F.monotonically_increasing_id()), "far-cells")
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    near = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in ring])).alias("_n")
    met = asked.select("_c", "data", near).select("_c", "data", "_n.*").join(_packed(spots, ["x", "y", "value", "first"]).withColumnRenamed("data", "points"), ["i", "j"])
    schema = "_c long, w binary, v binary, hit binary, at binary, n long"

    def exactly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, data, pts in zip(pdf["_c"], pdf["data"], pdf["points"]):
                own, p = np.frombuffer(data).reshape(-1, 3), np.frombuffer(pts).reshape(-1, 4)
                parts = []
                for s in range(0, len(own), 500):
                    d2 = (own[s : s + 500, 1, None] - p[None, :, 0]) ** 2 + (own[s : s + 500, 2, None] - p[None, :, 1]) ** 2
                    close = d2 < exact**2
                    w = np.where(close, 1.0, d2) ** (-power / 2)
                    parts.append((w.sum(axis=1), w @ p[:, 2], close.any(axis=1).astype(float), np.where(close.any(axis=1), p[close.argmax(axis=1), 3], 0.0)))
                out.append((c, *(np.concatenate(z).tobytes() for z in zip(*parts)), len(own) * len(p)))
            yield pd.DataFrame(out, columns=["_c", "w", "v", "hit", "at", "n"])

    # Tasks follow the pairs of packed rows, not their bytes.
    parts = dealt(met.select("_c", "data", "points")).mapInPandas(exactly, schema)
    if depth >= 2:
        boxes = box_sums(spots, depth, side, q)
        lists = []
        for k in range(2, depth + 1):
            own = [F.floor(F.col(c) / 2 ** (depth - k)) for c in ("i", "j")]
            for a in range(-3, 4):
                for b in range(-3, 4):
                    if max(abs(a), abs(b)) > 1:
                        box = F.struct(F.lit(k).alias("level"), (own[0] + a).alias("i"), (own[1] + b).alias("j"))
                        beside = [F.abs(F.floor((o + s) / 2) - F.floor(o / 2)) <= 1 for o, s in zip(own, (a, b))]
                        lists.append(F.when(beside[0] & beside[1], box))
        lists = F.explode(F.filter(F.array(*lists), lambda z: z.isNotNull())).alias("_n")
        far = asked.select("_c", "data", lists).select("_c", "data", "_n.*").join(boxes, ["level", "i", "j"])

        def through_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = nodes(q)
            for pdf in batches:
                out = []
                for c, data, k, i, j, w, v in zip(*(pdf[n] for n in ("_c", "data", "level", "i", "j", "w", "v"))):
                    own, length = np.frombuffer(data).reshape(-1, 3), width / 2**k
                    gx, gy = np.repeat((i + (t + 1) / 2) * length, q), np.tile((j + (t + 1) / 2) * length, q)
                    g = ((own[:, 1, None] - gx) ** 2 + (own[:, 2, None] - gy) ** 2) ** (-power / 2)
                    zero = np.zeros(len(own)).tobytes()
                    out.append((c, (g @ np.frombuffer(w)).tobytes(), (g @ np.frombuffer(v)).tobytes(), zero, zero, len(own) * q * q))
                yield pd.DataFrame(out, columns=["_c", "w", "v", "hit", "at", "n"])

        parts = parts.union(dealt(far.select("_c", "data", "level", "i", "j", "w", "v")).mapInPandas(through_nodes, schema))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        hits, at = [np.array([np.frombuffer(b) for b in pdf[n]]) for n in ("hit", "at")]
        one = _add(pdf, ["_c"], ["w", "v"])
        which = hits.argmax(axis=0)  # places within `exact` of a cell at a box's rim: the first box that has one
        return one.assign(hit=[hits.max(axis=0).tobytes()], at=[at[which, np.arange(at.shape[1])].tobytes()], n=[int(pdf["n"].sum())])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data, w, v, hit, at, n in zip(*(pdf[c] for c in ("data", "w", "v", "hit", "at", "n"))):
                ids = np.frombuffer(data).reshape(-1, 3)[:, 0].astype(np.int64)
                yield pd.DataFrame({"_id": ids, "_w": np.frombuffer(w), "_wv": np.frombuffer(v), "_hit": np.frombuffer(hit) > 0, "_at": np.frombuffer(at), "_pairs": n // len(ids)})

    summed = asked.select("_c", "data").join(parts.groupBy("_c").applyInPandas(total, schema), "_c")
    return summed.select("data", "w", "v", "hit", "at", "n").mapInPandas(rows, "_id long, _w double, _wv double, _hit boolean, _at double, _pairs long")
