"""Points in polygons by a hierarchical covering.

A polygon (any number of parts and holes: rings under the even-odd rule) becomes cells of a quadtree. It starts at
cells about as large as its box, and cells that its outline crosses are split some levels, and on while many edges are left:
so inner cells are large, and a polygon is few rows whatever its size. A cell holds the edges in it, and of the edges that
a ray from it may cross farther out only the parity and where it turns; an inner cell holds no edges, so its points need
no ray cast. The result is that of casting a ray at all edges.

A point asks for the least polygon around it, so where an inner cell has a smaller id the edges of others are dropped
before any point meets them: what a point meets does not grow with the number of polygons that overlap there.

Edges are half-open: a point on an outline is inside where the rule of the ray says so, so of polygons that share an edge
exactly one has the points on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Degrees of a cell of level 0; a cell of level k is that over 2^k. Levels come in steps of STEP, each splits a cell 4^STEP-fold.
ROOT = 360.0
STEP = 2
#: Splits of the outline's cells below the polygon's box, edges up to which a cell is not split further, and the last level.
DETAIL = 2
EDGES = 16
LAST = 24
#: A place beyond any longitude or latitude.
FAR = 1e6
#: Covering rows up to which they are broadcast (some 200 bytes each, more where EDGES are exceeded at the last level).
BROADCAST = 50_000
#: Polygons that go down the tree together, and polygons of a task.
TOGETHER = 64
TASK = 256

COVER = "polygon_id {}, level int, i long, j long, inside boolean, edges array<array<double>>"


def _sized(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each value as often as its count."""
    return np.repeat(values, counts)


def coverings(shapes: list[list], detail: int = DETAIL, most_edges: int = EDGES, last: int = LAST) -> dict[str, np.ndarray]:
    """Cells of many polygons at once, as arrays: shape (the polygon's place in the list), level, i along x, j along y, inside (the
    parity of the edges that are not kept), n (edges kept) and edges (n of each cell, one after the other). All
    polygons go down the tree together, a level in a few array steps."""
    edges, owner = [np.zeros((0, 4))], [np.zeros(0, dtype=np.int64)]
    for s, rings in enumerate(shapes):
        for r in rings if rings is not None else []:
            if r is not None and len(r) > 2:
                p = np.array([(v[0], v[1]) for v in r], dtype=float)
                edges.append(np.hstack([p, np.roll(p, -1, axis=0)]))
                owner.append(np.full(len(p), s))
    edge, own_shape = np.concatenate(edges), np.concatenate(owner)
    sloped = edge[:, 1] != edge[:, 3]  # level edges are never crossed
    edge, own_shape = edge[sloped], own_shape[sloped]
    known, first = np.unique(own_shape, return_index=True)
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("shape", "level", "i", "j", "inside", "n", "edges")}
    cell: list[tuple] = []
    for s, a, b in zip(known, first, [*first[1:], len(edge)]):
        x, y = edge[a:b, [0, 2]], edge[a:b, [1, 3]]
        size = max(x.max() - x.min(), y.max() - y.min())
        level = int(max(0, min(last, np.floor(np.log2(ROOT / size))))) // STEP * STEP
        span = lambda v, side=ROOT / 2**level: range(int(np.floor(v.min() / side)), int(np.floor(v.max() / side)) + 1)
        cell += [(s, level, i, j, level, a, b) for i in span(x) for j in span(y)]
    if not cell:
        return {c: np.zeros((0, 4) if c == "edges" else 0, dtype=bool if c == "inside" else float if c == "edges" else np.int64) for c in out}
    shape, k, i, j, top, a, b = np.array(cell, dtype=np.int64).T
    inside = np.zeros(len(shape), dtype=bool)
    c = _sized(np.arange(len(shape)), b - a)  # pairs of a cell and an edge that may be in it
    e = np.arange(len(c)) - _sized(np.cumsum(b - a) - (b - a), b - a) + _sized(a, b - a)
    tc, tv = np.zeros(0, dtype=np.int64), np.zeros(0)  # pairs of a cell and a turn
    while len(shape):
        side = ROOT / 2.0**k
        pad = side * 1e-6
        x0, x1, y0, y1 = i * side - pad, (i + 1) * side + pad, j * side - pad, (j + 1) * side + pad
        ex0, ey0, ex1, ey1 = edge[e].T
        low, high = np.minimum(ey0, ey1), np.maximum(ey0, ey1)
        level_with = (low <= y1[c]) & (high >= y0[c])
        slope = (ex1 - ex0) / (ey1 - ey0)
        start, end = (ex0 + (y - ey0) * slope for y in (np.maximum(low, y0[c]), np.minimum(high, y1[c])))
        beyond, short = np.minimum(start, end) > x1[c], np.maximum(start, end) < x0[c]
        # A ray at y crosses the edges right of the cell that begin at or below y and end above: its parity turns at their
        # ends. Two edges that meet there turn it twice, so what is left are ends whose other edge is in the cell.
        far = level_with & beyond
        tc, tv = np.concatenate([tc, c[far], c[far]]), np.concatenate([tv, low[far], high[far]])
        order = np.lexsort((tv, tc))
        tc, tv = tc[order], tv[order]
        begins = np.flatnonzero(np.concatenate([[True], (tc[1:] != tc[:-1]) | (tv[1:] != tv[:-1])])) if len(tc) else np.zeros(0, dtype=np.int64)
        odd = begins[np.diff([*begins, len(tc)]) % 2 == 1]
        tc, tv = tc[odd], tv[odd]
        inside = inside ^ (np.bincount(tc[tv <= y0[tc]], minlength=len(shape)) % 2 == 1)
        within = (tv > y0[tc]) & (tv <= y1[tc])
        tc, tv = tc[within], tv[within]
        stay = level_with & ~beyond & ~short
        c, e = c[stay], e[stay]
        n_own, n_turns = np.bincount(c, minlength=len(shape)), np.bincount(tc, minlength=len(shape))
        split = (n_own > 0) & (k < last) & ((k < top + detail * STEP) | (n_own > most_edges))
        done = ~split & ((n_own > 0) | (n_turns > 0) | inside)
        upright = np.column_stack([np.full(len(tv), FAR), tv, np.full(len(tv), FAR), np.full(len(tv), FAR)])  # endless: turns the parity from tv on
        rows, at = np.concatenate([edge[e], upright]), np.concatenate([c, tc])
        order = np.argsort(at, kind="stable")
        out["edges"].append(rows[order][done[at[order]]])
        for name, v in (("shape", shape), ("level", k), ("i", i), ("j", j), ("inside", inside), ("n", n_own + n_turns)):
            out[name].append(v[done])
        n, parts = 2**STEP, 4**STEP
        place = np.cumsum(split) - 1  # of a split cell among them
        below = lambda v: _sized(v[split], parts)
        u = np.tile(np.arange(parts), int(split.sum()))
        kids = lambda cells: (place[cells][:, None] * parts + np.arange(parts)).ravel()
        mine, turning = split[c], split[tc]
        c, e = kids(c[mine]), _sized(e[mine], parts)
        tc, tv = kids(tc[turning]), _sized(tv[turning], parts)
        shape, k, top, inside, i, j = below(shape), below(k) + STEP, below(top), below(inside), below(i) * n + u // n, below(j) * n + u % n
    return {name: np.concatenate(v) for name, v in out.items()}


def covering_cells(rings: list, detail: int = DETAIL, most_edges: int = EDGES, last: int = LAST) -> list[tuple[int, int, int, bool, np.ndarray]]:
    """(level, i, j, inside, edges) of one polygon's cells."""
    found = coverings([rings], detail, most_edges, last)
    own = np.split(found["edges"], np.cumsum(found["n"])[:-1]) if len(found["n"]) else []
    return [(int(k), int(i), int(j), bool(inside), x) for k, i, j, inside, x in zip(found["level"], found["i"], found["j"], found["inside"], own)]


def covering(polygons: DataFrame, detail: int = DETAIL, most_edges: int = EDGES) -> DataFrame:
    """polygon_id, level, i, j, inside, edges: the cells of polygons(polygon_id, rings array of arrays of [lon, lat])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                batch = whole.slice(at, TOGETHER)
                found = coverings(batch.column("rings").to_pylist(), detail, most_edges)
                corners = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(found["edges"]) + 1, 4, dtype=np.int32)), pa.array(found["edges"].ravel()))
                edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found["n"])]).astype(np.int32)), corners)
                columns = [batch.column("polygon_id").take(pa.array(found["shape"])), pa.array(found["level"].astype(np.int32)), pa.array(found["i"]), pa.array(found["j"]), pa.array(found["inside"]), edges]
                yield pa.RecordBatch.from_arrays(columns, names=["polygon_id", "level", "i", "j", "inside", "edges"])

    return polygons.select("polygon_id", "rings").mapInArrow(run, COVER.format(polygons.schema["polygon_id"].dataType.simpleString()))


def least_cells(cells: DataFrame) -> DataFrame:
    """The covering without what cannot give a point its least polygon: of a cell's inner rows that of the least id stays, and
    rows that hold edges go where an inner row of the cell, or of a larger cell around it, has a smaller id or the same."""
    key = ["level", "i", "j"]
    inner = written(cells.filter(F.col("inside") & (F.size("edges") == 0)).groupBy(*key).agg(F.min("polygon_id").alias("polygon_id")), "polygon-inner")
    rest = cells.filter(~F.col("inside") | (F.size("edges") > 0))
    levels = sorted(r[0] for r in inner.select("level").distinct().collect())  # at most LAST / STEP + 1
    if not levels:
        return cells
    around = F.filter(F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"shiftright(i, greatest(level - {k}, 0))").alias("i"), F.expr(f"shiftright(j, greatest(level - {k}, 0))").alias("j")) for k in levels]), lambda a: a["level"] <= F.col("level"))
    own = [F.col(c).alias(f"_{c}") for c in key]
    met = rest.select(*key).distinct().select(*own, F.explode(around).alias("_a")).select(*[f"_{c}" for c in key], "_a.*").join(inner, key)
    bound = met.groupBy(*[F.col(f"_{c}").alias(c) for c in key]).agg(F.min("polygon_id").alias("_bound"))
    rest = rest.join(bound, key, "left").filter(F.col("_bound").isNull() | (F.col("polygon_id") < F.col("_bound"))).drop("_bound")
    same = inner.select("polygon_id", *key, F.lit(True).alias("inside"), F.array().cast("array<array<double>>").alias("edges"))
    return rest.select(*same.columns).unionByName(same)


def _inside(x: Column, y: Column) -> Column:
    def crossed(e: Column) -> Column:
        at = e[0] + (y - e[1]) * (e[2] - e[0]) / (e[3] - e[1])
        return ((e[1] > y) != (e[3] > y)) & (x < at)

    return F.aggregate("edges", F.col("inside"), lambda s, e: s != crossed(e))


def points_in_polygons(points: DataFrame, polygons: DataFrame, lon: str = "longitude", lat: str = "latitude", detail: int = DETAIL, most_edges: int = EDGES) -> DataFrame:
    """points with polygon_id, the least id of the polygons(polygon_id, rings, or one ring) that contain it, or null."""
    if "rings" not in polygons.columns:
        polygons = polygons.select("polygon_id", F.array("ring").alias("rings"))
    # Of polygons with the same rings the least id is enough; a task holds few of those left, however small their table is.
    shapes = written(polygons.filter("rings is not null").groupBy("rings").agg(F.min("polygon_id").alias("polygon_id")), "polygon-shapes")
    cells = written(covering(shapes.repartition(-(-shapes.count() // TASK) or 1), detail, most_edges), "polygon-cells")
    cells = written(least_cells(cells), "polygon-cells")
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # at most LAST / STEP + 1
    x, y = F.col(lon), F.col(lat)
    # A running id must be written before it is read twice: a recomputed task might number its rows otherwise.
    placed = written(points.withColumn("_point", F.monotonically_increasing_id()), "polygon-points")
    if not levels:
        return placed.drop("_point").withColumn("polygon_id", F.lit(None).cast(polygons.schema["polygon_id"].dataType))
    at = [F.struct(F.lit(k).alias("level"), F.floor(x / (ROOT / 2**k)).alias("i"), F.floor(y / (ROOT / 2**k)).alias("j")) for k in levels]
    asked = placed.filter(x.isNotNull() & y.isNotNull()).select("_point", x.alias("_x"), y.alias("_y"), F.explode(F.array(*at)).alias("_c")).select("_point", "_x", "_y", "_c.*")
    met = asked.join(F.broadcast(cells) if cells.count() <= BROADCAST else cells, ["level", "i", "j"]).filter(_inside(F.col("_x"), F.col("_y")))
    found = met.groupBy("_point").agg(F.min("polygon_id").alias("polygon_id"))
    return placed.join(found, "_point", "left").drop("_point")
