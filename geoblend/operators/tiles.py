"""Rasters as tiles of arrays: each tile gets the rims of its neighbours, and one array stencil runs in a task.

Pixels are shuffled once to their tiles; then a tile sends its array and eight rims, so a stencil of any reach up to the
tile's size costs nine rows a tile, not a row for each pixel and neighbour. A hot day or region is many tiles.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a tile's side.
SIDE = 64


def tiled(raster: DataFrame, by: list[str], value: str = "value", side: int = SIDE) -> DataFrame:
    """by, ti, tj, tile: the side x side values of raster(by, row, col, value), NaN where there is no pixel or no value."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.iloc[:1][[*by, "ti", "tj"]].copy()
        tile = np.full((side, side), np.nan)
        tile[pdf["row"] % side, pdf["col"] % side] = pdf["v"]
        own["tile"] = [tile.tobytes()]
        return own

    place = lambda c: F.floor(F.col(c) / side).cast("int")
    pixels = raster.select(*by, place("row").alias("ti"), place("col").alias("tj"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v"))
    return pixels.groupBy(*by, "ti", "tj").applyInPandas(pack, f"{_kinds(raster, by)}ti int, tj int, tile binary")


def _kinds(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def stencil(tiles: DataFrame, by: list[str], reach: int, names: list[str], run: Callable[[np.ndarray, int, int], list[np.ndarray]], side: int = SIDE) -> DataFrame:
    """by, row, col and `names` at each pixel that has a value: run(block, row, col) gets a tile with a rim of `reach` pixels,
    and the place of the tile's first pixel; it returns a side x side array for each name (NaN is null)."""
    if reach > side:
        raise ValueError("the rim is wider than a tile")
    kinds = _kinds(tiles, by)
    # From the tile at (di, dj) of a tile come these rows and columns of it.
    span = {-1: slice(side - reach, side), 0: slice(0, side), 1: slice(0, reach)}
    place = {-1: slice(0, reach), 0: slice(reach, reach + side), 1: slice(reach + side, side + 2 * reach)}

    def send(batches):
        for pdf in batches:
            parts = []
            grids = [np.frombuffer(b).reshape(side, side) for b in pdf["tile"]]
            for di, dj in itertools.product((-1, 0, 1), repeat=2):
                if reach or (di, dj) == (0, 0):
                    part = pdf[[*by, "ti", "tj"]].assign(ti=pdf["ti"] - di, tj=pdf["tj"] - dj, di=di, dj=dj, rim=[np.ascontiguousarray(g[span[di], span[dj]]).tobytes() for g in grids])
                    parts.append(part)
            yield pd.concat(parts, ignore_index=True)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        block, whole = np.full((side + 2 * reach, side + 2 * reach), np.nan), False
        for di, dj, rim in zip(pdf["di"], pdf["dj"], pdf["rim"]):
            rows, cols = place[di], place[dj]
            block[rows, cols] = np.frombuffer(rim).reshape(rows.stop - rows.start, cols.stop - cols.start)
            whole |= (di, dj) == (0, 0)
        i, j = np.nonzero(~np.isnan(block[place[0], place[0]])) if whole else (np.zeros(0, int), np.zeros(0, int))
        out = pd.DataFrame({c: [pdf[c].iloc[0]] * len(i) for c in by} | {"row": i + int(pdf["ti"].iloc[0]) * side, "col": j + int(pdf["tj"].iloc[0]) * side})
        found = run(block, int(pdf["ti"].iloc[0]) * side, int(pdf["tj"].iloc[0]) * side) if len(i) else [np.zeros((side, side))] * len(names)
        for name, x in zip(names, found):
            out[name] = x[i, j]
        return out

    sent = tiles.select(*by, "ti", "tj", "tile").mapInPandas(send, f"{kinds}ti int, tj int, di int, dj int, rim binary")
    out = sent.groupBy(*by, "ti", "tj").applyInPandas(meet, f"{kinds}row int, col int, " + ", ".join(f"`{n}` double" for n in names))
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})
