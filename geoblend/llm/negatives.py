"""Hard-negative mining by spanning-tree bounds: exact top positives of each anchor, and for each positive the best rows
of other labels whose score lies in a window below the positive's.

Vectors become integers, scores are integer inner products, so results do not depend on any order of summation. Rows
are packed into blocks of arrays. Anchors are dealt to blocks of about ANCHORS by label (a hot label to several), and in
each block the anchors of a label get a minimum spanning tree by Euclidean distance. A cell is a block of anchors and
a group of row blocks; its task meets row block after row block and keeps, for each anchor, only the best so far. Scores
at the root of a tree are computed; below, the score of row c at anchor a is within edge * |c| of that at the parent, or
within the sum of the edges since the last computed score. Only rows whose bounds overlap what the anchor still looks
for (a score over its worst kept positive; a window of a positive, over its worst kept negative) are rescored, all at
once if they are the most of them. Bounds lose nothing: on rows without any cluster they only save little.

Every row meets every block of anchors (a stated query set against all rows, in blocks); kept lists, not pairs, leave a
task, one for a cell, and are merged MERGED at a time.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; a null vec_id is no anchor
and loses ties; rows are told apart by where they stand, so an anchor's twin is another row; shorter vectors count as
padded with zeros; components beyond what keeps scores in 62 bits are held at that bound; an empty table gives an
empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

#: Rows of a packed block; anchors of a block on average; row blocks of a cell at most, on average; lists merged at once.
ROWS = 4096
ANCHORS = 1024
CELL = 64
MERGED = 64
#: The score of an empty place: below any score, and its negative is a long.
NONE = np.iinfo(np.int64).min + 1


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as found:
        return dict(found)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which points join a minimum spanning tree, their parents (-1 for the first), and the edges' lengths."""
    n = len(points)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    x = points.astype(np.float64)
    near, near_to, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, dtype=bool)
    at = 0
    for k in range(n):
        order[k], out[at] = at, False
        if k:
            parent[at], edge[at] = near_to[at], math.sqrt(near[at])
        d = ((x - x[at]) ** 2).sum(axis=1)
        closer = d < near
        near[closer], near_to[closer] = d[closer], at
        at = int(np.argmin(np.where(out, near, np.inf))) if k + 1 < n else at
    return order, parent, edge


def best(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by score, then id (null last)."""
    if len(score) > 8 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], none[some], -score[some]))[:k]]
    return np.lexsort((ids, none, -score))[:k]


class Kept:
    """The k best (score, id) so far for each of n places; score NONE is empty."""

    def __init__(self, n: int, k: int):
        self.score, self.ids, self.none = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), dtype=bool)
        self.k = k

    def add(self, place: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if len(score) > self.k:
            top = best(score, ids, none, self.k)
            score, ids, none = score[top], ids[top], none[top]
        score, ids, none = np.concatenate([self.score[place], score]), np.concatenate([self.ids[place], ids]), np.concatenate([self.none[place], none])
        top = np.lexsort((ids, none, -score))[: self.k]
        self.score[place], self.ids[place], self.none[place] = score[top], ids[top], none[top]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"score": self.score, "ids": self.ids, "none": self.none}

    @staticmethod
    def merged(parts: list[dict[str, np.ndarray]], k: int) -> Kept:
        score, ids, none = (np.concatenate([p[c] for p in parts], axis=1) for c in ("score", "ids", "none"))
        out = Kept(len(score), k)
        top = np.lexsort((ids, none, -score), axis=1)[:, :k]
        out.score, out.ids, out.none = (np.take_along_axis(x, top, axis=1) for x in (score, ids, none))
        return out


def wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def scan(anchors: dict, rows: dict, block: int, same_label: bool, wanted: Callable, found: Callable) -> int:
    """Meet one block of rows with a block of anchors; returns the number of scores computed.

    wanted(j) gives the score ranges [low, high] that anchor j looks for; found(j, score, ids, none) takes scores within."""
    dims = max(anchors["vecs"].shape[1], rows["vecs"].shape[1])
    a_all, v_all = wide(anchors["vecs"], dims).astype(np.int64), wide(rows["vecs"], dims).astype(np.int64)
    exact = dims * float(np.abs(a_all).max(initial=0)) * float(np.abs(v_all).max(initial=0)) < 2**53
    number = np.float64 if exact else np.int64  # BLAS where sums of products are exact in doubles
    a_all, v_all = a_all.astype(number), v_all.astype(number)
    norms = np.sqrt((v_all.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    computed = 0
    for label in np.unique(anchors["labels"]):
        members = np.flatnonzero(anchors["labels"] == label)
        members = members[np.argsort(anchors["turn"][members])]
        rows_at = np.flatnonzero((rows["labels"] == label) == same_label)
        if not len(rows_at):
            continue
        v, norm, ids, none = v_all[rows_at], norms[rows_at], rows["ids"][rows_at], rows["none"][rows_at]
        local = {int(j): k for k, j in enumerate(members)}
        centre, slack = np.empty((len(members), len(rows_at))), np.zeros((len(members), len(rows_at)))
        for k, j in enumerate(members.tolist()):
            ranges, up = wanted(j), int(anchors["parent"][j])
            at = None
            if up >= 0:
                p = local[up]
                reach = slack[p] + float(anchors["edge"][j]) * (1 + 1e-9)
                room = reach * norm + np.abs(centre[p]) * 1e-14 + 1e-6
                low, high = centre[p] - room, centre[p] + room
                need = np.zeros(len(rows_at), dtype=bool)
                for a, b in ranges:
                    need |= (high >= a) & (low <= b)
                at = np.flatnonzero(need)
                if 2 * len(at) > len(rows_at):
                    at = None
            if at is None:
                score = v @ a_all[j]
                centre[k], chosen, computed = score, slice(None), computed + len(rows_at)
            else:
                score = v[at] @ a_all[j]
                centre[k], slack[k], chosen, computed = centre[p], reach, at, computed + len(at)
                centre[k][at], slack[k][at] = score, 0.0
            score = score.astype(np.int64)
            own = anchors["own_block"][j] == block
            if own and same_label:
                others = rows_at[chosen] != anchors["own_row"][j]
                found(j, score[others], ids[chosen][others], none[chosen][others])
            else:
                found(j, score, ids[chosen], none[chosen])
    return computed


def integer_rows(vectors: DataFrame, scale: float, vec_col: str, id_col: str, label: Column) -> DataFrame:
    """vec_id, label, vec (integers, floor of scale * x) of the rows that take part."""
    x = F.col(vec_col)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda e: e.cast("double")).alias("vec"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    base = base.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite))
    bound = F.floor(F.sqrt(F.lit(float(2**62)) / F.greatest(F.size("vec"), F.lit(1)))).cast("double") - 1
    held = lambda e: F.greatest(F.least(F.floor(e * scale).cast("double"), bound), -bound)
    return base.select("vec_id", "label", F.transform("vec", lambda e: held(e).cast("long")).alias("vec"))


def _packed_rows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            ids, labels, vecs = part.column(0), part.column(1).to_numpy(), part.column(2)
            sizes = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy()
            matrix = np.zeros((len(sizes), sizes.max(initial=0)), dtype=np.int64)
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = flat
            peak = np.abs(matrix).max(initial=0)
            matrix = matrix.astype(np.int16 if peak < 2**15 else np.int32 if peak < 2**31 else np.int64)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            payload = pack(ids=ids.fill_null(0).to_numpy(), none=none, labels=labels, vecs=matrix)
            yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["payload"])


def _anchor_rows(every: int):
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = unpack(payload)
                at = np.flatnonzero((x["ids"] % every == 0) & ~x["none"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["ids"][at]), pa.array(x["labels"][at]), pa.array(np.full(len(at), block)), pa.array(at), pa.array([x["vecs"][i].astype("<i8").tobytes() for i in at], pa.binary())],
                    names=["vec_id", "label", "own_block", "own_row", "vec"],
                )

    return run


def _anchor_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["label", "vec_id", "own_block", "own_row"])
    rows = [np.frombuffer(b, dtype="<i8") for b in pdf["vec"]]
    vecs = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
    for k, r in enumerate(rows):
        vecs[k, : len(r)] = r
    labels = pdf["label"].to_numpy()
    turn, parent, edge = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64), np.zeros(len(rows))
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        order, up, length = spanning_tree(vecs[at])
        turn[at[order]] = np.arange(len(at))
        parent[at], edge[at] = np.where(up >= 0, at[up], -1), length
    payload = pack(ids=pdf["vec_id"].to_numpy(), labels=labels, own_block=pdf["own_block"].to_numpy(), own_row=pdf["own_row"].to_numpy(), vecs=vecs, turn=turn, parent=parent, edge=edge)
    return pd.DataFrame({"a_block": [int(pdf["a_block"].iloc[0])], "payload": [payload]})


def anchor_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """a_block, payload: anchors dealt to blocks by label, with the spanning trees of their labels."""
    anchors = materialize(blocks.select("block", "payload").mapInArrow(_anchor_rows(every), "vec_id long, label long, own_block long, own_row long, vec binary"), "negatives-anchors")
    # Labels over ANCHORS are dealt to several blocks; the others share blocks by their hash.
    large = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ANCHORS)
    spread = anchors.join(F.broadcast(large), "label", "left")  # at most anchors / ANCHORS rows
    salt = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("own_block", "own_row"), F.ceil(F.col("n") / ANCHORS)))
    width = max(1, math.ceil(anchors.count() / ANCHORS))
    dealt = spread.withColumn("a_block", F.pmod(F.xxhash64("label", salt), F.lit(width)).cast("int")).drop("n")
    return materialize(dealt.groupBy("a_block").applyInPandas(_anchor_block, "a_block int, payload binary"), "negatives-trees")


def cell_groups(blocks: DataFrame) -> int:
    return max(min(MERGED, shuffle_width(blocks.sparkSession)), math.ceil(blocks.count() / CELL))


def _cells(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """a_block, c_group, kind (0 the anchors, 1 a block of rows), block, payload, sorted so that anchors come first."""
    groups = cell_groups(blocks)
    names = [r[0] for r in anchors.select("a_block").collect()]  # one number per ANCHORS anchors
    left = anchors.select("a_block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("c_group"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "payload")
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    right = blocks.select(F.explode(F.array(*map(F.lit, names)) if names else F.lit(None).cast("array<int>")).alias("a_block"), group.alias("c_group"), F.lit(1).alias("kind"), "block", "payload")
    return left.union(right).repartition("a_block", "c_group").sortWithinPartitions("a_block", "c_group", "kind", "block")


def _kept_lists(k: int, same_label: bool, ranges_of: Callable):
    """Streams cells: keeps the k best of what anchors look for; a row of kept lists per cell. ranges_of(anchors) gives an
    array [anchor, place, 2] of score ranges; a place is one kept list."""

    def run(batches):
        at, anchors, kept, ranges, computed = None, None, None, None, 0

        def send():
            part = pack(**kept.arrays())
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([part], pa.binary()), pa.array([computed], pa.int64())], names=["a_block", "c_group", "lists", "computed"])

        for batch in batches:
            for a_block, c_group, kind, block, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if (a_block, c_group) != at:
                    if at:
                        yield send()
                    at, anchors, computed = (a_block, c_group), unpack(payload), 0
                    ranges = ranges_of(anchors)
                    places = ranges.shape[1]
                    kept = Kept(len(ranges) * places, k)
                if kind == 0:
                    continue

                def wanted(j, places=places, kept=kept, ranges=ranges):
                    out = []
                    for i, (a, b) in enumerate(ranges[j].tolist()):
                        if a <= b:
                            out.append((max(a, int(kept.score[j * places + i, k - 1])), b))
                    return out

                def found(j, score, ids, none, places=places, kept=kept, wanted=wanted, ranges=ranges):
                    for i, (a, b) in enumerate(ranges[j].tolist()):
                        if a <= b:
                            fits = np.flatnonzero((score >= max(a, int(kept.score[j * places + i, k - 1]))) & (score <= b))
                            if len(fits):
                                kept.add(j * places + i, score[fits], ids[fits], none[fits])

                computed += scan(anchors, unpack(payload), block, same_label, wanted, found)
        if at:
            yield send()

    return run


def _all_scores(anchors: dict) -> np.ndarray:
    n = len(anchors["ids"])
    return np.tile(np.array([NONE + 1, -NONE]), (n, 1, 1)).reshape(n, 1, 2)


def _windows(low: int, high: int):
    """Ranges of scores s with low * p <= 100 * s <= high * p for each kept positive score p; empty where there is none."""

    def ranges_of(anchors: dict) -> np.ndarray:
        p = anchors["positives"]
        out = np.empty((*p.shape, 2), dtype=np.int64)
        for at, x in np.ndenumerate(p):
            x = int(x)
            out[at] = (1, 0) if x == NONE else (-((-low * x) // 100), (high * x) // 100)
        return out

    return ranges_of


def _with_positives(batches):
    for batch in batches:
        for a_block, payload, lists in zip(*(c.to_pylist() for c in batch.columns)):
            kept = unpack(lists)
            payload = pack(**unpack(payload), positives=kept["score"], positive_ids=kept["ids"], positive_none=kept["none"])
            yield pa.RecordBatch.from_arrays([pa.array([a_block], pa.int32()), pa.array([payload], pa.binary())], names=["a_block", "payload"])


def _result_rows(batches):
    for batch in batches:
        for payload, lists in zip(*(c.to_pylist() for c in batch.columns)):
            x, kept = unpack(payload), unpack(lists)
            place, rank = np.nonzero(kept["score"] != NONE)
            anchor, i = np.divmod(place, x["positives"].shape[1])
            positive_ids = pa.array(x["positive_ids"][anchor, i], mask=x["positive_none"][anchor, i])
            negative_ids = pa.array(kept["ids"][place, rank], mask=kept["none"][place, rank])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["ids"][anchor]), positive_ids, pa.array((rank + 1).astype(np.int32)), negative_ids, pa.array(x["positives"][anchor, i]), pa.array(kept["score"][place, rank])],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def row_blocks(rows: DataFrame) -> DataFrame:
    """block, payload: packed blocks of rows(vec_id, label, vec)."""
    packed = rows.select("vec_id", "label", "vec").mapInArrow(_packed_rows, "payload binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("block"), "payload"), "negatives-rows")


def cell_lists(anchors: DataFrame, blocks: DataFrame, k: int, same_label: bool, ranges_of: Callable) -> DataFrame:
    """a_block, c_group, lists, computed (scores that were computed) of every cell."""
    return materialize(_cells(anchors, blocks).mapInArrow(_kept_lists(k, same_label, ranges_of), "a_block int, c_group int, lists binary, computed long"), "negatives-lists")


def merged_lists(cells: DataFrame, groups: int, k: int) -> DataFrame:
    """a_block, lists: one row per block of anchors."""

    def merge(batches):
        for batch in batches:
            for a_block, c_group, parts in zip(*(c.to_pylist() for c in batch.columns)):
                found = pack(**Kept.merged([unpack(x) for x in parts], k).arrays())
                yield pa.RecordBatch.from_arrays([pa.array([a_block], pa.int32()), pa.array([c_group], pa.int32()), pa.array([found], pa.binary())], names=["a_block", "c_group", "lists"])

    lists = cells.select("a_block", "c_group", "lists")
    while groups > 1:
        parts = lists.groupBy("a_block", F.floor(F.col("c_group") / MERGED).cast("int").alias("c_group")).agg(F.collect_list("lists").alias("lists"))
        lists, groups = parts.mapInArrow(merge, "a_block int, c_group int, lists binary"), math.ceil(groups / MERGED)
    return lists.select("a_block", "lists")


def hard_negatives(
    vectors: DataFrame, label: Column, scale: float = 256.0, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by `every`) and
    each of its best rows of the same label, the best rows of other labels that score low to high percent of the positive."""
    blocks = row_blocks(integer_rows(vectors, scale, vec_col, id_col, label))
    trees, groups = anchor_blocks(blocks, every), cell_groups(blocks)
    first = merged_lists(cell_lists(trees, blocks, positives, True, _all_scores), groups, positives)
    known = trees.join(first, "a_block").select("a_block", "payload", "lists").mapInArrow(_with_positives, "a_block int, payload binary")
    known = materialize(known, "negatives-positives")
    second = merged_lists(cell_lists(known, blocks, negatives, False, _windows(low, high)), groups, negatives)
    return known.join(second, "a_block").select("payload", "lists").mapInArrow(_result_rows, RESULT)
