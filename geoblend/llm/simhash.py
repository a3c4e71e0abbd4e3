"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. By the pigeonhole rule two fingerprints within `radius` bits differ
by at most radius // m bits in one of the first (radius mod m) + 1 segments, or by one bit less in one of the
others. So each fingerprint enters the table of every segment under its own value, and under the values of a small
Hamming ball around it; a ball value is entered only where the lowest flipped bit goes from 0 to 1, as of two
fingerprints that differ in a segment exactly one has that bit at 0. Table matches are verified on all 64 bits.

Only distinct fingerprints take part: copies are rows of a class, never pairs. A table entry with many
fingerprints is dealt to cells of pairs of blocks, and every task reports links as a forest (at most one link per
table row), so no group's pairs are written out. Components then come from alternating large-star and small-star
steps over tables in the shared folder.

Cases: null or empty text has no words and fingerprint zero, which links like any other; repeated rows and ties
share a class; rows with a null doc_id get a component but never name one unless all ids in it are null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, drop_rows, materialize, one_of_each, text_digest

BITS = 64
#: Fingerprints of one table entry that one block of a cell holds.
BLOCK = 4096
#: Candidate pairs that are verified at once in a task.
CHUNK = 2_000_000


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    hashes = np.fromiter((digest(s, seed) for s in map(b" ".join, runs)), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 8192):
        part = hashes[a : a + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (hash of the text), fp (signed 64-bit) for every row."""

    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["doc_id", "digest", "fp"])

    base = docs.select(F.col(id_col).alias("doc_id"), text_digest(docs[text_col]).alias("digest"), F.col(text_col).alias("t"))
    return base.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, digest string, fp long")


def segment_balls(radius: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, flip masks) of each segment."""
    out, at = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        reach = radius // segments - (i > radius % segments)
        if reach >= 0:
            masks = [sum(1 << b for b in bits) for r in range(1, reach + 1) for bits in itertools.combinations(range(width), r)]
            out.append((at, width, masks))
        at += width
    return out


def table_rows(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """key (segment and value), fp, own (the value is the fingerprint's own) for distinct fingerprints fps(fp)."""
    balls = segment_balls(radius, segments)

    def run(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            for i, (shift, width, masks) in enumerate(balls):
                value = ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                tag = np.int64(i << 56)
                yield pd.DataFrame({"key": value | tag, "fp": fp, "own": True})
                for mask in masks:
                    to = (value & (mask & -mask)) == 0
                    yield pd.DataFrame({"key": (value[to] ^ mask) | tag, "fp": fp[to], "own": False})

    return fps.mapInPandas(run, "key long, fp long, own boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) with the same components as the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links_of(key: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int):
    """Verified links among rows sorted by (key, own first): each own row against the later rows of its key."""
    ends = np.searchsorted(key, key, side="right")
    first = np.flatnonzero(own)
    count = ends[first] - first - 1
    first, count = first[count > 0], count[count > 0]
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cuts = np.searchsorted(np.cumsum(count), np.arange(CHUNK, count.sum() + CHUNK, CHUNK)) + 1
    found = []
    for f, c in zip(np.split(first, cuts), np.split(count, cuts)):
        if len(f):
            a = np.repeat(f, c)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= radius
            near &= fp[a] != fp[b]
            if near.any():
                found.append(_forest(fp[a[near]], fp[b[near]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def hot_entries(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """key, blocks of table entries that get over BLOCK rows of one fingerprint value, their own or a neighbour's."""
    balls = segment_balls(radius, segments)
    own = [
        fps.select((F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(i << 56)).alias("key"))
        for i, (shift, width, _) in enumerate(balls)
    ]
    heavy = own[0]
    for df in own[1:]:
        heavy = heavy.union(df)
    heavy = materialize(heavy.groupBy("key").count().filter(F.col("count") > BLOCK), "simhash-heavy")
    reach = F.lit(None)
    for i, (_, _, masks) in enumerate(balls):
        reach = F.when(F.shiftrightunsigned("key", 56) == i, F.array(*[F.lit(m).cast("long") for m in [0, *masks]])).otherwise(reach)
    spread = heavy.withColumn("mask", F.explode(reach)).select(F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "count")
    return materialize(spread.groupBy("key").agg(F.ceil(F.sum("count") / BLOCK).cast("int").alias("blocks")), "simhash-hot")


def near_links(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Links a > b between distinct fingerprints, with the same components as all pairs within radius bits."""
    rows = table_rows(fps, radius, segments)
    hot = hot_entries(fps, radius, segments)
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(broadcast_if_small(hot, n_hot, 1_000_000), "key", "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j),
        )
        rows = rows.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(cells)))
        rows = rows.select("key", "cell", "fp", "own")
    else:
        rows = rows.select("key", F.lit(0).alias("cell"), "fp", "own")
    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", F.col("own").desc())

    def run(batches):
        rest = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is None:
                ready, rest = rest, None
            else:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                last = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["cell"] == pdf["cell"].iloc[-1]) if len(pdf) else []
                cut = len(pdf) - int(last.sum()) if len(pdf) else 0
                ready, rest = pdf.iloc[:cut], pdf.iloc[cut:]
            if ready is not None and len(ready):
                group = np.cumsum((ready["key"].diff().fillna(1) != 0) | (ready["cell"].diff().fillna(1) != 0))
                a, b = _links_of(group.to_numpy(), ready["fp"].to_numpy(), ready["own"].to_numpy(), radius)
                if len(a):
                    yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node in links(a, b), by large-star and small-star steps."""

    def summary(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b"), "stars")
    seen = summary(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars-least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = materialize(large.distinct(), "stars-large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "stars-least")
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done, edges = edges, materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        was, seen = seen, summary(edges)
        discard(done, large)
        if was == seen:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _member_rows(docs: DataFrame, radius: int, shingle: int, segments: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, fp of every row, and its component's first row: first struct<none,doc_id,digest> by id (null last), then digest."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    classes = materialize(rows.groupBy("fp").agg(F.min(order).alias("own_first")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), radius, segments))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "own_first")
    # Classes without links name themselves; only linked ones meet their root.
    linked = named.join(roots.select("root").distinct(), "root", "left_semi")
    firsts = materialize(linked.groupBy("root").agg(F.min("own_first").alias("root_first")), "simhash-ids")
    classes = materialize(named.join(firsts, "root", "left").select("fp", F.coalesce("root_first", "own_first").alias("first")), "simhash-named")
    return rows.join(classes, "fp")


def near_components(docs: DataFrame, radius: int = 4, shingle: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id (least id that links reach)."""
    rows = _member_rows(docs, radius, shingle, segments, id_col, text_col)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, radius: int = 4, shingle: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (id and text) of each component, the first by id (null last), then digest; all columns of
    docs. Rows go by id and text, so a row is never dropped for a namesake with another text; of rows that share id and
    text one stays."""
    rows = _member_rows(docs, radius, shingle, segments, id_col, text_col)
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest"))
    return one_of_each(drop_rows(docs, rows.filter(other), id_col, text_col, "simhash-dropped"), id_col, text_col, "simhash-twins")
