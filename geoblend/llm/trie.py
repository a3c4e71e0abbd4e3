"""Conversation prefix trie with counts, leaves and the tokens that shared prefixes save.

A node is a distinct sequence of first turns; its name is a 128-bit digest chained over (role, text) digests, so only
16 bytes and a word count travel for a turn. Stages: (1) each conversation becomes a path of node digests; (2) nodes
with over `limit` members are found by partial counts: there are at most rows / limit of them; (3) the trie is cut
below these, so that every subtree has at most `limit` members, and subtrees are dealt to shards of bounded size; the
nodes above are cut again at limit * GROWTH members, and so on in rounds; (4) a shard enumerates its distinct digests, a
minimal perfect hash gives each a slot, which holds the digest for verification; counts are scattered into flat arrays
by slot and summed through the array of parent slots in order of depth; (5) the sums of the cut roots reach their
parents, grouped, in the next round.

No group is held whole: a first turn that all conversations share is one row of counts in a later round. The SHA-256
of a node's ending members needs their ids in order, so ids are range-sorted, joined to texts of at most CHUNK ids
where they lie, and only these texts meet (one digest cannot be had in parts).

Cases: null role or text is empty; a null turn comes first; equal turn numbers are ordered by role, then by the digest
of role and text; rows with a null conv_id form no conversation; an empty table gives an empty result. A conversation
is held as one row of some 24 bytes a turn.
"""

from __future__ import annotations

import math
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, broadcast_if_small, materialize

#: Members of a subtree that stays in one shard, and what a later round multiplies that by.
LIMIT = 10_000
GROWTH = 1_000
#: Path rows that one shard gets on average.
SHARD_ROWS = 200_000
#: Ids in one text of a node's ending members.
CHUNK = 50_000
#: Nodes over LIMIT up to which they are broadcast (some 40 bytes each).
UPPER_LIMIT = 500_000


class NodeTable:
    """Minimal perfect hash of distinct (hi, lo) digests: in each level the digests alone in their bit get it; a digest's
    slot is the rank of its bit. Slots hold the digests, so a lookup of another digest is seen and gives -1."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, load: float = 2.0):
        self.levels, rest, base = [], np.arange(len(hi)), 0
        slot = np.full(len(hi), -1, dtype=np.int64)
        while len(rest):
            bits = max(1, int(load * len(rest)))
            at = self._bit(hi[rest], lo[rest], len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = base + np.cumsum(alone) - 1
            placed = alone[at]
            slot[rest[placed]] = rank[at[placed]]
            self.levels.append((bits, alone, rank))
            base += int(alone.sum())
            rest = rest[~placed]
        self.slot = slot
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[slot], self.lo[slot] = hi, lo

    @staticmethod
    def _bit(hi: np.ndarray, lo: np.ndarray, level: int, bits: int) -> np.ndarray:
        x = hi.view(np.uint64) ^ (lo.view(np.uint64) + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(bits)).astype(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that are not in the table."""
        out = np.full(len(hi), -1, dtype=np.int64)
        rest = np.arange(len(hi))
        for level, (bits, alone, rank) in enumerate(self.levels):
            at = self._bit(hi[rest], lo[rest], level, bits)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        found = out >= 0
        right = np.zeros(len(hi), dtype=bool)
        right[found] = (self.hi[out[found]] == hi[found]) & (self.lo[out[found]] == lo[found])
        return np.where(right, out, -1)


ROOT = (0, 0)


def rebuilt_turns(rows: DataFrame, base_of, heads_of, most: int) -> DataFrame:
    """conv_id, turns array<struct<digest,words>>: the first heads_of(conv_id) turns (an int, at most `most`) of conversation
    base_of(conv_id), then the own turns after as many; rows(conv_id, turn, role, digest, words)."""
    order = F.struct(F.col("turn"), "role", "digest", "words")
    turns = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    turns = materialize(turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")), "trie-turns")
    heads = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = turns.withColumn("base", base_of(F.col("conv_id"))).withColumn("h", heads_of(F.col("conv_id")))
    met = own.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (16 bytes of role and text), words of every row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.size(F.filter(F.split(text, GAP), lambda w: w != ""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), words.cast("long").alias("words"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, hi, lo, words: digest halves of the nodes below the root on the way of each conversation."""

    def run(batches):
        for batch in batches:
            digests, words, sizes = [], [], [0]
            for row in batch.column(1).to_pylist():
                name = b""
                for t in row:
                    name = blake2b(name + t["digest"], digest_size=16).digest()
                    digests.append(name)
                    words.append(t["words"])
                sizes.append(len(digests))
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (halves[:, 0].copy(), halves[:, 1].copy(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["conv_id", "hi", "lo", "words"])

    return turns.select("conv_id", "turns").mapInArrow(run, "conv_id long, hi array<long>, lo array<long>, words array<long>")


PATH_ROWS = "cut boolean, round int, shard int, hi long, lo long, up_hi long, up_lo long, up_conv long, depth long, words long, conv_id long"


def _path_rows(total: int, least: int, shards: int, limit: int, growth: int):
    """A row per conversation and node below the root: the node's parent, its round, and the shard of its subtree; cut where
    the parent is of a later round, whose least member is then up_conv (marks: depth, members and least member of the nodes over
    the limit)."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, hi, lo, words, marks in zip(*(c.to_pylist() for c in batch.columns)):
                members = {m["depth"]: (m["n"], m["conv"]) for m in marks or ()}
                up, up_round, root = (*ROOT, least), _round(total, limit, growth), None
                for d, (h, l, w) in enumerate(zip(hi, lo, words), 1):
                    n, first = members.get(d, (0, None))
                    own = _round(n, limit, growth)
                    cut = own < up_round
                    root = (h, l) if cut else root or ROOT
                    out.append((cut, own, (root[0] & 0x7FFFFFFF) % shards, h, l, up[0], up[1], up[2] if cut else 0, d, w, conv))
                    up, up_round = (h, l, first), own
            names = [x.split()[0] for x in PATH_ROWS.split(", ")]
            kinds = [pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 8]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _round(members: int, limit: int, growth: int) -> int:
    """The round whose subtrees hold a node of so many members."""
    r = 0
    while members > limit:
        r, limit = r + 1, limit * growth
    return r


SUMS = "n_children long, n_leaves long, saved_tokens long"


def _accumulate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Children, leaves and saved tokens of a shard's nodes; sums from cut subtrees below are in below_*."""
    hi, lo = pdf["hi"].to_numpy(), pdf["lo"].to_numpy()
    table = NodeTable(hi, lo)
    slot, n = table.slot, len(pdf)
    parent = np.full(n, -1, dtype=np.int64)
    parent[slot] = table.find(pdf["up_hi"].to_numpy(), pdf["up_lo"].to_numpy())
    parent[slot[pdf["cut"].to_numpy()]] = -1

    def scatter(values) -> np.ndarray:
        flat = np.zeros(n, dtype=np.int64)
        flat[slot] = values
        return flat

    depth, conv = scatter(pdf["depth"]), scatter(pdf["conv_id"])
    inner = parent >= 0
    children = scatter(pdf["below_children"]) + np.bincount(parent[inner], minlength=n)
    leaves = scatter(pdf["below_leaves"]) + (children == 0)
    saved = scatter(pdf["below_saved"]) + scatter((pdf["n_convs"] - 1) * pdf["words"])
    order = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order], append=-1)) + 1
    for at in np.split(order, ends[:-1]):
        at = at[inner[at]]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    above = parent[slot]
    up = np.where(above >= 0, conv[above], pdf["up_conv"].to_numpy())
    return pd.DataFrame({
        "hi": hi, "lo": lo, "up_hi": pdf["up_hi"], "up_lo": pdf["up_lo"], "cut": pdf["cut"], "conv_id": pdf["conv_id"], "depth": pdf["depth"],
        "parent_conv_id": up, "n_convs": pdf["n_convs"], "n_children": children[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot],
    })


def ending_digests(ends: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the nodes where conversations end; ends(hi, lo, conv_id)."""

    def joined(batches):
        at, ids = None, []
        for batch in batches:
            out = []
            for hi, lo, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) != at or len(ids) == CHUNK:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = (hi, lo), []
                ids.append(conv)
            yield part(out)
        yield part([(*at, ids[0], ",".join(map(str, ids)))] if ids else [])

    def part(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hi", "lo", "first", "ids"])

    def hashed(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) == at:
                    state.update(b"," + ids.encode())
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (hi, lo), sha256(ids.encode())
            yield done(out)
        yield done([(*at, state.hexdigest())] if at is not None else [])

    def done(rows):
        kinds = [pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hi", "lo", "ends_sha256"])

    key = ["hi", "lo", "conv_id"]
    texts = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(joined, "hi long, lo long, first long, ids string")
    texts = texts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first")
    return texts.select("hi", "lo", "ids").mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, limit: int = LIMIT, growth: int = GROWTH) -> DataFrame:
    """One row per node; turns(conv_id, turns array<struct<digest,words>>), a row per conversation."""
    ways = materialize(paths(turns), "trie-paths")
    sizes = ways.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum(F.size("hi")).alias("rows")).first()
    total, least, rows = sizes["n"], sizes["least"], sizes["rows"] or 0
    top = _round(total, limit, growth)
    each = ways.select("conv_id", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "z")).select("conv_id", (F.col("at") + 1).alias("depth"), "z.hi", "z.lo")
    upper = each.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).filter(F.col("n") > limit)
    upper = materialize(upper, "trie-upper")
    n_upper = upper.count()
    if n_upper:
        marks = each.join(broadcast_if_small(upper, n_upper, UPPER_LIMIT), ["hi", "lo"]).groupBy("conv_id").agg(F.collect_list(F.struct("depth", "n", "conv")).alias("marks"))
        marked = ways.join(marks, "conv_id", "left")
    else:
        marked = ways.withColumn("marks", F.lit(None).cast("array<struct<depth:int,n:long,conv:long>>"))
    shards = max(1, math.ceil(rows / SHARD_ROWS))
    expanded = marked.select("conv_id", "hi", "lo", "words", "marks").mapInArrow(_path_rows(total, least, shards, limit, growth), PATH_ROWS)
    same = [F.min(c).alias(c) for c in ("cut", "round", "shard", "up_hi", "up_lo", "up_conv", "depth", "words", "conv_id")]
    nodes = expanded.groupBy("hi", "lo").agg(*same, F.count(F.lit(1)).alias("n_convs"))
    root = turns.sparkSession.createDataFrame([(*ROOT, True, top, 0, *ROOT, -1, 0, 0, least, total)] if total else [], nodes.schema)
    nodes = materialize(nodes.union(root), "trie-nodes")
    result = "hi long, lo long, up_hi long, up_lo long, cut boolean, conv_id long, depth long, parent_conv_id long, n_convs long, " + SUMS
    below, done = None, []
    for r in range(top + 1):
        own = nodes.filter(F.col("round") == r)
        if below is None:
            own = own.withColumns({f"below_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            own = own.join(below, ["hi", "lo"], "left").fillna(0, [f"below_{c}" for c in ("children", "leaves", "saved")])
        done.append(materialize(own.groupBy("shard").applyInPandas(_accumulate, result), "trie-sums"))
        sent = done[-1].filter("cut").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"))
        sent = sent.agg(F.count(F.lit(1)).alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
        below = sent if below is None else below.union(sent).groupBy("hi", "lo").agg(*[F.sum(c).alias(c) for c in ("below_children", "below_leaves", "below_saved")])
    summed = done[0]
    for df in done[1:]:
        summed = summed.union(df)
    last = F.size("hi")
    ends = ways.select(F.when(last > 0, F.get("hi", last - 1)).otherwise(0).alias("hi"), F.when(last > 0, F.get("lo", last - 1)).otherwise(0).alias("lo"), "conv_id")
    met = summed.join(ending_digests(ends), ["hi", "lo"], "left")
    return met.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
