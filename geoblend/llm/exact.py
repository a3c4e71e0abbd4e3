"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Stages: (1) one scan gives each row a 64-bit fingerprint and a SHA-256; (2) rows are dealt to blocks by a hash of
id and fingerprint, each block sorts its distinct fingerprints and sends every owner (a range of fingerprint
values) one Golomb-Rice coded gap list; (3) an owner decodes its lists and answers each with a bitmap of the
fingerprints that another block holds too; (4) blocks turn bitmaps, and what was repeated within the block, into
suspect fingerprints; (5) only rows with a suspect fingerprint have their text grouped byte by byte.

Rows of a block and fingerprint are counted before they meet, so a group of copies costs an owner at most one entry
per block; the byte check is a grouping with partial aggregation, so no task gathers a group. Where there are many
blocks, they come in families of FAMILY over a coarse range of fingerprints, with as many owners of their own: the
lists then grow with the rows, not with the square of the blocks. Verdicts of groups over HOT_GROUP rows reach their
rows by a broadcast (there are at most rows / HOT_GROUP of them), the others by a shuffle.

Cases: null text counts as empty; rows with a null doc_id take part like others and are never the kept row unless
all of the group's ids are null; repeated rows count once each in group_size, and where the kept id has several rows of the
text one of them is kept, so each text has exactly one kept row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_rows, materialize, one_of_each, shuffle_width

#: Fingerprints that one block or owner holds at most, on average.
BLOCK_ROWS = 1_000_000
#: Blocks that exchange lists with each other.
FAMILY = 64
#: Distinct suspect fingerprints up to which they are broadcast (8 bytes each); beyond, the join shuffles.
SUSPECT_LIMIT = 1_000_000
#: Groups of copies up to which all are broadcast (some 150 bytes each); beyond, only those over HOT_GROUP rows.
GROUP_LIMIT = 200_000
HOT_GROUP = 1_000_000


def golomb_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of non-negative gaps: (k, unary part of gap >> k, packed k-bit remainders)."""
    if not len(gaps):
        return 0, b"", b""
    mean = max(1.0, float(gaps.astype(np.float64).mean()))
    k = max(0, int(math.log2(mean * math.log(2))) if mean * math.log(2) >= 1 else 0)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.uint64(0)
    return (quotient.astype(np.uint64) << np.uint64(k)) + low


def _owner_of(fingerprints: np.ndarray, owners: int) -> np.ndarray:
    return ((fingerprints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _owner_base(owner: int, owners: int) -> int:
    """Least value of an owner's range."""
    return -(-(owner << 32) // owners) << 32


def _values(owner: int, owners: int, n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    return np.cumsum(golomb_decode(n, k, unary, rest), dtype=np.uint64) + np.uint64(_owner_base(owner, owners))


def _block_encoder(owners: int):
    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(values)
        values, counts = values[order], pdf["rows"].to_numpy(dtype=np.int64)[order]
        owner = _owner_of(values, owners).astype(np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            part = values[a:b] - np.uint64(_owner_base(int(owner[a]), owners))
            k, unary, rest = golomb_encode(np.diff(part, prepend=np.uint64(0)))
            twice = np.packbits((counts[a:b] > 1).astype(np.uint8)).tobytes()
            out.append((int(key[0]), int(owner[a]), b - a, k, unary, rest, twice))
        return pd.DataFrame(out, columns=["block", "owner", "n", "k", "unary", "rest", "twice"])

    return encode


def _owner_answer(owners: int):
    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        owner = int(key[0])
        lists = [_values(owner, owners, r.n, r.k, r.unary, r.rest) for r in pdf.itertuples()]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[counts > 1]
        bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True).astype(np.uint8)).tobytes() for x in lists]
        return pd.DataFrame({"block": pdf["block"], "owner": owner, "bitmap": bitmaps})

    return answer


def _suspects(owners: int):
    def expand(batches):
        for pdf in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for r in pdf.itertuples():
                marks = np.frombuffer(r.twice, dtype=np.uint8) | np.frombuffer(r.bitmap, dtype=np.uint8)
                marks = np.unpackbits(marks)[: r.n].astype(bool)
                if marks.any():
                    found.append(_values(r.owner, owners, r.n, r.k, r.unary, r.rest)[marks])
            yield pd.DataFrame({"fp": np.unique(np.concatenate(found)).view(np.int64)})

    return expand


def suspect_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) held by two or more rows of fps(fp, salt)."""
    width = max(shuffle_width(fps.sparkSession), math.ceil(fps.count() / BLOCK_ROWS))
    own = min(width, FAMILY)
    families = math.ceil(width / own)
    owners = families * own
    family = F.shiftright(F.shiftrightunsigned("fp", 32) * F.lit(families).cast("long"), 32)
    block = (family * own + F.pmod("salt", F.lit(own))).cast("int")
    lists = materialize(
        fps.select(block.alias("block"), "fp").groupBy("block", "fp").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("block")
        .applyInPandas(_block_encoder(owners), "block int, owner int, n int, k int, unary binary, rest binary, twice binary"),
        "exact-lists",
    )
    bitmaps = (
        lists.select("block", "owner", "n", "k", "unary", "rest")
        .groupBy("owner")
        .applyInPandas(_owner_answer(owners), "block int, owner int, bitmap binary")
    )
    return lists.join(bitmaps, ["block", "owner"]).mapInPandas(_suspects(owners), "fp long").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialize(base.select("doc_id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("text_sha256"), F.xxhash64("doc_id", "t").alias("salt"), F.monotonically_increasing_id().alias("row")), "exact-rows")
    suspects = materialize(suspect_fingerprints(rows.select("fp", "salt")), "exact-suspects")
    suspects = broadcast_if_small(suspects, suspects.count(), SUSPECT_LIMIT)
    verified = (
        base.withColumn("fp", F.xxhash64("t"))
        .join(suspects, "fp", "left_semi")
        .groupBy("t")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # One row of the greatest id; numbers are of the written rows, so they stay.
    keepers = rows.join(suspects, "fp", "left_semi").groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keeper"))
    verified = materialize(verified.join(keepers.select("text_sha256", F.col("keeper.row").alias("keep_row")), "text_sha256"), "exact-groups")
    n = verified.count()
    hot = verified if n <= GROUP_LIMIT else materialize(verified.filter(F.col("group_size") > HOT_GROUP), "exact-hot")
    met = rows.join(F.broadcast(hot), "text_sha256", "left")
    if n > GROUP_LIMIT:
        rest = rows.join(F.broadcast(hot), "text_sha256", "left_anti")
        met = met.filter("group_size is not null").union(rest.join(verified, "text_sha256", "left").select(*met.columns))
    return met.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, of the greatest id (null last); all columns of docs. Rows go by id and text: an id, or
    the null id, may also stand at another text, which stays; of rows that share id and text one stays."""
    groups = exact_groups(docs, id_col, text_col)
    dropped = groups.filter("not kept and not doc_id <=> keep_id").select("doc_id", F.substring("text_sha256", 1, 32).alias("digest"))
    return one_of_each(drop_rows(docs, dropped, id_col, text_col, "exact-dropped"), id_col, text_col, "exact-twins")
