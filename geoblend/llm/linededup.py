"""Line dedup by pairwise alignment: shared rare line hashes, patience diff, deletion from the later document.

Lines that one document alone has are set aside. A run of shared lines that just reaches `min_block_words` words, ending or
starting at a line, is named by the hash of its lines and looked up under its rarest line. It names one pair for each document
that has it: that document and the run's first holder (least id). So a run in k documents gives k - 1 pairs, not k
squared, whatever k is. Each line of a block that two documents share is in such a run within the block, so it
meets an earlier document that has the run in one piece, in whatever order the blocks stand. Only hashes and positions
of the pair's runs travel; texts are read again at the end.

The two sequences of a pair are aligned by patience diff: lines unique on both sides, longest increasing run of
them, extension over adjacent equal lines, the same between the anchors. Blocks contiguous on both sides with at
least `min_block_words` words are deleted from the later document. Of blocks that stand in another order an alignment keeps
some, so the runs that it left are aligned again until none is left (a run that crossing lines keep apart by itself). Lines
without words are not aligned and do not part a block: lines with words are numbered among themselves, and a deleted block
takes the blank lines inside it.

Cases: null text counts as empty; lines without words never match; rows with a null id stay whole; rows repeated
with the same id are read as one document, and lose the same lines; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, broadcast_if_small, discard, materialize

#: Deleted ranges up to which they are broadcast (some 60 bytes each with their document); beyond, texts are shuffled to them.
EDIT_LIMIT = 500_000


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) that increases in the second."""
    tails, at, back = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [y], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched index pairs of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = increasing(sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b))
        out += anchors
        if anchors:
            bounds = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(bounds, bounds[1:])]
    return sorted(out)


def _once(x: list[int], start: int, stop: int) -> dict[int, int]:
    seen: dict[int, int | None] = {}
    for i in range(start, stop):
        seen[x[i]] = None if x[i] in seen else i
    return {k: i for k, i in seen.items() if i is not None}


def common_blocks(runs: list[dict], min_words: int) -> list[tuple[int, int]]:
    """(first, last) line numbers of the later document's deleted blocks. runs: {lines, words: of the run's lines; earlier,
    later: where it starts, numbered among lines with words; pos: line numbers in the later document, start by start}."""
    a, b, todo = {}, {}, []
    for r in runs:
        size = len(r["lines"])
        for n in r["earlier"]:
            a |= {n + k: h for k, h in enumerate(r["lines"])}
        for i, n in enumerate(r["later"]):
            b |= {n + k: (h, w, p) for k, (h, w, p) in enumerate(zip(r["lines"], r["words"], r["pos"][i * size : (i + 1) * size]))}
            todo.append((n, n + size))
    todo.sort()
    earlier, gone, out = sorted(a), set(), []
    while todo:
        later = sorted({n for x, y in todo for n in range(x, y)})
        blocks: list[list[int]] = []
        last = None
        for i, j in patience([a[n] for n in earlier], [b[n][0] for n in later]):
            here = (earlier[i], later[j])
            if last != (here[0] - 1, here[1] - 1):
                blocks.append([])
            blocks[-1].append(here[1])
            last = here
        blocks = [x for x in blocks if sum(b[n][1] for n in x) >= min_words and not gone.issuperset(x)] or [list(range(*todo[0]))]
        for x in blocks:
            gone.update(x)
            out.append((b[x[0]][2], b[x[-1]][2]))
        todo = [(x, y) for x, y in todo if not gone.issuperset(range(x, y))]
    return out


def shared_runs(lines: list[dict], min_words: int) -> dict[int, tuple[int, np.ndarray, np.ndarray, list[int], list[np.ndarray]]]:
    """A document's runs of adjacent shared lines that just reach min_words, by hash: rarest line, lines, words, where they
    start, line numbers; lines: {h, words, df, at (list of {n, pos})}."""
    found: dict[int, tuple] = {}
    rows = sorted({(i["n"], x["h"], x["words"], x["df"], i["pos"]) for x in lines for i in x["at"]})
    n, h, words, df, pos = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
    starts = np.flatnonzero(np.diff(n, prepend=-2) != 1).tolist()
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        upto = [0, *accumulate(words[a:b].tolist())]
        spans = {(i, bisect_left(upto, upto[i] + min_words)) for i in range(b - a)}
        spans |= {(bisect_right(upto, upto[j] - min_words) - 1, j) for j in range(1, b - a + 1)}
        for i, j in spans:
            if i >= 0 and j <= b - a:
                i, j = a + i, a + j
                name = int.from_bytes(blake2b(h[i:j].astype("<i8").tobytes(), digest_size=8).digest(), "little", signed=True)
                if name not in found:
                    found[name] = (int(h[i + np.lexsort((h[i:j], df[i:j]))[0]]), h[i:j], words[i:j], [], [])
                found[name][3].append(int(n[i]))
                found[name][4].append(pos[i:j])
    return found


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, at {n, pos: number among the lines with a word, and among all}, h, words of the lines with a word; docs(doc_id, t)."""
    numbered = F.transform(F.split("t", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("pos")))
    written = F.filter(numbered, lambda z: F.rlike(z["line"], F.lit(WORD)))
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(written).alias("n", "z"))
    return lines.select("doc_id", F.struct("n", "z.pos").alias("at"), F.xxhash64("z.line").alias("h"), F.size(F.split(F.trim("z.line"), GAP)).alias("words"))


RUN = "line long, run long, lines array<long>, words array<long>, starts array<long>, pos array<long>"


def run_rows(common: DataFrame, min_block_words: int) -> DataFrame:
    """doc_id and RUN: a row for each document and run of it; common(doc_id, h, words, df, at)."""

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        upto = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def run(batches):
        for batch in batches:
            rows = [(k, name, *x) for k, own in enumerate(batch.column(1)) for name, x in shared_runs(own.as_py(), min_block_words).items()]
            at, names, line, h, words, starts, pos = zip(*rows) if rows else [()] * 7
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int64()), pa.array(names, pa.int64()), lists(h), lists(words), lists([np.array(x, np.int64) for x in starts]), lists([np.concatenate(x) for x in pos])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(c.split()[0] for c in RUN.split(", "))])

    own = common.groupBy("doc_id").agg(F.collect_list(F.struct("h", "words", "df", "at")).alias("lines"))
    return own.mapInArrow(run, f"doc_id {common.schema['doc_id'].dataType.simpleString()}, {RUN}")


def deleted_ranges(docs: DataFrame, min_block_words: int = 20) -> DataFrame:
    """doc_id, cuts array<struct<first,last>>, partners: one row per document that loses lines; docs(doc_id, t)."""
    # By (line, document): a line repeated in a document counts once.
    spots = materialize(line_rows(docs).groupBy("h", "doc_id").agg(F.sort_array(F.collect_set("at")).alias("at"), F.max("words").alias("words")), "line-spots")
    shared = materialize(spots.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "line-shared")
    common = spots.join(broadcast_if_small(shared, shared.count(), 500_000), "h")
    runs = materialize(run_rows(common, min_block_words), "line-runs")
    first = F.min(F.struct("doc_id", "starts")).alias("f")
    holders = runs.groupBy("line", "run").agg(first, F.count(F.lit(1)).alias("df")).filter("df > 1").select("line", "run", F.col("f.doc_id").alias("first"), F.col("f.starts").alias("earlier"))
    holders = materialize(holders, "line-holders")
    met = runs.join(broadcast_if_small(holders, holders.count(), 500_000), ["line", "run"]).filter("doc_id > first")
    pairs = met.groupBy("doc_id", "first").agg(F.collect_list(F.struct("lines", "words", "earlier", F.col("starts").alias("later"), "pos")).alias("runs"))

    def run(batches):
        for batch in batches:
            cuts = [[{"first": a, "last": b} for a, b in common_blocks(x.as_py(), min_block_words)] for x in batch.column(1)]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, kind)], names=["doc_id", "cuts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = pairs.select("doc_id", "runs").mapInArrow(run, f"doc_id {kind}, cuts array<struct<first:int,last:int>>")
    found = found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts"), F.count(F.lit(1)).cast("int").alias("partners"))
    found = materialize(found, "line-edits")
    discard(spots, shared, runs, holders)
    return found


def drop_common_blocks(docs: DataFrame, min_block_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text (what is left), n_lines, n_deleted, partners (earlier documents it overlaps)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    edits = deleted_ranges(base, min_block_words)
    ranges = edits.agg(F.sum(F.size("cuts"))).first()[0] or 0
    edits = broadcast_if_small(edits.withColumnRenamed("doc_id", "edit_id"), ranges, EDIT_LIMIT)
    rows = base.join(edits, F.col("doc_id") == F.col("edit_id"), "left").withColumn("lines", F.split("t", "\n"))
    numbered = F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.filter(numbered, lambda z: ~F.exists(F.col("cuts"), lambda c: z["i"].between(c["first"], c["last"])))
    left = F.when(F.col("cuts").isNull(), F.col("lines")).otherwise(F.transform(left, lambda z: z["x"]))
    rows = rows.select("doc_id", "t", "cuts", F.size("lines").alias("n_lines"), left.alias("left"), "partners")
    return rows.select(
        "doc_id", F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.array_join("left", "\n")).alias("text"),
        F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("left")).cast("long").alias("n_deleted"), F.coalesce("partners", F.lit(0)).alias("partners"),
    )
