"""Substring dedup: words of windows that start at two or more places of the corpus go, by super-k-mer partitioning.

A window is `window` consecutive words; its minimiser is the word run of length `mer` with the least hash inside it (the
leftmost of equals, so windows of equal words have it at the same place). Consecutive windows with their minimiser at
one place make a super-k-mer: it holds each window once and travels as one packed string (its words, space-joined) to
the bucket of its minimiser, where all windows equal to one of its own arrive as well.

Stages: (1) one scan gives each text its digest and minimisers, texts are taken once (copies are counted: all windows
of a text that occurs twice are repeated); (2) minimisers that occur once in the corpus are set aside, as no window of
theirs is repeated, so only strings that may matter travel; (3) a task packs these, each distinct string once with its
number, and keeps light rows of where it stood; (4) buckets sort the windows of their strings and count equal ones
byte by byte; (5) answers go back to the light rows, and texts lose the covered words in a last scan.

Hot data: equal strings are added up in the task that packs them; minimisers with over HOT distinct rows have their
windows counted one by one by a grouping with partial sums, on 128-bit digests, so no bucket holds more than HOT strings.
Joins with a hot key have it on one side only, which adaptive skew joins split.

Cases: null text has no words; texts shorter than a window lose nothing; rows with null or repeated ids get their own
text's result; equal texts, empty ones aside, are repeats of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialize, text_digest

#: Packed rows of one minimiser that one bucket holds; beyond, its windows are counted singly.
HOT = 500
#: Bytes of distinct strings that a packing task holds before it sends them on.
HELD = 32 << 20
#: Rows that a packing task sends at once.
SENT = 20_000
#: Windows whose minimisers are found at once; positions in a stretch fit POSITION's bits.
STRETCH = 1 << 19
POSITION = np.uint64((1 << 20) - 1)
#: Repeated minimisers or windows (16 bytes each) and cut ranges (some 60 bytes each) up to which they are broadcast.
REPEAT_LIMIT = 500_000
EDIT_LIMIT = 500_000


def super_mers(words: list[bytes], window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each run of windows that share a minimiser's place."""
    windows = len(words) - window + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    runs = np.zeros(len(h) - mer + 1, dtype=np.uint64)
    for j in range(mer):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(runs)]
    runs ^= runs >> np.uint64(32)
    runs *= np.uint64(0xD6E8FEB86659FD93)
    runs ^= runs >> np.uint64(29)
    span, place = window - mer + 1, np.empty(windows, dtype=np.int64)
    for a in range(0, windows, STRETCH):
        part = runs[a : min(a + STRETCH, windows) + span - 1]
        least, width = (part & ~POSITION) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :])
        place[a : a + len(least)] = (least & POSITION).astype(np.int64) + a
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.diff(first, append=windows), runs[place[first]].view(np.int64)


def window_cuts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a packed string begin and end."""
    gaps = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(packed)]])


def windows_of(packed: bytes, window: int) -> list[bytes]:
    begin, end = window_cuts(packed)
    return [packed[a:b] for a, b in zip(begin[: len(begin) - window + 1].tolist(), end[window - 1 :].tolist())]


def repeated_windows(strings: list[tuple[bytes, int]], window: int) -> list[np.ndarray]:
    """For each (packed string, times it occurs): which of its windows occur twice or more in all of them."""
    if len(strings) == 1:
        packed, times = strings[0]
        return [np.full(len(window_cuts(packed)[0]) - window + 1, times > 1)]
    rows = [(w, k, i) for k, (packed, _) in enumerate(strings) for i, w in enumerate(windows_of(packed, window))]
    marks = [np.zeros(len(window_cuts(packed)[0]) - window + 1, dtype=bool) for packed, _ in strings]
    rows.sort()
    start = 0
    for stop in range(1, len(rows) + 1):
        if stop == len(rows) or rows[stop][0] != rows[start][0]:
            if stop - start > 1 or strings[rows[start][1]][1] > 1:
                for _, k, i in rows[start:stop]:
                    marks[k][i] = True
            start = stop
    return marks


def covered(marks: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) that the marked windows cover, adjacent ones joined."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return [(int(a), int(b) + window - 1) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


def _text_minimisers(window: int, mer: int):
    def run(batches):
        for batch in batches:
            sizes, mins = [], []
            for t in batch.column(1):
                words = t.as_buffer().to_pybytes().split()
                sizes.append(len(words))
                mins.append(super_mers(words, window, mer)[2])
            flat = np.concatenate([np.zeros(0, np.int64), *mins])
            upto = np.cumsum([0, *map(len, mins)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists], names=["digest", "n_words", "mins"])

    return run


PACKED = "m long, string_id binary, digest string, start int, times long, packed binary"


def _pack(window: int, mer: int):
    """Rows of where each super-k-mer stood, and rows of distinct strings with the times that the task met them."""

    def strings(held):
        rows = [(m, blake2b(packed, digest_size=16).digest(), None, None, times, packed) for packed, (m, times) in held.items()]
        return _batch(rows)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            rows = []
            for digest, t, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = t.as_buffer().to_pybytes().split()
                first, count, mins = super_mers(words, window, mer)
                for k in np.flatnonzero(np.isin(mins, asked.values.to_numpy())).tolist():
                    a = int(first[k])
                    packed = b" ".join(words[a : a + int(count[k]) + window - 1])
                    rows.append((int(mins[k]), blake2b(packed, digest_size=16).digest(), digest, a, None, None))
                    was = held.get(packed)
                    held[packed] = (int(mins[k]), was[1] + 1 if was else 1)
                    size += 0 if was else len(packed) + 150
                if size > HELD:
                    yield strings(held)
                    held, size = {}, 0
                if len(rows) > SENT:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        yield strings(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["m", "string_id", "digest", "start", "times", "packed"])


def _count_buckets(window: int):
    """Rows (m, string_id, times, packed) sorted by m: word ranges of each string that repeated windows cover."""

    def answer(bucket: dict) -> list[tuple]:
        strings = list(bucket.items())
        marks = repeated_windows([(packed, times) for packed, (_, times) in strings], window)
        return [(string_id, a, b) for (_, (string_id, _)), mark in zip(strings, marks) if mark.any() for a, b in covered(mark, window)]

    def send(rows):
        kinds = [pa.binary(), pa.int32(), pa.int32()]
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["string_id", "a", "b"])

    def run(batches):
        at, bucket = None, {}
        for batch in batches:
            out = []
            for m, string_id, times, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if m != at:
                    if bucket:
                        out += answer(bucket)
                    at, bucket = m, {}
                bucket[packed] = (string_id, bucket[packed][1] + times if packed in bucket else times)
            yield send(out)
        yield send(answer(bucket) if bucket else [])

    return run


def _single_windows(window: int):
    def run(batches):
        for batch in batches:
            rows = [
                (blake2b(w, digest_size=16).digest(), string_id, i, times)
                for string_id, times, packed in zip(*(c.to_pylist() for c in batch.columns)) for i, w in enumerate(windows_of(packed, window))
            ]
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["window_id", "string_id", "i", "times"])

    return run


def string_answers(packed: DataFrame, window: int) -> DataFrame:
    """string_id, a, b: word ranges of distinct strings that repeated windows cover; packed(m, string_id, times, packed)."""
    hot = materialize(packed.groupBy("m").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT).select("m"), "substring-hot")
    n_hot = hot.count()
    cold = packed.join(broadcast_if_small(hot, n_hot, REPEAT_LIMIT), "m", "left_anti") if n_hot else packed
    dealt = cold.select("m", "string_id", "times", "packed").repartition("m").sortWithinPartitions("m")
    answers = dealt.mapInArrow(_count_buckets(window), "string_id binary, a int, b int")
    if not n_hot:
        return answers
    # Equal strings of several tasks are one string here.
    singles = packed.join(broadcast_if_small(hot, n_hot, REPEAT_LIMIT), "m", "left_semi").groupBy("string_id", "packed").agg(F.sum("times").alias("times"))
    singles = singles.select("string_id", "times", "packed").mapInArrow(_single_windows(window), "window_id binary, string_id binary, i int, times long")
    singles = materialize(singles, "substring-singles")
    repeated = materialize(singles.groupBy("window_id").agg(F.sum("times").alias("n")).filter("n > 1").select("window_id"), "substring-windows")
    met = singles.join(broadcast_if_small(repeated, repeated.count(), REPEAT_LIMIT), "window_id")
    return answers.union(met.select("string_id", F.col("i").alias("a"), (F.col("i") + window).alias("b")))


def repeated_ranges(docs: DataFrame, window: int = 35, mer: int = 8) -> DataFrame:
    """digest, cuts array<struct<a,b>> of the texts that lose words (word ranges, which may overlap); docs(digest, t)."""
    mer = min(mer, window)
    own = docs.mapInArrow(_text_minimisers(window, mer), "digest string, n_words int, mins array<long>").filter(F.col("n_words") >= window)
    texts = materialize(own.groupBy("digest").agg(F.first("n_words").alias("n_words"), F.first("mins").alias("mins"), F.count(F.lit(1)).alias("copies")), "substring-texts")
    repeated = texts.select(F.explode("mins").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m")
    repeated = materialize(repeated, "substring-minimisers")
    asked = texts.select("digest", F.explode(F.array_distinct("mins")).alias("m")).join(broadcast_if_small(repeated, repeated.count(), REPEAT_LIMIT), "m")
    asked = asked.groupBy("digest").agg(F.collect_list("m").alias("asked"))
    whole = docs.groupBy("digest").agg(F.first("t").alias("t")).join(asked, "digest").select("digest", "t", "asked")
    rows = materialize(whole.mapInArrow(_pack(window, mer), PACKED), "substring-strings")
    answers = materialize(string_answers(rows.filter("packed is not null").select("m", "string_id", "times", "packed"), window), "substring-answers")
    stood = rows.filter("packed is null").select("string_id", "digest", "start")
    cuts = stood.join(broadcast_if_small(answers, answers.count(), EDIT_LIMIT), "string_id").select("digest", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    cuts = cuts.union(texts.filter("copies > 1").select("digest", F.lit(0), "n_words"))
    found = materialize(cuts.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "substring-cuts")
    discard(texts, repeated, rows, answers)
    return found


def _left(batches):
    for batch in batches:
        sizes, gone, kept = [], [], []
        for t, cuts in zip(batch.column(1), batch.column(2)):
            words = t.as_buffer().to_pybytes().split()
            keep = np.ones(len(words), dtype=bool)
            for c in cuts.as_py() or ():
                keep[c["a"] : c["b"]] = False
            sizes.append(len(words))
            gone.append(len(words) - int(keep.sum()))
            kept.append(b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])


def drop_repeated_windows(docs: DataFrame, window: int = 35, mer: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text (the kept words, joined by a space), n_words, n_removed."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("digest", text_digest(F.col("t")))
    cuts = repeated_ranges(base.select("digest", "t"), window, mer)
    ranges = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    rows = base.join(broadcast_if_small(cuts, ranges, EDIT_LIMIT), "digest", "left").select("doc_id", "t", "cuts")
    return rows.mapInArrow(_left, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, n_words long, n_removed long")
