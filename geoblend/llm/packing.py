"""Best-fit packing of tokenized documents by a configuration linear program.

The pieces' lengths form a histogram of at most `capacity` entries, whatever the corpus size. Over it the
configuration program (minimise sequences, cover every length's count) is solved by multiplicative weights: each
length has a weight that falls as it gets covered, and a knapsack dynamic program prices the best configurations.
The fractional multiplicities are rounded to whole ones, the program is solved again over what that leaves, and
best-fit decreasing, run on counts, places the last pieces; the plan never takes more sequences than best fit alone.
Pieces then find their place by their rank within the length, against a slot table whose size depends on the
number of lengths and solver rounds only.

Ranks never gather a length in one task: a length is dealt to salted groups whose counts are summed first.

Cases: null text counts as empty and gives one piece with the end id alone; ties and repeated rows are separate
pieces; a null doc_id is carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Split pattern of the byte-level vocabulary, part of its format.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Added token of the vocabulary: the .json lists it, the .tiktoken ranks do not. It is found inside texts.
ADDED = {"<|endoftext|>": 50256}


#: Texts with a longer run of white space, or of anything else, go to the .json: the ranks' splitter recurses on runs.
LONG_RUN = 10_000
_RUN = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_RUN}}}|[\S\x1c-\x1f]{{{LONG_RUN}}}")


class PieceTokenizer:
    """Ids of texts by a byte-level vocabulary in a tokenizers .json file.

    With its .tiktoken ranks beside it, texts without very long runs are split by those: the same ids, four times as fast.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self._one = self._whole
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens=ADDED)
            self._one = lambda text: encoding.encode(text, allowed_special="all")

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        encode = self._whole if len(text) >= LONG_RUN and _RUN.search(text) else self._one
        return np.asarray(encode(text), dtype="<u4").tobytes()


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than capacity."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary, little-endian unsigned 32-bit) per piece."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = PieceTokenizer(tokenizer, ranks)
        for batch in batches:
            for a in range(0, batch.num_rows, slice_rows):
                part = batch.slice(a, slice_rows)
                out = defaultdict(list)
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.ids(text or "") + end
                    for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        for name, v in (("row", row), ("piece", k), ("start", start), ("length", length), ("crc", zlib.crc32(own)), ("ids", own)):
                            out[name].append(v)
                cols = [part.column(0).take(pa.array(out["row"])), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(out["ids"], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


# --- the configuration program -------------------------------------------------------------------------------


def knapsack(lengths: np.ndarray, counts: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Best value within each room 0..capacity with at most `counts` of each length; the items (length index, how many
    at once: counts are split in powers of two); and per item and room whether it was taken there."""
    items = []
    for i, (w, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        n, part = min(n, capacity // w), 1
        while n > 0:
            part = min(part, n)
            items.append((i, part))
            n, part = n - part, 2 * part
    best, worth, took = np.zeros(capacity + 1), np.empty(capacity + 1), np.zeros((len(items), capacity + 1), dtype=bool)
    for k, (i, n) in enumerate(items):
        w = int(lengths[i]) * n
        here, new = best[w:], worth[w:]
        np.add(best[: capacity + 1 - w], price[i] * n, out=new)
        np.greater(new, here, out=took[k, w:])
        np.maximum(here, new, out=here)
    return best, items, took


def _filled(room: int, items: list[tuple[int, int]], took: np.ndarray, lengths: np.ndarray) -> Counter:
    got: Counter = Counter()
    k = len(items)
    while room > 0:
        at = np.flatnonzero(took[:k, room])
        if not len(at):
            break
        k = int(at[-1])
        i, n = items[k]
        got[i] += n
        room -= int(lengths[i]) * n
    return got


def solve_configurations(histogram: dict[int, int], capacity: int, step: float = 0.1, sharpness: float = 12.0, tilt: float = 1.0, slack: float = 0.005) -> list[tuple[Counter, float]]:
    """Fractional configuration program by multiplicative weights: [(configuration by length, multiplicity)].

    A length's weight is its size, raised by the share `tilt` of a factor exp(-sharpness * share of its count that
    is covered so far, relative to the least covered): sizes are the program's prices where sequences can be filled,
    and the factor keeps cover even. Each round one bounded knapsack table prices the best configuration through
    every length; those within `slack` of the best are taken, each to cover at most `step` of its scarcest length.
    Rounds end when every count is covered.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths])
    covered, taken = np.zeros(len(lengths)), defaultdict(float)
    while (covered < 1 - 1e-9).any():
        left = np.flatnonzero(covered < 1 - 1e-9)
        sizes = lengths[left]
        weight = sizes * (1 + tilt * np.exp(-sharpness * (covered[left] - covered[left].min())))
        best, items, took = knapsack(sizes, demand[left], weight, capacity)
        through = weight + best[capacity - sizes]
        order = np.argsort(-through, kind="stable")
        for k in order[: max(1, int((through >= (1 - slack) * through[order[0]]).sum()))]:
            got = _filled(capacity - int(sizes[k]), items, took, sizes)
            got[int(k)] = min(got[int(k)] + 1, int(demand[left[k]]))
            at, much = left[list(got)], np.array(list(got.values()), dtype=float)
            more = min((demand[at] / much).min() * step, ((1 - covered[at]).clip(0) * demand[at] / much).min())
            if more > 0:
                covered[at] += more * much / demand[at]
                taken[frozenset(zip(lengths[at].tolist(), much.astype(int).tolist()))] += more
    return [(Counter(dict(c)), x) for c, x in taken.items()]


def round_configurations(found: list[tuple[Counter, float]], left: dict[int, int], capacity: int, fill: float) -> list[tuple[Counter, int]]:
    """Whole multiplicities within what is left, of configurations filled to the share `fill`: multiplicities rounded
    down, then one more of those that still fit; configurations of few, so long, pieces first: they are hard to place."""
    size = lambda c: sum(k * n for k, n in c.items())
    full = sorted((x for x in found if size(x[0]) >= fill * capacity), key=lambda x: (x[0].total(), -size(x[0]), -x[1], sorted(x[0].items())))
    rest, out = Counter(left), []
    for extra in (0, 1):
        for config, much in full:
            many = min([1 if extra else int(much), *(rest[k] // n for k, n in config.items())])
            if many > 0:
                out.append((config, many))
                rest.subtract({k: n * many for k, n in config.items()})
    return out


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts: [(configuration by length, multiplicity)]."""
    bins: dict[int, list[list]] = defaultdict(list)  # by room left
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            rooms = [r for r, b in bins.items() if r >= length and b]
            if not rooms:
                each = capacity // length
                full, odd = divmod(n, each)
                if full:
                    bins[capacity - each * length].append([Counter({length: each}), full])
                if odd:
                    bins[capacity - odd * length].append([Counter({length: odd}), 1])
                break
            room = min(rooms)
            made, many = bins[room].pop()
            put = min(many, n)
            if many > put:
                bins[room].append([made, many - put])
            bins[room - length].append([made + Counter({length: 1}), put])
            n -= put
    return [(c, m) for b in bins.values() for c, m in b]


def packing_parts(histogram: dict[int, int], capacity: int, rounds: int = 2, fills: tuple[float, ...] = (1.0, 0.995)) -> tuple[list[tuple[Counter, int]], list[tuple[Counter, int]]]:
    """Whole configurations that hold the histogram exactly: those of the program, and those of best fit.

    The program is solved and rounded, and again over what rounding left, up to `rounds` times, for configurations
    filled to each of the shares `fills`; best fit places the rest. Rounded configurations are kept up to where the
    whole takes fewest sequences, and as far as possible among equals: in the worst case that is best fit alone, so
    the plan never takes more sequences than that.
    """
    whole = [(Counter({capacity: 1}), histogram[capacity])] if histogram.get(capacity) else []
    short = {k: n for k, n in histogram.items() if 0 < k < capacity and n > 0}
    if not short:
        return whole, []
    first, plans = solve_configurations(short, capacity), [([], best_fit(short, capacity))]
    for fill in fills:
        taken, ends, left, found = [], set(), short, first
        for i in range(rounds):
            if i:
                found = solve_configurations(left, capacity)
            taken = taken + round_configurations(found, left, capacity, fill)
            left = _less(short, taken)
            ends |= {len(taken)} if i else {len(taken) * k // 8 for k in range(1, 9)}
            if not left:
                break
        plans += [(taken[:n], best_fit(_less(short, taken[:n]), capacity)) for n in sorted(ends) if n]
    placed = lambda p: sum(c.total() * m for c, m in p[0])
    program, rest = min(plans, key=lambda p: (sum(m for part in p for _, m in part), -placed(p)))
    return whole + program, rest


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    program, rest = packing_parts(histogram, capacity)
    return program + rest


def _less(histogram: dict[int, int], plan: list[tuple[Counter, int]]) -> dict[int, int]:
    left = Counter(histogram)
    for config, many in plan:
        left.subtract({k: n * many for k, n in config.items()})
    return {k: n for k, n in left.items() if n > 0}


def slot_table(plan: list[tuple[Counter, int]]) -> pd.DataFrame:
    """length, start (rank within the length), each, first (sequence), offset: one row per configuration and length."""
    used: Counter = Counter()
    first, rows = 0, []
    for config, many in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            rows.append((length, used[length], config[length], first, offset))
            used[length] += many * config[length]
            offset += length * config[length]
        first += many
    return pd.DataFrame(rows, columns=["length", "start", "each", "first", "offset"]).sort_values(["length", "start"], ignore_index=True)


def place_pieces(pieces: DataFrame, capacity: int = 1024, group_rows: int = 20_000) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset. pieces must be a written table: it is read twice. Pieces of
    one length are ranked in groups dealt by all columns, so rows that share an id do not meet in one group."""
    salts = max(64, -(-pieces.count() // group_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(plan_packing(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", *(c for c in pieces.columns if c not in ("doc_id", "piece")))
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(counts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    keys = slots["length"].to_numpy(dtype=np.int64) * (1 << 44) + slots["start"].to_numpy(dtype=np.int64)
    table = {c: slots[c].to_numpy(dtype=np.int64) for c in slots}
    names = [c for c in pieces.columns]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            nth = rank - table["start"][at]
            sequence = table["first"][at] + nth // table["each"][at]
            offset = table["offset"][at] + nth % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless in its sequence)."""
    pieces = materialize(tokenize_pieces(docs, tokenizer, ranks, capacity, end_id, id_col=id_col, text_col=text_col), "pack-pieces")
    return place_pieces(pieces, capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences: sequence_id, input_ids array<int>, spans (doc_id, piece, offset, length), for a table placed from pack()."""
    ids = tokenize_pieces(docs, tokenizer, ranks, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece"])
    joined = ids.join(placed, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("parts"))

    def run(batches):
        for pdf in batches:
            own = [np.frombuffer(b"".join(p["ids"] for p in x), dtype="<u4").astype(np.int32) for x in pdf["parts"]]
            spans = [[{k: p[k] for k in ("doc_id", "piece", "offset", "length")} for p in x] for x in pdf["parts"]]
            yield pd.DataFrame({"sequence_id": pdf["sequence_id"], "input_ids": own, "spans": spans})

    kind = placed.schema["doc_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"sequence_id long, input_ids array<int>, spans array<struct<doc_id:{kind},piece:int,offset:long,length:long>>")
