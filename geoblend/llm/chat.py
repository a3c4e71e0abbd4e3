"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, adjacent turns of a role merged into one block (a slice of
the turns between two changes of role), and the blocks concatenated:

    <s>[INST]role[/INST]text<s>text</s>   a block of a role; <s> inside a block parts turns merged into it

Control strings (<s>, </s>, [INST], [/INST]) inside roles and texts are escaped by a backslash after their first
character, and backslashes are doubled, so that reading back gives the turns exactly. The loss mask is the list of
spans of assistant texts in the formatted string.

Cases: null text and null role count as empty; turns are ordered by (turn, role, text), null turns first, so ties
and repeated rows have a defined place and all stay; a null conv_id is one conversation; no rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE, PART = "<s>[INST]", "[/INST]", "</s>", "<s>"
#: What follows the first character of a control string.
TAIL = r"(/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])" + TAIL, r"$1\\$2")


def unescape(c: Column) -> Column:
    opened = F.regexp_replace(c, r"([<\[])\\" + TAIL, "$1$2")
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


#: Spans that are placed, or cut out, by one running scan; arrays that grow item by item stay this short.
CHUNK = 64


def _chunked(array: str) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(CHUNK))
    return F.transform(starts, lambda at: F.slice(array, at, F.lit(CHUNK)))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start:int,length:int>> (characters, from 0) of rows(conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Where a turn's role differs from the one before, a block starts: an index test for each turn, then slices.
    opens = lambda t, i: (i == 0) | (t["role"] != F.get("turns", i - 1)["role"])
    first = F.filter(F.transform("turns", lambda t, i: F.when(opens(t, i), i)), lambda i: i.isNotNull())
    chats = chats.withColumn("first", first)
    ends = F.concat(F.slice("first", F.lit(2), F.size("first") - 1), F.array(F.size("turns")))
    block = lambda a, z: F.struct(F.get("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, z - a), lambda t: escape(t["text"])).alias("texts"))
    chats = chats.select("conv_id", F.zip_with("first", ends, block).alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(MID))
    piece = lambda b: F.concat(head(b), F.array_join(b["texts"], PART), F.lit(CLOSE))

    def lengths(b: Column) -> Column:
        """Of each text in a block: characters before it since the text before, its own, and whether it is under the mask."""
        own = F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(head(b))).otherwise(len(PART)).alias("gap"), F.length(t).alias("length"), (b["role"] == loss_role).alias("loss")))
        return F.concat(own, F.array(F.struct(F.lit(len(CLOSE)).alias("gap"), F.lit(0).alias("length"), F.lit(False).alias("loss"))))

    chats = chats.select("conv_id", F.array_join(F.transform("blocks", piece), "").alias("formatted"), F.flatten(F.transform("blocks", lengths)).alias("parts"))
    # Running offsets in two levels: of chunks of parts, then within each chunk.
    chats = chats.withColumn("chunks", _chunked("parts"))
    sums = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["length"]))
    offsets = F.aggregate(sums, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    chats = chats.withColumn("offsets", offsets)
    span = "struct<start:int,length:int>"

    def place(chunk: Column, i: Column) -> Column:
        state = F.struct(F.get("offsets", i).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

        def one(a: Column, x: Column) -> Column:
            own = F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["length"].alias("length")))
            return F.struct((a["at"] + x["gap"] + x["length"]).alias("at"), F.when(x["loss"], F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(chunk, state, one, lambda a: a["spans"])

    return chats.select("conv_id", "formatted", F.flatten(F.transform("chunks", place)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), MID, 1)
        texts = F.split(F.substr(block, F.length(role) + len(OPEN) + len(MID) + 1), PART, -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted strings and masks."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), "loss_spans")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # Spans are cut out of the stretch that a chunk of them covers, not each from the start of the string.
    back = back.withColumn("chunks", _chunked("loss_spans"))

    def cut(chunk: Column) -> Column:
        begin, end = chunk[0]["start"], F.element_at(chunk, -1)
        return F.struct(begin.alias("begin"), F.substr("formatted", begin + 1, end["start"] + end["length"] - begin).alias("stretch"), chunk.alias("spans"))

    filled = F.transform(F.filter("chunks", lambda c: F.size(c) > 0), cut)
    texts = F.transform(filled, lambda c: F.array_join(F.transform(c["spans"], lambda s: unescape(F.substr(c["stretch"], s["start"] - c["begin"] + 1, s["length"]))), ""))
    back = back.withColumn("masked", F.array_join(texts, ""))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
