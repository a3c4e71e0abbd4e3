"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted texts against the raw corpus.

DataFrame functions only. The n-grams are the whole words and the pairs of adjacent words of the whole text, hashed
into a fixed number of buckets. They are counted over all documents (raw) and over those labelled good outside the
held-out fold (trusted); the two multinomials, the trusted one smoothed towards the raw one, give each bucket a log
ratio. A document's verdict compares the mean of its n-grams' log ratios with a fixed threshold; every document is
decided by itself, no sample is drawn.

The bucket counts are bounded (BUCKETS rows) and reach the plan as one literal array. Repeats within a text are
found by sorting its window hashes (64 bits) in the row; windows of one text are compared by hash.

Cases: null text has no words (all counts 0, fails the base); texts without words score 0; null labels are ignored;
without trusted texts all ratios are 0; repeated rows get the same result each; an empty table an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_bucket

BUCKETS = 65_536
#: Ids of trusted documents up to which they are broadcast (8 bytes each); beyond, both sides shuffle.
TRUSTED_LIMIT = 1_000_000
#: The characters between words beside the space, and those counted as symbols.
SPACES, SYMBOLS = "\t\n\x0b\x0c\r", "#*$%&|<>"


def _each(text: Column, found: str, by: str) -> Column:
    """The text with each of the characters found replaced: plain byte search, many times as fast as translate."""
    for c in found:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def hashed_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, hashes array<bigint>: one per word, in order."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.array_remove(F.split(_each(F.col("t"), SPACES, " "), " "), "")
    return base.select("doc_id", "t", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))


def _word_bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _pair_bucket(h: Column, i: Column, buckets: int) -> Column:
    """Bucket of the word at i and the next, from column hashes."""
    return F.pmod(F.xxhash64(h, F.get("hashes", i + 1)), F.lit(buckets)).cast("int")


def gram_buckets(buckets: int) -> Column:
    """The buckets of the words and of the pairs of adjacent words, from column hashes."""
    pairs = F.slice(F.transform("hashes", lambda h, i: _pair_bucket(h, i, buckets)), F.lit(1), F.greatest(F.size("hashes") - 1, F.lit(0)))
    return F.concat(F.transform("hashes", lambda h: _word_bucket(h, buckets)), pairs)


def log_ratios(words: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Per bucket, log of its trusted over its raw share, from words(hashes, trusted).

    The trusted multinomial is smoothed by one pseudo-count per bucket, spread as the raw shares: without evidence the
    ratio is 0, whatever the corpus size.
    """
    each = words.select("trusted", F.explode(gram_buckets(buckets)).alias("bucket"))
    found = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("trusted"), 1)).alias("good")).collect()  # at most `buckets` rows
    n_raw, n_good = sum(r["raw"] for r in found), sum(r["good"] for r in found)
    ratios = [0.0] * buckets
    for r in found:
        ratios[r["bucket"]] = round(math.log((r["good"] * n_raw / r["raw"] + buckets) / (n_good + buckets)), 4)
    return ratios


def base_counts(words: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to words(t, hashes, ...)."""
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    # The last two entries are of less than three words and equal no other.
    windows = F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    out = words.withColumns({"lines": lines, "windows": windows})
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(repeats, placed))
    following = lambda array: F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))
    twice = F.zip_with("placed", following("placed"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    covered = F.aggregate(F.zip_with("at", following("at"), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    return out.select(
        *words.columns,
        F.size("hashes").cast("long").alias("n_words"),
        F.length(_each(t, " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_each(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, threshold: float = -0.12, min_words: int = 50, max_repeat_percent: int = 50, held_out: tuple[int, int] = (5, 0),
    id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed, kept, log_ratio (mean over the text's words and word pairs).

    Labels of ids whose crc32 (as text) modulo the first of held_out is its second are not used.
    """
    words = hashed_words(docs, id_col, text_col)
    good = labels.filter("quality = 1").select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct()
    good = good.filter(id_bucket("doc_id", held_out[0]) != held_out[1])
    good = F.broadcast(good) if good.count() <= TRUSTED_LIMIT else good
    marked = words.select("doc_id", "hashes").join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")
    ratios = log_ratios(marked, buckets)
    # A constant: folded to one array literal before execution.
    table = F.from_json(F.lit("[" + ",".join(map(str, ratios)) + "]"), "array<double>")
    last = F.size("hashes") - 1
    ratio = lambda h, i: F.get(table, _word_bucket(h, buckets)) + F.when(i < last, F.get(table, _pair_bucket(h, i, buckets))).otherwise(0.0)
    total = F.aggregate(F.transform("hashes", ratio), F.lit(0.0), lambda s, x: s + x)
    out = base_counts(words.withColumn("log_ratio", total / F.greatest(2 * F.size("hashes") - 1, F.lit(1))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
