"""Mixing sources to target weights by Pareto order sampling.

Targets come from one row per source. Within a source a document's expected number of copies is level * importance,
at most `most`, with the level at which expected words make the target: importance is a small whole number (by
default the binary digits of the document's size, so that fragments are drawn less often than whole texts), and the
level is found exactly from one row per source and importance. Whole copies of the expectation are certain. The
fraction left is the document's inclusion probability p: its rank is the random odds u / (1 - u) divided by the
inclusion odds p / (1 - p), and documents are taken in rank order up to the words still wanted, ending where the
total comes nearest. So the draw is one of fixed size with unequal probabilities.

The cut is found without sorting a source in one task: ranks fall into buckets by a monotone map to [0, 1), bucket
sizes give the bucket where the cut lies, and only that bucket's documents are summed in order. Buckets grow with
the rows.

Cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0;
repeated rows (same id and source) draw the same u and are taken in an order fixed by id and size; a null id draws as empty
text; a table without words has targets 0 and takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of key and seed, the same in every engine."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from sizes(source, source_size), one row per source.

    Weights go round over the sources in code-point order, null last. The target is min(most * size, level * weight)
    with the greatest level that fits, which makes the total share * all sizes: capping and resharing until none is above ends there.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weigh.alias("w"), (F.col("source_size") * most).alias("cap"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * share)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(everything))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _expected_copies(groups: DataFrame, most: float) -> DataFrame:
    """Adds copies (expected, for each document) to groups(source, importance, words, target): min(most, level * importance).

    Groups reach `most` in order of importance; the level is the greatest that leaves those after within it.
    """
    down = Window.partitionBy("source").orderBy(F.col("importance").desc())
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    open_ = F.sum(F.col("words") * F.col("importance")).over(down.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(open_ > 0, (F.col("target") - full) / open_)
    rows = groups.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("importance") <= most * (1 + 1e-12), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(Window.partitionBy("source")))
    return rows.withColumn("copies", F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("importance"), F.lit(float(most))))).drop("level")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, importance: Column | None = None, seed: int = 5, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken (= copies * size).

    importance: whole numbers from 1, few different ones; by default the number of binary digits of the size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    digits = F.length(F.bin(size))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
            F.greatest((digits if importance is None else importance).cast("long"), F.lit(1)).alias("importance"), uniform(F.col(id_col), seed).alias("u"),
        ),
        "mix-sizes",
    )
    buckets = max(buckets, sized.count() // 10_000)
    groups = materialize(sized.groupBy("source", "importance").agg(F.sum("size").alias("words")), "mix-groups")
    sources = materialize(source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-sources")
    # One row per source and importance; joins, so that any number of sources works. Null sources meet by null-safe equality.
    named = sources.withColumnRenamed("source", "s")
    plan = groups.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = _expected_copies(plan, most).withColumn("sure", F.floor("copies")).withColumn("p", F.col("copies") - F.col("sure"))
    want = F.col("target") - F.sum(F.col("sure") * F.col("words")).over(Window.partitionBy("source"))
    plan = plan.select(F.col("source").alias("s"), F.col("importance").alias("i"), "source_size", "target", "sure", "p", want.alias("want"))
    plan = materialize(plan, "mix-plan")
    met = F.col("source").eqNullSafe(F.col("s")) & (F.col("importance") == F.col("i"))
    rows = sized.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, met).drop("s", "i")
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))
    totals = rows.filter("rank is not null").groupBy("source", "want", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("n").over(upto))
    cut = totals.filter("upto >= want").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "want"), "bucket").alias("c"))
    cut = materialize(cut.select(F.col("source").alias("cs"), "c.*").withColumnsRenamed({"bucket": "cut", "want": "cut_want"}), "mix-cuts")
    cuts = F.broadcast(cut) if cut.count() <= 100_000 else cut
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    # Only the documents of each source's cut bucket are put in order.
    edge = rows.filter("rank is not null and bucket = cut")
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.col("before") + F.sum("size").over(inside))
    near = (F.col("run") <= F.col("want")) | (F.col("run") - F.col("want") < F.col("want") - (F.col("run") - F.col("size")))
    extra = F.when(F.col("rank").isNull(), 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0)
    columns = ["doc_id", "size", "source", "source_size", "target"]
    rest = rows.filter("rank is null or cut is null or bucket != cut").select(*columns, (F.col("sure") + extra).alias("copies"))
    out = rest.union(edge.select(*columns, (F.col("sure") + near.cast("int")).alias("copies")))
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """docs repeated as often as mix() takes them; all columns of docs.

    Rows meet their copies by (id, source, size). Where several rows are equal in these, as with null ids, they
    share one draw u, so mix() may cut between them: their lists of copies are dealt to them one to one.
    """
    text_col, source_col = parameters.get("text_col", "text"), parameters.get("source_col", "source")
    mixed = mix(docs, id_col=id_col, **parameters).select("doc_id", "source", "size", "copies")
    # Equal rows are counted by their number of copies; the rows of a key with one number need no order.
    counts = mixed.groupBy("doc_id", "source", "size", "copies").agg(F.count(F.lit(1)).alias("rows"))
    keys = counts.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list(F.struct("copies", "rows")), asc=False).alias("dealt"))
    keys = materialize(keys.filter(F.col("dealt")[0]["copies"] > 0), "mix-taken").withColumnsRenamed({"doc_id": "taken_id", "source": "taken_source", "size": "taken_size"})
    n = keys.count()
    size = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long")
    met = docs[id_col].eqNullSafe(keys["taken_id"]) & docs[source_col].eqNullSafe(keys["taken_source"]) & (size == keys["taken_size"])
    joined = docs.join(F.broadcast(keys) if n <= 1_000_000 else keys, met)
    again = F.explode(F.sequence(F.lit(1), F.col("times")))
    whole = joined.filter(F.size("dealt") == 1).withColumn("times", F.col("dealt")[0]["copies"])
    # Keys that the cut goes through, at most one a source: their rows in order.
    nth = F.row_number().over(Window.partitionBy("taken_id", "taken_source", "taken_size").orderBy(docs[text_col]))
    cut = joined.filter(F.size("dealt") > 1).withColumn("nth", nth)
    cut = cut.withColumn("times", F.when(F.col("nth") <= F.col("dealt")[0]["rows"], F.col("dealt")[0]["copies"]).otherwise(F.col("dealt")[1]["copies"])).filter("times > 0")
    return whole.select(docs["*"], again.alias("again")).drop("again").union(cut.select(docs["*"], again.alias("again")).drop("again"))
