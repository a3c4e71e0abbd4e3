"""Normal distribution, hash order and global rank: exact, engine-neutral helpers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of Cody's (1969) rational approximations of erf and erfc.
ERF_A = ("3.16112374387056560e00", "1.13864154151050156e02", "3.77485237685302021e02", "3.20937758913846947e03", "1.85777706184603153e-1")
ERF_B = ("2.36012909523441209e01", "2.44024637934444173e02", "1.28261652607737228e03", "2.84423683343917062e03")
ERFC_C = ("5.64188496988670089e-1", "8.88314979438837594e0", "6.61191906371416295e01", "2.98635138197400131e02", "8.81952221241769090e02", "1.71204761263407058e03", "2.05107837782607147e03", "1.23033935479799725e03", "2.15311535474403846e-8")
ERFC_D = ("1.57449261107098347e01", "1.17693950891312499e02", "5.37181101862009858e02", "1.62138957456669019e03", "3.29079923573345963e03", "4.36261909014324716e03", "3.43936767414372164e03", "1.23033935480374942e03")
TAIL_P = ("3.05326634961232344e-1", "3.60344899949804439e-1", "1.25781726111229246e-1", "1.60837851487422766e-2", "6.58749161529837803e-4", "1.63153871373020978e-2")
TAIL_Q = ("2.56852019228982242e00", "1.87295284992346725e00", "5.27905102951428412e-1", "6.05183413124413191e-2", "2.33520497626869185e-3")


def _ratio(x: str, top: tuple, bottom: tuple) -> str:
    """Nested form of the approximations: the leading coefficient of the numerator comes last in its list."""
    num, den = f"{top[-1]}*{x}", x
    for p, q in zip(top[:-2], bottom[:-1]):
        num, den = f"({num}+{p})*{x}", f"({den}+{q})*{x}"
    return f"(({num}+{top[-2]})/({den}+{bottom[-1]}))"


def norm_cdf_sql(z: str) -> str:
    """Standard normal distribution function as SQL text that Spark and other engines read alike."""
    x = f"(({z})/1.4142135623730951e0)"
    y = f"abs{x}"
    near = f"(0.5e0+0.5e0*{x}*{_ratio(f'({x}*{x})', ERF_A, ERF_B)})"
    middle = f"(exp(-{x}*{x})*{_ratio(y, ERFC_C, ERFC_D)})"
    inverse = f"(1e0/({x}*{x}))"
    far = f"(exp(-{x}*{x})*(5.6418958354775628695e-1-{inverse}*{_ratio(inverse, TAIL_P, TAIL_Q)})/{y})"
    upper = f"(CASE WHEN {y} <= 4e0 THEN {middle} ELSE {far} END)"
    return f"(CASE WHEN {y} <= 0.46875e0 THEN {near} WHEN {x} > 0e0 THEN 1e0-0.5e0*{upper} ELSE 0.5e0*{upper} END)"


def norm_pdf_sql(z: str) -> str:
    return f"(3.9894228040143267794e-1*exp(-0.5e0*({z})*({z})))"


def norm_cdf(z: str) -> Column:
    return F.expr(norm_cdf_sql(z))


def norm_pdf(z: str) -> Column:
    return F.expr(norm_pdf_sql(z))


def z_of(level: float) -> float:
    """Half width in standard deviations of a central interval of this level."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def hash_unit(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the keys and a seed: reproducible on any cluster and in any engine."""
    text = F.concat_ws("|", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def global_rank(df: DataFrame, order: list[str], name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Adds a 1-based rank over the whole table without sorting it in one partition.

    Rows are range-partitioned by all order columns and then by their place in the written table, so a value that many
    rows share is split as well, and sorted within. The sorted ranges are written with the rows' running ids; what each
    range holds gives the offsets. Ranks are read off the written rows, so a lost executor changes nothing.
    """
    from ..sources.tables import written

    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = written(df, "rank-rows").withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(n, *order, "_place").sortWithinPartitions(*order, "_place")
    sorted_rows = written(dealt.drop("_place").withColumn("_id", F.monotonically_increasing_id()), "rank-ranges")
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = sorted_rows.withColumns({"_part": part, "_own": own}).join(F.broadcast(sizes), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_own") + 1).select(*df.columns, name)
