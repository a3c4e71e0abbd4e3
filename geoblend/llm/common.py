"""What the corpus operators share: tables in the shared folder, the word pattern, byte-level helpers.

Conventions that hold for every operator of this subpackage: the needed columns are selected first, so extra
columns (also such as clash with working names) are ignored; a null text counts as empty unless the operator
says otherwise; an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; an own one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/geoblend-shared"
        os.makedirs(base.removeprefix("file://"), exist_ok=True)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoblend/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, once what was made from them is written itself."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files and "/geoblend/" in files[0]:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint behind a count; beyond the limit the join shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


#: Rows that a drop stage removes, up to which they are broadcast (some 80 bytes each); beyond, the join shuffles.
DROP_LIMIT = 500_000


def text_digest(text: Column) -> Column:
    """128 bits of the text's SHA-256 (null: empty), which tell the texts of one id apart."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs without the rows whose id (null equals null) and text stand in dropped(doc_id, digest); all columns of docs."""
    gone = materialize(dropped.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), name)
    gone = broadcast_if_small(gone, gone.count(), DROP_LIMIT)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (text_digest(docs[text_col]) == gone["gone_digest"]), "left_anti")


def one_of_each(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs with one row of those that share id and text (null equals null; null text is empty); all columns of docs."""
    keys = docs.select(F.col(id_col).alias("twin_id"), text_digest(docs[text_col]).alias("twin_digest")).groupBy("twin_id", "twin_digest").agg(F.count(F.lit(1)).alias("twins"))
    keys = materialize(keys.filter("twins > 1").select("twin_id", "twin_digest"), name)
    n = keys.count()
    if not n:
        return docs
    keys = broadcast_if_small(keys, n, DROP_LIMIT)
    same = docs[id_col].eqNullSafe(keys["twin_id"]) & (text_digest(docs[text_col]) == keys["twin_digest"])
    digest = f"digest_{uuid.uuid4().hex}"  # beside any column of docs
    twins = docs.join(keys, same, "left_semi").withColumn(digest, text_digest(docs[text_col])).dropDuplicates([id_col, digest]).drop(digest)
    return docs.join(keys, same, "left_anti").union(twins)


def id_bucket(key: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo: the folds of the labelled operators. Null counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
