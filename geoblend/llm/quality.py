"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

A scan turns each whole text into a few transformed statistics (a small written table). Labelled rows of the fit
folds give class counts, sums and cross products by one Spark aggregation, so the fit uses every labelled row and
sends the driver one row per class. Class covariances are shrunk towards the pooled covariance and its diagonal;
their Cholesky factors are computed once and shipped with the scoring task, where the score is the posterior from
the difference of Mahalanobis log densities.

Cases: null text counts as empty and is scored like any text; labels with a null id or label are ignored; rows
labelled twice count twice; without labels of both classes the score is the share of class 1 (1.0 without any);
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, id_bucket, materialize, text_digest

#: Characters counted as symbols, and as marks of layout.
SYMBOLS = "#*$%&<>@^~=+{}[]\\_"
LAYOUT = "|!\t"
FEATURES = ("log_words", "word_length", "symbols", "layout", "upper", "repeats", "distinct", "marked_ends", "lines", "digits")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    each = 1.0 / max(1, n)
    share = lambda marks: sum(map(text.count, marks)) / chars
    root = lambda x: x**0.5
    return [
        np.log1p(n),
        np.log1p((chars - n) * each),
        root(share(SYMBOLS)),
        root(share(LAYOUT)),
        root(sum(map(str.isupper, words)) * each),
        root(sum(map(str.__eq__, words, words[1:])) * each),
        (len(set(words)) + 5) / (n**0.9 + 5),
        root(sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in words) * each),
        root(text.count("\n") * each),
        root(share("0123456789")),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (hash of the text), x array<double>."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "digest", "x"])

    base = docs.select(F.col(id_col).alias("doc_id"), text_digest(docs[text_col]).alias("digest"), F.col(text_col).alias("t"))
    return base.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, digest string, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class 0 and 1: log prior, mean, inverse Cholesky factor of the shrunk covariance, log determinant."""

    share: float
    parts: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts or not len(x):
            return np.full(len(x), self.share)
        densities = []
        for log_prior, mean, inverse, log_det in self.parts:
            z = (x - mean) @ inverse.T
            densities.append(log_prior - 0.5 * (z * z).sum(axis=1) - 0.5 * log_det)
        return 1 / (1 + np.exp(np.clip(densities[0] - densities[1], -700, 700)))


def fit_discriminant(labelled: DataFrame, pooling: float = 0.3, diagonal: float = 0.1, floor: float = 1e-4) -> Discriminant:
    """From labelled(x, y): shrinkage towards the pooled covariance by `pooling`, towards its diagonal by `diagonal`."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    cross = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    rows = {r["y"]: r for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums, *cross).collect()}
    n = {y: rows[y]["n"] if y in rows else 0 for y in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(1.0 if not sum(n.values()) else n[1] / sum(n.values()))
    mean, cov = {}, {}
    for y in (0, 1):
        mean[y] = np.array([rows[y][f"s{i}"] for i in range(d)]) / n[y]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = rows[y][f"c{i}_{j}"] / n[y]
        cov[y] = second - np.outer(mean[y], mean[y])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    parts = []
    for y in (0, 1):
        own = (1 - pooling) * cov[y] + pooling * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(pooled)) + floor * np.eye(d)
        factor = np.linalg.cholesky(own)
        parts.append((np.log(n[y] / sum(n.values())), mean[y], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
    return Discriminant(n[1] / sum(n.values()), tuple(parts))


def _scored(docs: DataFrame, labels: DataFrame, label_col: str, held_out: tuple[int, int], id_col: str, text_col: str, **shrinkage) -> DataFrame:
    """doc_id, digest, score of every row."""
    modulus, fold = held_out
    table = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    model = fit_discriminant(table.join(marks.filter(id_bucket("doc_id", modulus) != fold), "doc_id"), **shrinkage)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "digest", "score"])

    return table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, digest string, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **shrinkage) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted. Fitted on labels outside the held-out fold."""
    modulus, fold = held_out
    scored = _scored(docs, labels, label_col, held_out, id_col, text_col, **shrinkage)
    return scored.select("doc_id", (id_bucket("doc_id", modulus) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **shrinkage) -> DataFrame:
    """docs without those predicted 0; all columns of docs.

    A score hangs on the text alone, so rows go by id and text: an id, or the null id, may also stand at a good text.
    """
    scored = _scored(docs, labels, label_col, held_out, id_col, text_col, **shrinkage)
    return drop_rows(docs, scored.filter(F.col("score") < threshold), id_col, text_col, "quality-rejected")
