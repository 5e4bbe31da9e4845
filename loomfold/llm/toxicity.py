"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled set is drawn from all
training documents, marked or not, toxic ones included, so that it has the prior's
share of positives, as the risk asks. A linear classifier over hashed words
minimises the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss;
where the bracket turns negative, the step goes the other way.

The classifier is fitted on a bounded sample of training rows (about
``max_positive`` and ``max_unlabelled`` documents of at most ``max_chars``, chosen by
a hash of id and text, rows equal in both taken once); the class prior is the share of toxic ones among all training
documents that are marked. Scoring covers all whole texts, very long ones too.
Null and empty texts have no words and get the score of the intercept; repeated
rows and rows with null ids are scored by their own text; at a score of 0.5 a text
is predicted toxic. An empty table gives no rows. Of the tables only doc_id, text
and toxic are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import LOWER, distinct_by_row, row_of, slices, span_hashes, utf8, words

_BITS = 18
#: Bytes that end words: ASCII that is no letter, digit or apostrophe.
_BREAK = np.array([b < 128 and not (chr(b).isalnum() or b == 39) for b in range(256)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed word) pairs of a column of texts."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, _BREAK)
    hashes = span_hashes(data, starts, ends) >> np.uint64(64 - _BITS)
    return distinct_by_row(row_of(firsts), hashes.astype(np.int64))


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, cells = features(column)
        z = np.bincount(rows, self.weights[cells], len(column)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows, cells = features(part.column("text"))
            firsts = np.searchsorted(rows, np.arange(len(part) + 1))
            lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(cells, pa.int32()))
            yield pa.record_batch([part.column("positive"), lists], names=["positive", "cells"])


def risk_and_slope(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores, and the direction to step against by score.

    Where the corrected negative risk is below 0, that part alone is raised.
    """
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # the loss of calling a row negative; 1 - p: positive
    slope = share * p * (1 - p)
    negative = (share * p)[~positive].sum() - prior * (share * p)[positive].sum()
    risk = prior * (share * (1 - p))[positive].sum() + max(0.0, negative)
    return risk, np.where(positive, -2 * prior * slope, slope) if negative >= 0 else np.where(positive, prior * slope, -slope)


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, rounds: int = 200, rate: float = 0.05, decay: float = 1e-5, least_df: int = 3, least_z: float = 5.0
) -> Model:
    """Full-batch Adam on the non-negative risk.

    Words keep weight 0 that are in fewer than ``least_df`` documents, or whose
    shares of the two sets differ by less than ``least_z`` standard errors.
    """
    rows = positive + unlabelled
    sizes = np.array([len(r) for r in rows], np.int64)
    cells = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), sizes)
    is_p = np.arange(len(rows)) < len(positive)
    used, cells = np.unique(cells, return_inverse=True)
    df, in_p = np.bincount(cells, minlength=len(used)), np.bincount(cells[is_p[of]], minlength=len(used))
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    pooled = df / max(1, len(rows))
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u)) + 1e-12
    keep = (df >= least_df) & (np.abs(in_p / n_p - (df - in_p) / n_u) >= least_z * error)
    of, cells = of[keep[cells]], cells[keep[cells]]
    w = np.zeros(len(used) + 1)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[cells], len(rows)) + w[-1]
        _, g = risk_and_slope(z, is_p, prior)
        grad = np.append(np.bincount(cells, g[of], len(used)), g.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << _BITS)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, training: F.Column, *, max_positive: int = 4000, max_unlabelled: int = 12000, max_chars: int = 50_000) -> Model:
    """Fit on rows of ``docs`` where ``training`` (over ``doc_id``) holds.

    ``labels`` has doc_id and toxic; null and repeated labels are allowed (a
    document is a positive if any of its labels is 1). Without any positive
    the model scores everything 0.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(training).groupBy("doc_id").agg((F.max("toxic") == 1).alias("positive"))
    marked, toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.col("positive").cast("long")), F.lit(0))).first()
    if not toxic:
        return Model(np.zeros(1 << _BITS), -30.0)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & (F.length("text") <= max_chars)).where(training).withColumn("key", F.xxhash64("doc_id", "text"))
    positives = marks.where("positive")
    by_id = texts.groupBy("doc_id").agg(F.count("*").alias("n")).join(positives, "doc_id", "left")
    every, of_positives = by_id.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("positive"), F.col("n"))), F.lit(0))).first()
    if not of_positives:
        return Model(np.zeros(1 << _BITS), -30.0)

    def drawn(share: float, of: str) -> F.Column:
        return F.pmod(F.xxhash64("key", F.lit(of)), F.lit(1 << 20)) < share * (1 << 20)

    chosen = texts.where(drawn(max_positive / of_positives, "sample")).select("doc_id", "key").join(positives, "doc_id").distinct()
    chosen = F.broadcast(chosen)  # of the stated bound
    unlabelled = texts.where(drawn(max_unlabelled / every, "unlabelled")).withColumn("positive", F.lit(False))
    rows = texts.join(chosen, ["doc_id", "key"]).unionByName(unlabelled).groupBy("positive", "doc_id", "key").agg(F.first("text").alias("text")).select("positive", "text")
    table = rows.mapInArrow(_featured, "positive boolean, cells array<int>").toArrow()
    sides: tuple[list, list] = ([], [])
    for flag, cells in zip(table.column("positive").to_pylist(), (x.values.to_numpy() for chunk in table.column("cells").chunks for x in chunk), strict=True):
        sides[not flag].append(cells.astype(np.int64))
    return fit_nnpu(*sides, prior=toxic / marked)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                s = own.scores(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
