"""Random forests of an expanding window, all refits grown together.

A refit trains on the rows before its end, so the rows of all refits are the rows of
the last one, and a batch sorted by date holds each refit's share as a prefix. One
pass over the rows grows one level of every tree of every refit: features are cut
into ``BINS`` equal bins, a task counts rows and label sums by refit, tree, node,
feature and bin, Spark adds them up, and the best cut of each node is found over the
bins. The number of passes is the depth, however many refits and trees there are.

A row's weight in a tree is Poisson with mean 1, from a hash of its key and the
tree's number, so it is the same in every refit and at every attempt. Labels are
summed as whole numbers of a fixed small unit: sums don't depend on the order of
rows, and equal gains are decided by feature, then bin.

The driver holds the trees as arrays over refit, tree and node, which is their size
by parameters, never by rows. Rows with a null label or feature are not trained on;
refits with under ``LEAST_ROWS`` rows have no trees. Of equal keys both rows count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bins of a feature in (0, 1]; a power of two, so that edges are exact.
BINS = 64
#: Rows that are counted at once, and counters that a task holds before it passes them on.
ROWS, COUNTERS = 8192, 1 << 22
LEAST_ROWS = 10
#: Cumulative shares of a Poisson variable with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
_MOST_WEIGHT = 8
_NODES = "refit int, tree int, node int, feature int, bin int, value double, rows bigint, gain double"


def bins_of(x: np.ndarray) -> np.ndarray:
    """Bins 0 to BINS - 1 of shares in (0, 1]; a value goes left of a cut at a bin if its own is at most that."""
    return np.clip(np.ceil(x * BINS) - 1, 0, BINS - 1).astype(np.int64)


def weight(key: np.ndarray, tree: int) -> np.ndarray:
    """How often rows count in a tree."""
    x = key.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), "right").astype(np.int64)


@dataclass
class Forest:
    """Trees by refit, tree and node; the children of a node are 2 * node + 1 and 2 * node + 2.

    ``feature`` is -1 at a leaf, ``value`` a node's mean label, ``rows`` its weight (0 where there is no such node).
    """

    ends: list[int]
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, ends: list[int], trees: int, depth: int) -> Forest:
        shape = (len(ends), trees, (2 << depth) - 1)
        return cls(ends, np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape))

    def node_of(self, bins: np.ndarray, refit: int, tree: int, levels: int) -> np.ndarray:
        """The node each row is in after ``levels`` cuts, or the leaf before."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[refit, tree][node]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[refit, tree][node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def predict(self, bins: np.ndarray, refit: int) -> np.ndarray:
        """The mean of the trees of a refit."""
        trees, depth = self.feature.shape[1], self.feature.shape[2].bit_length() - 1
        return sum(self.value[refit, t][self.node_of(bins, refit, t, depth)] for t in range(trees)) / trees

    def trained(self, refit: int) -> bool:
        return bool(self.rows[refit, :, 0].any())

    def importances(self, features: int) -> np.ndarray:
        """Gains by feature, as shares within each tree, and their means over the trees and refits that were trained."""
        found = []
        for refit in filter(self.trained, range(len(self.ends))):
            total = np.zeros((self.feature.shape[1], features))
            tree, node = np.nonzero(self.feature[refit] >= 0)
            np.add.at(total, (tree, self.feature[refit][tree, node]), self.gain[refit][tree, node])
            found.append((total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0))
        return np.mean(found, axis=0) if found else np.zeros(features)

    def to_table(self, spark: SparkSession) -> DataFrame:
        at = np.argwhere(self.rows > 0)
        rows = [(*map(int, i), int(self.feature[tuple(i)]), int(self.bin[tuple(i)]), float(self.value[tuple(i)]), int(self.rows[tuple(i)]), float(self.gain[tuple(i)])) for i in at]
        return spark.createDataFrame(rows, _NODES)

    @classmethod
    def from_table(cls, table: DataFrame, ends: list[int], trees: int, depth: int) -> Forest:
        out = cls.empty(ends, trees, depth)
        for r in table.collect():
            at = r.refit, r.tree, r.node
            out.feature[at], out.bin[at], out.value[at], out.rows[at], out.gain[at] = r.feature, r.bin, r.value, r.rows, r.gain
        return out


def _counter(shared, features: int, level: int, purge: int, unit: float):
    """Counts of one level: a row for each refit, tree, node, feature and bin with rows."""
    names = ["refit", "tree", "node", "feature", "bin", "n", "s"]
    first, nodes = (1 << level) - 1, 1 << level

    def flushed(held: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (refit, tree), counts in held.items():
            at = np.argwhere(counts[0] > 0)
            columns = [np.full(len(at), refit), np.full(len(at), tree), at[:, 0] + first, at[:, 1], at[:, 2]]
            yield pa.record_batch([*(pa.array(c, pa.int32()) for c in columns), *(pa.array(c[tuple(at.T)]) for c in counts)], names=names)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        trees = forest.feature.shape[1]
        ends = np.array(forest.ends) - purge
        held: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                t, key = batch.column("t_idx").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
                order = np.argsort(t, kind="stable")
                upto = np.searchsorted(t[order], ends)  # a refit's rows are a prefix
                bins = np.stack([bins_of(batch.column(f"x{i}").to_numpy()) for i in range(features)], axis=1)[order]
                y = np.rint(batch.column("y").to_numpy()[order] / unit)
                cells = np.arange(features) * BINS + bins
                for tree in range(trees):
                    w = weight(key[order], tree)
                    wy = w * y
                    for refit, n in enumerate(upto.tolist()):
                        if not n or level and forest.feature[refit, tree].max() < 0:
                            continue
                        node = forest.node_of(bins[:n], refit, tree, level) - first
                        on = np.flatnonzero((node >= 0) & (w[:n] > 0))
                        at = (node[on, None] * (features * BINS) + cells[on]).ravel()
                        size = nodes * features * BINS
                        both = [np.bincount(at, np.repeat(v[on], features), size) for v in (w[:n].astype(float), wy[:n])]
                        counts = held.setdefault((refit, tree), np.zeros((2, nodes, features, BINS), np.int64))
                        counts += np.rint(both).astype(np.int64).reshape(counts.shape)
                    if len(held) * 2 * nodes * features * BINS > COUNTERS:
                        yield from flushed(held)
        yield from flushed(held)

    return run


def best_cuts(counts: DataFrame) -> DataFrame:
    """The cut of largest gain of each (refit, tree, node) with one, and both sides' counts and sums.

    The gain is the fall of the sum of squares, in units of the label's. A cut needs rows on both sides.
    """
    by = Window.partitionBy("refit", "tree", "node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = counts.withColumns({"ln": F.sum("n").over(upto), "ls": F.sum("s").over(upto), "tn": F.sum("n").over(whole), "ts": F.sum("s").over(whole)})
    square = lambda s, n: F.try_divide(s.cast("double") * s.cast("double"), n)
    sides = square(F.col("ls"), F.col("ln")) + square(F.col("ts") - F.col("ls"), F.col("tn") - F.col("ln"))
    gain = F.when(F.col("ln") < F.col("tn"), sides - square(F.col("ts"), F.col("tn")))
    x = x.withColumn("gain", F.when(gain > 1e-12 * sides, gain))
    best = F.max_by(F.struct("feature", "bin", "gain", "ln", "ls"), F.struct(F.col("gain").isNotNull(), "gain", -F.col("feature"), -F.col("bin"))).alias("best")
    return x.groupBy("refit", "tree", "node").agg(best, F.first("tn").alias("tn"), F.first("ts").alias("ts")).select("refit", "tree", "node", "best.*", "tn", "ts")


def grow(rows: DataFrame, features: int, ends: list[int], *, trees: int, depth: int, purge: int = 0) -> Forest:
    """A forest for each of ``ends`` from rows (t_idx, key, x0 …, y) with ``t_idx < end - purge``; ``key`` names a row, features are in (0, 1]."""
    spark = rows.sparkSession
    forest = Forest.empty(ends, trees, depth)
    n, most, *before = rows.agg(F.count("*"), F.max(F.abs("y")), *(F.count(F.when(F.col("t_idx") < end - purge, 1)) for end in ends)).first()
    enough = [k for k, count in enumerate(before) if count >= LEAST_ROWS]
    if not enough:
        return forest
    # all sums of whole units, of a batch in doubles and of all rows in longs, stay exact
    unit = max(_MOST_WEIGHT * (most or 1.0) * max(min(n, ROWS) / 2**52, n / 2**62), 1e-300)
    own = Forest.empty([ends[k] for k in enough], trees, depth)
    for level in range(depth):
        if level and (own.feature.max(axis=2) < 0).all():
            break
        shared = spark.sparkContext.broadcast(own)
        out = "refit int, tree int, node int, feature int, bin int, n bigint, s bigint"
        counts = rows.mapInArrow(_counter(shared, features, level, purge, unit), out).groupBy("refit", "tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        cuts = best_cuts(counts).collect()  # a row for each node of this level
        shared.unpersist()
        for r in cuts:
            at = own.feature[r.refit, r.tree], own.bin[r.refit, r.tree], own.value[r.refit, r.tree], own.rows[r.refit, r.tree], own.gain[r.refit, r.tree]
            feature, cut, value, weights, gain = at
            value[r.node], weights[r.node] = r.ts / r.tn * unit, r.tn
            if r.gain is not None:
                feature[r.node], cut[r.node], gain[r.node] = r.feature, r.bin, r.gain * unit * unit
                for child, n_rows, total in ((2 * r.node + 1, r.ln, r.ls), (2 * r.node + 2, r.tn - r.ln, r.ts - r.ls)):
                    value[child], weights[child] = total / n_rows * unit, n_rows
    for name in ("feature", "bin", "value", "rows", "gain"):
        getattr(forest, name)[enough] = getattr(own, name)
    return forest


def predict(rows: DataFrame, features: int, forest: Forest, windows: list[tuple[int, int, int]], keys: list[str]) -> DataFrame:
    """``keys`` and value of the rows (with t_idx, x0 …) in the windows (refit, start, stop); null where a feature is."""
    shared = rows.sparkSession.sparkContext.broadcast((forest, windows))
    schema = rows.select(*keys).schema.add("value", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = shared.value
        for batch in batches:
            t = batch.column("t_idx").to_numpy()
            x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(features)], axis=1)
            value = np.full(len(t), np.nan)
            for refit, start, stop in parts:
                on = np.flatnonzero((t >= start) & (t < stop) & ~np.isnan(x).any(axis=1))
                if len(on):
                    value[on] = own.predict(bins_of(x[on]), refit)
            yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(value, mask=np.isnan(value))], names=schema.names)

    columns = list(dict.fromkeys([*keys, "t_idx", *(f"x{i}" for i in range(features))]))
    return rows.select(*columns).mapInArrow(run, schema)
