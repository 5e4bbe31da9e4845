"""Deletion of repeated line runs with a suffix array built by prefix doubling.

The corpus is one sequence of line ids, document after document. Suffixes are
ranked by their first line, then by 2, 4, 8 … lines: a suffix's rank at the
next level is the rank of the pair of its own rank and that of the suffix half
a prefix further on. Ranks are given by a range sort of the distinct pairs, so
they keep the order of the suffixes; suffixes of equal rank at level k form an
interval of the suffix array with a common prefix of 2^k lines or more.
Suffixes alone in their interval have no repeat and leave; levels go on only as
far as some run needs them.

A run of lines counts from ``least_words`` words on. For every line, the
shortest such run that starts or ends with it is named exactly by two
overlapping ranks; the suffixes that share both are the interval whose common
prefix is at least that run, and its first suffix by (doc_id, place) is what the
others are copies of. Where the runs of a copy and of its first go on side by side,
line after line, they are one: :func:`maximal_runs` joins them, so that its length is
the longest common prefix that the two suffixes have as first and later copy. A line
is deleted if it lies in a maximal run whose first copy it doesn't overlap. The
first copy of every line thus stays.

Runs under ``least_words`` words stay on purpose: lines of a dozen words, such as a
license, are shared by documents that are otherwise clean.

Lines are compared without the white space around them; blank lines take no
part and stay. Null texts have no lines; very long ones are read whole. Rows equal
in doc_id and text are one document and get the same result; rows with one doc_id
and different texts are ordered by a hash of the text, null ids come first. An
empty table stays empty. Other columns are kept whatever their names; a column
named as ``count_as`` is replaced by the count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialize
from .textio import free_name, row_of, slices, span_hashes, utf8, words

_LINES = "d bigint, t bigint, seq int, h1 bigint, h2 bigint, w int"
_STEP = "d bigint, t bigint, seq int, m int, a bigint, b bigint, ms array<int>"


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, end and word count of every line that isn't blank."""
    starts, ends, firsts = words(data, offsets)
    rows = row_of(firsts)
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    upto = np.append(at[1:], len(starts))
    return rows[at], starts[at], ends[upto - 1] if len(at) else starts, upto - at


def _within(rows: np.ndarray) -> np.ndarray:
    """Place of each item among those of its row; rows ascend."""
    at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(at, np.diff(np.append(at, len(rows))))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            rows, starts, ends, n = _line_spans(data, offsets)
            h = span_hashes(data, starts, ends)
            second = span_hashes(data, starts, ends, second=True)
            take = pa.array(rows)
            yield pa.record_batch(
                [part.column("d").take(take), part.column("t").take(take), pa.array(_within(rows).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n.astype(np.int32))],
                names=["d", "t", "seq", "h1", "h2", "w"],
            )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row and fields of the items of all documents, by row and place, without repeats."""
    items = batch.column("items")
    rows = np.repeat(np.arange(len(batch)), np.diff(items.offsets.to_numpy()))
    values = items.flatten()
    key = (rows.astype(np.int64) << 32) + values.field("seq").to_numpy()
    key, order = np.unique(key, return_index=True)
    return key, rows[order], values.take(pa.array(order))


def _run_lengths(key: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, lines) of the shortest runs of ``least`` words from each line and to each line."""
    n = len(key)
    before = np.concatenate([[0], np.cumsum(w)])
    segment = np.cumsum(np.append(True, key[1:] != key[:-1] + 1))
    at = np.arange(n)
    end = np.searchsorted(before[1:], before[:-1] + least)
    fits = end < n
    fits[fits] = segment[end[fits]] == segment[at[fits]]
    start = np.searchsorted(before[:-1], before[1:] - least, "right") - 1
    back = start >= 0
    back[back] = segment[start[back]] == segment[at[back]]
    starts = np.concatenate([at[fits], start[back]])
    lengths = np.concatenate([(end - at + 1)[fits], (at - start + 1)[back]])
    both = np.unique(starts * (1 << 20) + lengths)
    return both >> 20, both & ((1 << 20) - 1)


def _lists(starts: np.ndarray, lengths: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.searchsorted(starts, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(lengths.astype(np.int32)))


def _level(k: int, least: int):
    """Runs that two ranks of level ``k`` name (m > 0), and pairs of ranks for the next level (m = 0)."""
    half = 1 << k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key, rows, values = _flat(batch)
            rank = values.field("rank").to_numpy()
            if k == 0:
                starts, lengths = _run_lengths(key, values.field("w").to_numpy(), least)
            else:
                ms = values.field("ms")
                starts = np.repeat(np.arange(len(key)), pa.compute.list_value_length(ms).to_numpy())
                lengths = ms.flatten().to_numpy().astype(np.int64)
            ending = lengths < 2 * half
            i, m = starts[ending], lengths[ending]
            last = np.minimum(np.searchsorted(key, key[i] + m - half), len(key) - 1)
            whole = key[last] == key[i] + m - half
            i, m, last = i[whole], m[whole], last[whole]
            starts, lengths = starts[~ending], lengths[~ending]
            deeper = np.zeros(len(batch), bool)
            deeper[rows[starts]] = True
            nxt = np.minimum(np.searchsorted(key, key + half), len(key) - 1)
            at = np.flatnonzero((key[nxt] == key + half) & deeper[rows])
            place = np.full(len(key), -1)
            place[at] = np.arange(len(at))
            on = place[starts] >= 0
            lists = _lists(place[starts[on]], lengths[on], len(at))
            seq = (key & 0xFFFFFFFF).astype(np.int32)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(i) + 1, np.int32)), pa.array([], pa.int32()))
            of = pa.array(np.concatenate([rows[i], rows[at]]))
            yield pa.record_batch(
                [
                    batch.column("d").take(of), batch.column("t").take(of), pa.array(np.concatenate([seq[i], seq[at]])), pa.array(np.concatenate([m, np.zeros(len(at), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([rank[i], rank[at]])), pa.array(np.concatenate([rank[last], rank[nxt[at]]])), pa.concat_arrays([none, lists]),
                ],
                names=["d", "t", "seq", "m", "a", "b", "ms"],
            )

    return run


def _ranked(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct repeated keys with ranks in their order."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = keys.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*columns)
    ordered = repeated.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def document_key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), F.xxhash64(F.col("text").cast("string"))


def _copies(docs: DataFrame, least_words: int) -> DataFrame:
    """(d, t, seq, m, first): later copies of the shortest runs, with their interval's first suffix."""
    d, t = document_key()
    lines = docs.select(d.alias("d"), t.alias("t"), F.col("text").cast("string").alias("text")).mapInArrow(_lines, _LINES)
    # rows equal in id and text are one document: their lines meet within a task before they are shuffled
    lines = materialize(lines.groupBy("d", "t", "seq").agg(*(F.first(c).alias(c) for c in ("h1", "h2", "w"))), "lines")
    ranks = _ranked(lines, ["h1", "h2"], "ranks")
    used = [lines, ranks]
    state = lines.join(ranks, ["h1", "h2"]).select("d", "t", F.struct("seq", "rank", "w").alias("item"))
    flagged, k = None, 0
    while True:
        grouped = state.groupBy("d", "t").agg(F.collect_list("item").alias("items"))
        step = materialize(grouped.mapInArrow(_level(k, least_words), _STEP), "level")
        discard(*used)
        runs = step.where("m > 0").select("d", "t", "seq", "m", "a", "b")
        firsts = runs.groupBy("m", "a", "b").agg(F.min(F.struct("d", "t", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        same = (F.col("first.d") == F.col("d")) & (F.col("first.t") == F.col("t"))
        later = runs.join(firsts, ["m", "a", "b"]).where(~same | (F.col("first.seq") + F.col("m") <= F.col("seq"))).select("d", "t", "seq", "m", "first")
        later = materialize(later, "later")  # ends the stage with the join, so AQE may split a hot run
        flagged = later if flagged is None else flagged.union(later)
        pairs = step.where("m = 0")
        if pairs.isEmpty():
            break
        ranks = _ranked(pairs, ["a", "b"], "ranks")
        used = [step, ranks]
        state = pairs.join(ranks, ["a", "b"]).select("d", "t", F.struct("seq", "rank", "ms").alias("item"))
        k += 1
    discard(step)
    return flagged


def maximal_runs(docs: DataFrame, *, least_words: int = 50) -> DataFrame:
    """(d, t, seq, m, first_d, first_t, first_seq): maximal later copies of line runs and their first copies.

    Places and lengths count lines that aren't blank. Runs of one copy and one
    first at one distance join where they overlap or touch.
    """
    side = ["d", "t", "first_d", "first_t", "apart"]
    rows = _copies(docs, least_words).select("d", "t", "seq", "m", F.col("first.d").alias("first_d"), F.col("first.t").alias("first_t"), (F.col("seq") - F.col("first.seq")).alias("apart"))
    before = Window.partitionBy(*side).orderBy("seq", "m").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.col("seq") > F.max(F.col("seq") + F.col("m")).over(before), F.lit(True)).cast("int")
    numbered = rows.repartition("d", "t").withColumn("new", starts).withColumn("run", F.sum("new").over(Window.partitionBy(*side).orderBy("seq", "m").rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*side, "run").agg(F.min("seq").alias("seq"), F.max(F.col("seq") + F.col("m")).alias("end"))
    return joined.select("d", "t", "seq", (F.col("end") - F.col("seq")).alias("m"), "first_d", "first_t", (F.col("seq") - F.col("apart")).alias("first_seq"))


def repeated_runs(docs: DataFrame, *, least_words: int = 50) -> DataFrame:
    """(d, t, runs): for each document with later copies, their (seq, m) in lines that aren't blank."""
    return maximal_runs(docs, least_words=least_words).groupBy("d", "t").agg(F.collect_set(F.struct("seq", "m")).alias("runs"))


def cut(text: str, runs: list[dict]) -> tuple[str, int]:
    """Text without the lines of ``runs``, and how many went."""
    gone = {s for r in runs for s in range(r["seq"], r["seq"] + r["m"])}
    kept, seq = [], 0
    for line in text.split("\n"):
        blank = not line.strip(" \t\n\v\f\r")
        if blank or seq not in gone:
            kept.append(line)
        seq += not blank
    return "\n".join(kept), len(gone)


def _cut(at: int, names: list[str], count_as: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(len(names))
            texts, gone = batch.column(at), np.zeros(len(batch), np.int64)
            hit = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                changed = texts.to_pylist()
                for i in hit.tolist():
                    changed[i], gone[i] = cut(changed[i], runs[i].as_py())
                texts = pa.array(changed, pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            counts = [pa.array(gone)] if count_as else []
            yield pa.record_batch([*columns, *counts], names=[*names, count_as][: len(names) + len(counts)])

    return run


def dedup_lines(docs: DataFrame, *, least_words: int = 50, count_as: str | None = "lines_gone") -> DataFrame:
    """``docs`` with later copies cut from their texts, and a last column of how many lines went unless ``count_as`` is None."""
    docs = docs.drop(*(c for c in docs.columns if count_as and c.lower() == count_as.lower()))
    names, d, t = docs.columns, *document_key()
    by_d, by_t, own = (free_name(k, names) for k in ("_loom_d", "_loom_t", "_loom_runs"))
    runs = repeated_runs(docs, least_words=least_words).select(F.col("d").alias(by_d), F.col("t").alias(by_t), F.col("runs").alias(own))
    keyed = docs.withColumns({by_d: d, by_t: t})
    joined = keyed.join(runs, [by_d, by_t], "left").select(*(keyed[f"`{c}`"] for c in names), runs[own])
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count_as, T.LongType())] if count_as else [])])
    at = next(i for i, c in enumerate(names) if c.lower() == "text")
    return joined.mapInArrow(_cut(at, names, count_as), schema)
