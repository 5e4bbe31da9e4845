"""Quartile bucket digests of documents.

Byte triplets are hashed into ``BUCKETS`` buckets. A digest holds a length
code, the ratios of the bucket quartiles, and for every bucket two bits that
say between which quartiles its count lies. Digests are compared by a bounded
difference score, scaled to a likeness of 0 to 1.

Null and empty texts have the digest of no triplets; equal texts have equal
digests. Texts are processed whole, in slices of bounded size. Buckets whose
counts tie with a quartile count as not above it. Of the table only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textio import slices, utf8

BUCKETS = 128
#: Offsets of the byte triplets taken at each position.
TRIPLETS = ((0, 1, 2), (0, 2, 3))
MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
#: The difference at which likeness reaches 0.
FARTHEST = 320
_BODY_COST = np.array([0, 1, 2, 6])


def _bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    counts = np.zeros(n * BUCKETS, np.int64)
    wide = data.astype(np.uint32)
    for salt, picks in enumerate(TRIPLETS):
        reach = picks[-1]
        if len(data) <= reach:
            continue
        size = len(data) - reach
        h = np.full(size, salt * 0x1B873593, np.uint32)
        for p, m in zip(picks, MULTIPLIERS, strict=True):
            h += wide[p : p + size] * m
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        cell = rows[:size] * BUCKETS + (h >> np.uint32(25)).astype(np.int32)
        counts += np.bincount(cell[rows[:size] == rows[reach:]], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of codes for each text: length, two quartile ratios, then 0 to 3 for each bucket."""
    counts = _bucket_counts(data, offsets)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    out = np.zeros((len(counts), 3 + BUCKETS), np.uint8)
    lengths = np.diff(offsets)
    out[:, 0] = np.minimum(255, np.round(10 * np.log1p(lengths)))
    top = np.maximum(q3, 1)
    out[:, 1], out[:, 2] = 15 * q1 // top, 15 * q2 // top
    for q in (q1, q2, q3):
        out[:, 3:] += counts > q[:, None]
    return out


def encode(codes: np.ndarray) -> list[str]:
    """Hexadecimal digests, two digits of header each and two bits a bucket."""
    body = codes[:, 3:].reshape(len(codes), -1, 4)
    packed = (body << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    whole = np.concatenate([codes[:, :1], codes[:, 1:2] << 4 | codes[:, 2:3], packed], axis=1)
    return [row.tobytes().hex() for row in whole]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness by row: 1 for equal digests, 0 from a difference of ``FARTHEST`` on."""
    gap = np.abs(a.astype(np.int32) - b.astype(np.int32))
    cost = _BODY_COST[gap[:, 3:]].sum(axis=1) + np.minimum(gap[:, 0], 60) + 2 * gap[:, 1] + 2 * gap[:, 2]
    return 1.0 - np.minimum(cost, FARTHEST) / FARTHEST


def digests_of(texts: list[str]) -> np.ndarray:
    out = [digests(*utf8(b.column(0))) for b in slices(pa.record_batch([pa.array(texts, pa.large_string())], ["text"]))]
    return np.concatenate(out) if out else np.zeros((0, 3 + BUCKETS), np.uint8)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ENDS = "place int, first_text string, last_text string"


def _rows(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    """Result rows of ``texts``; ``after`` has the document that follows each."""
    changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
    own, other = digests_of(texts), digests_of(changed)
    following = np.concatenate([own[1:], digests_of(after[-1:])])
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(encode(own)), pa.array(encode(other)),
            pa.array(likeness(own, other)), pa.array(likeness(own, following)),
        ],
        names=[c.split()[0] for c in _SCHEMA.split(", ")],
    )


def _sorted_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition but for its last, then one row with its first and last texts."""
    first, held = None, None
    blank = lambda n: [pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
    ends = [c.split()[0] for c in _ENDS.split(", ")]
    for batch in batches:
        for part in slices(batch):
            ids = part.column("doc_id").to_pylist()
            texts = [t or "" for t in part.column("text").to_pylist()]
            first = texts[0] if first is None else first
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                out = _rows(ids[:-1], texts[:-1], texts[1:])
                yield pa.record_batch(out.columns + blank(len(out)), names=out.schema.names + ends)
    if held:
        out = _rows([held[0]], [held[1]], [""])
        tail = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([held[1]])]
        yield pa.record_batch(out.columns + tail, names=out.schema.names + ends)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.to_pydict()
        for i, text, after in zip(c["doc_id"], c["last_text"], c["next_text"], strict=True):
            yield _rows([i], [text or ""], [after or ""])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text, and its successor by descending ``doc_id``.

    Texts move once, in a range exchange by ``doc_id``. Only the last document
    of each partition needs a text of another; those go through a join of one
    row for each partition. Repeated ids are ordered by their texts, null ids
    come last. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    ranged = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    found = materialize(ranged.mapInArrow(_sorted_partition, f"{_SCHEMA}, {_ENDS}"), "fingerprints")
    whole = found.where("place is null").drop("place", "first_text", "last_text")
    ends = found.where("place is not null").select("doc_id", "place", "first_text", "last_text")
    places = sorted(r[0] for r in ends.select("place").collect())
    if not places:
        return whole
    chain = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, next_place int")
    heads = ends.select(F.col("place").alias("next_place"), F.col("first_text").alias("next_text"))
    last = ends.join(chain, "place").join(heads, "next_place").select("doc_id", "last_text", "next_text")
    return whole.unionByName(last.mapInArrow(_joined_ends, _SCHEMA))
