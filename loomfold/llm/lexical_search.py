"""Ranked lexical search: the best documents for each query, exactly.

One pass over the documents writes an index of the queries' terms: a row for each
segment of about ``segment_bytes`` of text, with the lengths of its documents and
the postings of each term in document order. Numbers of documents, of terms and of
documents with a term come from that index, so weights are those of all documents.

A segment answers a query in two ways at once. Lists shorter than a
``SHORT``-th of the segment's documents are gone through term at a time, and their
sums kept as one list of documents and scores. That list and the long lists are
then gone through document at a time, in blocks of ``BLOCK`` documents: each list
has its largest score in each block, and a block whose bounds sum to less than the
lowest score still wanted is skipped by all lists. What is wanted starts at the
``k``-th score found in one of ``FIRST`` segments, so most blocks of the others are
never read. Bounds are upper limits and equal scores are kept, so nothing is lost.

Null texts have no terms and texts of other rows never matter to them; repeated
rows are documents of their own, ranked side by side, null ids last among equal
scores; queries without terms, and terms in no document, give nothing; the texts
of one item_id are one query; whole texts are read, however long. Without documents
or queries there are no rows. Only doc_id, item_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textio import LOWER, row_of, slices, span_hashes, utf8, words

#: Bytes between terms: ASCII that is no letter or digit.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Documents of a block; a list is short with under 1/SHORT of its segment's documents.
BLOCK, SHORT = 128, 32
#: One of so many segments is searched first.
FIRST = 16
#: Text bytes of the queries that one pass over the documents takes: they bound the vocabulary that is broadcast.
QUERY_BYTES = 1 << 21
_INDEX = "docs bigint, words bigint, ids array<bigint>, lengths array<bigint>, terms array<int>, counts array<int>, places array<int>, tfs array<int>"
_NO_ID = np.int64((1 << 63) - 1)


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each term, which name it together, and each row's first term."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, _BREAK)
    return span_hashes(data, starts, ends), span_hashes(data, starts, ends, second=True), firsts


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            one, two, firsts = hashed_terms(part.column("text"))
            yield pa.record_batch([part.column("item_id").take(pa.array(row_of(firsts))), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["item_id", "one", "two"])


def _indexer(shared, segment_bytes: int):
    def segment(rows: list[tuple], words_in: int, docs: int) -> pa.RecordBatch:
        ids, lengths, term, place, tf = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((place, term))
        term, place, tf = term[order], place[order], tf[order]
        terms, counts = np.unique(term, return_counts=True)
        null = ids == _NO_ID
        values = [pa.array(ids, pa.int64(), mask=null), *(pa.array(x, t) for x, t in ((lengths, pa.int64()), (terms, pa.int32()), (counts, pa.int32()), (place, pa.int32()), (tf, pa.int32())))]
        columns = [pa.array([docs], pa.int64()), pa.array([words_in], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values)]
        return pa.record_batch(columns, names=[c.split()[0] for c in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = shared.value
        rows, held, docs, total, placed = [], 0, 0, 0, 0
        for batch in batches:
            for part in slices(batch):
                one, two, firsts = hashed_terms(part.column("text"))
                n = np.diff(firsts)
                at = np.minimum(np.searchsorted(ones, one), len(ones) - 1)
                known = (ones[at] == one) & (twos[at] == two)
                row, term = row_of(firsts)[known], at[known]
                pairs, tf = np.unique(row * len(ones) + term, return_counts=True)
                row, term = pairs // len(ones), pairs % len(ones)
                found, place = np.unique(row, return_inverse=True)
                ids = part.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
                rows.append((ids[found], n[found], term, place + placed, tf))
                held += len(one) * 8 + int(part.column("text").nbytes)
                docs, total, placed = docs + int((n > 0).sum()), total + int(n.sum()), placed + len(found)
                if held >= segment_bytes:
                    yield segment(rows, total, docs)
                    rows, held, docs, total, placed = [], 0, 0, 0, 0
        if rows:
            yield segment(rows, total, docs)

    return run


@dataclass
class Segment:
    """One row of the index, with the scores of its postings for a weight of 1 (times SCALE of the formula)."""

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    scores: np.ndarray
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def read(cls, row: dict[str, np.ndarray], n_docs: int, n_words: int) -> Segment:
        m = 10 + (90 * row["lengths"] * n_docs) // max(1, n_words)
        starts = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
        tf = row["tfs"].astype(np.int64)
        return cls(row["ids"], row["terms"], starts, row["places"].astype(np.int64), (1_000_000_000 * tf) // (1000 * tf + 8 * m[row["places"]]))

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A long list's first posting of each block, and its largest score there."""
        if term not in self.blocks:
            lo, hi = self.starts[term], self.starts[term + 1]
            firsts = lo + np.searchsorted(self.places[lo:hi], np.arange(self.n_blocks + 1) * BLOCK)
            most = np.zeros(self.n_blocks, np.int64)
            some = np.flatnonzero(firsts[1:] > firsts[:-1])
            if len(some):
                most[some] = np.maximum.reduceat(self.scores[lo:hi], firsts[some] - lo)
            self.blocks[term] = firsts, most
        return self.blocks[term]

    def best(self, query: list[tuple[int, int]], k: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best documents that score at least ``wanted``; ``query`` has terms and weights."""
        lists = []
        for term, weight in query:
            at = int(np.searchsorted(self.terms, term))
            if at < len(self.terms) and self.terms[at] == term and weight:
                lists.append((int(self.starts[at + 1] - self.starts[at]), at, weight))
        ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return ids, found
        short = [x for x in lists if x[0] * SHORT < len(self.ids)]
        long = [x for x in lists if x[0] * SHORT >= len(self.ids)]
        # term at a time: the short lists become one, with its bounds by block
        bounds = np.zeros(self.n_blocks, np.int64)
        place, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short:
            spans = [slice(self.starts[at], self.starts[at + 1]) for _, at, _ in short]
            place, inverse = np.unique(np.concatenate([self.places[s] for s in spans]), return_inverse=True)
            total = np.zeros(len(place), np.int64)
            np.add.at(total, inverse, np.concatenate([self.scores[s] * w for s, (_, _, w) in zip(spans, short, strict=True)]))
            np.maximum.at(bounds, place // BLOCK, total)
        edges = np.searchsorted(place, np.arange(self.n_blocks + 1) * BLOCK)
        blocked = [(*self.blocked(at), w) for _, at, w in long]
        for _, most, w in blocked:
            bounds += most * w
        # document at a time, over the blocks that may hold a wanted score
        wanted = max(1, wanted)
        for b in range(self.n_blocks):
            if bounds[b] < wanted:
                continue
            scores = np.zeros(BLOCK, np.int64)
            here = slice(edges[b], edges[b + 1])
            scores[place[here] - b * BLOCK] = total[here]
            for firsts, _, w in blocked:
                span = slice(firsts[b], firsts[b + 1])
                scores[self.places[span] - b * BLOCK] += self.scores[span] * w
            good = np.flatnonzero(scores >= wanted)
            if len(good):
                ids, found = np.concatenate([ids, self.ids[good + b * BLOCK]]), np.concatenate([found, scores[good]])
                if len(ids) >= k:
                    first = np.lexsort((ids, -found))[:k]
                    ids, found = ids[first], found[first]
                    wanted = max(wanted, int(found[-1])) if len(found) == k else wanted
        first = np.lexsort((ids, -found))[:k]
        return ids[first], found[first]


def _searcher(shared, k: int, n_docs: int, n_words: int):
    columns = ("ids", "lengths", "terms", "counts", "places", "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = shared.value
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r].values for c in columns}
                row["ids"] = row["ids"].fill_null(int(_NO_ID))
                segment = Segment.read({c: v.to_numpy(zero_copy_only=False) for c, v in row.items()}, n_docs, n_words)
                found = [(number, *segment.best(query, k, wanted.get(number, 1))) for number, query in enumerate(queries)]
                number = np.concatenate([np.full(len(ids), n, np.int32) for n, ids, _ in found])
                ids = np.concatenate([x for _, x, _ in found])
                yield pa.record_batch([pa.array(number), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([x for _, _, x in found]))], names=["number", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """``found`` with the ranks up to ``k`` by item number; Spark drops what cannot rank before it shuffles."""
    by_item = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)


def _pass(docs: DataFrame, own: DataFrame, k: int, segment_bytes: int) -> DataFrame:
    """The ranking for the queries whose terms (item_id, one, two) are ``own``: as many as one broadcast may hold."""
    spark = docs.sparkSession
    pairs = sorted({(r.one % (1 << 64), r.two % (1 << 64)) for r in own.select("one", "two").distinct().collect()})
    hashes = [np.array(x, np.uint64) for x in zip(*pairs, strict=True)]
    number_of = {pair: n for n, pair in enumerate(pairs)}
    terms_of: dict[int | None, set[int]] = {}
    for r in own.distinct().collect():
        terms_of.setdefault(r.item_id, set()).add(number_of[r.one % (1 << 64), r.two % (1 << 64)])
    items = sorted(terms_of, key=lambda x: (x is None, x))
    index = materialize(docs.mapInArrow(_indexer(spark.sparkContext.broadcast(hashes), segment_bytes), _INDEX), "index")
    n_docs, n_words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    by_term = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weight = {r.terms: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in by_term.collect()}
    queries = [[(t, weight[t]) for t in sorted(terms_of[i]) if t in weight] for i in items]

    # a segment is small to read and long to search, so segments are dealt out one by one
    tasks = max(1, min(index.count(), 8 * spark.sparkContext.defaultParallelism))

    def search(segments: DataFrame, wanted: dict[int, int]) -> DataFrame:
        columns = segments.select("ids", "lengths", "terms", "counts", "places", "tfs").repartition(tasks)
        return columns.mapInArrow(_searcher(spark.sparkContext.broadcast((queries, wanted)), k, n_docs, n_words), "number int, doc_id bigint, score bigint")

    of_first = F.pmod(F.xxhash64("docs", "words", F.element_at("ids", 1)), F.lit(FIRST)) == 0
    seen = _top(search(index.where((F.size("ids") > 0) & of_first), {}), k).where(F.col("rank") == k)
    wanted = {r.number: r.score for r in seen.select("number", "score").collect()}  # a number for each query
    top = materialize(_top(search(index, wanted), k), "ranked")
    discard(index)
    # the queries are few and their ids were read here: their order is the number
    ids = spark.createDataFrame([(n, i) for n, i in enumerate(items)], "number int, item_id bigint")
    return top.join(ids, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, *, k: int = 10, segment_bytes: int = 1 << 25) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item.

    ``docs`` has doc_id and text, ``items`` item_id and text. Items are dealt to
    passes of about QUERY_BYTES of text by a hash of their id; a pass reads all documents once.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // QUERY_BYTES))
    items = items.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    found = None
    for n in range(passes):
        own = items.where(F.col("pass") == n).select("item_id", "text").mapInArrow(_query_terms, "item_id bigint, one bigint, two bigint").distinct()
        if own.isEmpty():
            continue
        part = _pass(docs, own, k, segment_bytes)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if found is None else found
