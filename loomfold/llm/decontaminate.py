"""Benchmark decontamination with a BM25 index and block-max WAND.

Test items are the indexed collection; every passage of every training document
is a query. A posting holds the term's BM25 contribution to an item as a share
of the item's score for its own text, so that one threshold serves all items.
Postings are grouped in blocks of items, each with its largest share, and a
passage is scored in three steps, each only where the one before leaves the
threshold possible: the sum of its terms' largest shares, the sums of their
block maxima, and the items of the remaining blocks. All items above the
threshold are retrieved and verified by the overlap of their question and of
their answer with the document around the passage: the share of their words found there in order.

Passages overlap by half and are twice as long as the longest item, so a leak
lies whole in one of them. Large benchmarks are split into shards of bounded size,
of which one pass over the documents takes SHARDS_A_PASS; term statistics and the
length of passages always are those of all items, so shards change no result.

Null texts and texts without words match nothing; equal items are all reported, and
of passages with one score the one with the larger overlaps; repeated rows give
repeated results, null ids are kept as they are; whole texts are read, however long.
An empty benchmark or table gives no rows. Only doc_id, item_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textio import LOWER, distinct_by_row, row_of, slices, span_hashes, utf8, words

K1, B = 1.2, 0.75
#: Items of a block.
BLOCK = 8
#: Text bytes of the items of one shard, about, and shards of one pass: they bound what a task holds.
SHARD_BYTES, SHARDS_A_PASS = 1 << 17, 16
#: Words by which a leaked item may drift from its alignment; a quarter of the item, if that is more.
DRIFT = 6
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column, and each row's first."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, _BREAK)
    return span_hashes(data, starts, ends), firsts


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: what follows the last inner sentence end, or the second half if that has under three words."""
    body = text.rstrip(".?!\n ")
    cut = max((body.rfind(s) for s in ".?!\n"), default=-1) + 1
    if min(len(text[:cut].split()), len(text[cut:].split())) < 3:
        cut = text.find(" ", len(text) // 2) + 1 or len(text)
    return text[:cut], text[cut:]


def overlaps(parts: list[np.ndarray], around: np.ndarray) -> list[float]:
    """Share of the words of each of an item's consecutive parts that ``around`` has in the same order and about the same place.

    The item is laid along ``around`` where most of its words agree, give or take a
    drift; a part's share is its longest common subsequence there, so words changed,
    put in or left out cost no more than themselves. A part without words has 1.
    """
    item = np.concatenate(parts)
    order = np.argsort(around, kind="stable")
    lo, hi = (np.searchsorted(around[order], item, side) for side in ("left", "right"))
    n = hi - lo
    i = np.repeat(np.arange(len(item)), n)
    j = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(i))]
    drift = max(DRIFT, len(item) // 4)
    cell = (j - i + len(item)) // drift + 1
    # words of the item with a match in two cells side by side
    pairs = np.unique(np.concatenate([cell, cell - 1]) * len(item) + np.tile(i, 2)) if len(i) else i
    first = int(np.bincount(pairs // max(1, len(item)), minlength=1).argmax())
    near = (cell == first) | (cell == first + 1)
    i, j = i[near], j[near]
    shares, start = [], 0
    for part in parts:
        own = (i >= start) & (i < start + len(part))
        tails: list[int] = []  # the least last place of a common subsequence of each length
        for place in j[own][np.lexsort((-j[own], i[own]))].tolist():
            at = bisect_left(tails, place)
            tails[at : at + 1] = [place]
        shares.append(len(tails) / len(part) if len(part) else 1.0)
        start += len(part)
    return shares


@dataclass
class Index:
    """Postings of one shard, by term in order of its hash."""

    items: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    block_max: np.ndarray
    block_starts: np.ndarray
    posting_item: np.ndarray
    posting_share: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    longest: int

    @classmethod
    def build(cls, items: list[tuple[int, str]], idf: dict[int, float], mean_length: float, longest: int) -> Index:
        items = sorted(items)
        h, firsts = hashed_words(pa.array([t for _, t in items], pa.large_string()))
        rows = row_of(firsts)
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        rows, h = rows[at], h[at]
        length = np.diff(firsts)[rows]
        share = np.array([idf[x] for x in h.view(np.int64).tolist()]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))
        own = np.bincount(rows, share, len(items))
        share = share / own[rows]
        order = np.lexsort((rows, h))
        rows, h, share = rows[order], h[order], share[order]
        terms, term_of = np.unique(h, return_inverse=True)
        block_max = np.zeros((len(terms), -(-max(1, len(items)) // BLOCK)), np.float32)
        block_starts = np.searchsorted(term_of * block_max.shape[1] + rows // BLOCK, np.arange(block_max.size + 1))
        np.maximum.at(block_max, (term_of, rows // BLOCK), share.astype(np.float32))
        halves = [[hashed_words(pa.array([part], pa.large_string()))[0] for part in split_item(t)] for _, t in items]
        return cls(
            np.array([i for i, _ in items], np.int64), terms, block_max.max(axis=1) if len(terms) else np.zeros(0, np.float32), block_max,
            block_starts, rows, share, [q for q, _ in halves], [a for _, a in halves], max(1, longest),
        )

    def candidates(self, h: np.ndarray, firsts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, first word, end word, item number, share) of passages and items at the threshold."""
        step = self.longest
        counts = np.diff(firsts)
        cells = np.maximum(1, -(-counts // step))
        cell_starts = np.concatenate([[0], np.cumsum(cells)])
        rows = row_of(firsts)
        cell = cell_starts[rows] + (np.arange(len(h)) - firsts[rows]) // step
        term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[term] == h
        cell, term = distinct_by_row(cell[known], term[known])
        slack = 1e-5
        bound = np.bincount(cell, self.most[term], cell_starts[-1])
        row_of_cell = np.repeat(np.arange(len(counts)), cells)
        # a passage is a cell and the one after it in the same row
        follows = np.append(row_of_cell[1:] == row_of_cell[:-1], False)
        nxt = np.where(follows, np.append(bound[1:], 0.0), 0.0)
        passages = np.flatnonzero(bound + nxt >= threshold - slack)
        if not len(passages):
            return
        ends = np.searchsorted(cell, np.arange(cell_starts[-1] + 1))
        wanted = np.zeros(cell_starts[-1], bool)
        wanted[passages] = True
        wanted[passages[follows[passages]] + 1] = True
        of = np.flatnonzero(wanted)
        place = np.full(cell_starts[-1] + 1, -1)
        place[of] = np.arange(len(of))
        in_wanted = wanted[cell]
        sums = np.zeros((len(of) + 1, self.block_max.shape[1]), np.float32)
        own_cells, own_terms = place[cell[in_wanted]], term[in_wanted]
        for lo in range(0, len(own_cells), 1 << 16):
            part = own_cells[lo : lo + (1 << 16)]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sums[part[at]] += np.add.reduceat(self.block_max[own_terms[lo : lo + (1 << 16)]], at, axis=0)
        totals = sums[place[passages]] + np.where(follows[passages][:, None], sums[place[passages + 1]], 0)
        p, block = np.nonzero(totals >= threshold - slack)
        c = passages[p]
        last = np.where(follows[c], c + 2, c + 1)
        # the items of these blocks, with terms of both cells counted twice, which only raises a share
        n = ends[last] - ends[c]
        pair = np.repeat(np.arange(len(p)), n)
        upto = np.cumsum(n) - n
        each = term[np.repeat(ends[c] - upto, n) + np.arange(len(pair))] * self.block_max.shape[1] + block[pair]
        lo, n = self.block_starts[each], self.block_starts[each + 1] - self.block_starts[each]
        pair, lo, n = pair[n > 0], lo[n > 0], n[n > 0]
        upto = np.cumsum(n) - n
        posting = np.repeat(lo - upto, n) + np.arange(n.sum())
        cell_of = np.repeat(pair, n) * BLOCK + self.posting_item[posting] % BLOCK
        shares = np.bincount(cell_of, self.posting_share[posting], len(p) * BLOCK)
        for k in np.flatnonzero(shares >= threshold - slack).tolist():
            k, item = k // BLOCK, int(block[k // BLOCK]) * BLOCK + k % BLOCK
            own = np.unique(term[ends[c[k]] : ends[last[k]]]) * self.block_max.shape[1] + block[k]
            near = np.concatenate([np.arange(self.block_starts[x], self.block_starts[x + 1]) for x in own.tolist()])
            share = float(self.posting_share[near[self.posting_item[near] == item]].sum())
            if share >= threshold:
                row = int(row_of_cell[c[k]])
                first = int(firsts[row] + (c[k] - cell_starts[row]) * step)
                yield row, first, min(first + 2 * step, int(firsts[row + 1])), item, share


def _matcher(shared, threshold: float, question: float, answer: float):
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, firsts = hashed_words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for index in shared.value:
                    for row, start, end, item, share in index.candidates(h, firsts, threshold):
                        q, a = index.questions[item], index.answers[item]
                        found = overlaps([q, a], h[start:end])
                        if found[0] >= question and found[1] >= answer and (len(q) or len(a)):
                            key = row, int(index.items[item])
                            best[key] = max(best.get(key, (0.0,)), (share, *found))
                if best:
                    rows = [(ids[r], i, *v) for (r, i), v in sorted(best.items())]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=names)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            h, firsts = hashed_words(part.column("text"))
            rows, distinct = distinct_by_row(row_of(firsts), h)
            yield pa.record_batch([part.column("shard").take(pa.array(rows)), pa.array(distinct.view(np.int64))], names=["shard", "h"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch([pa.array(np.diff(hashed_words(part.column("text"))[1]))], names=["n"])


def matches(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every leaked item.

    ``items`` has item_id and text; rows with a null in either are ignored. A
    document and an item give one row, with their best passage.
    """
    spark = docs.sparkSession
    out = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
    lengths = items.select("text").mapInArrow(_lengths, "n bigint")
    n, mean_length, longest = lengths.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(1))).first()
    postings = items.select("shard", "text").mapInArrow(_item_words, "shard int, h bigint")
    df = postings.groupBy("h").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards"))
    df = df if shards == 1 else materialize(df, "terms")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for first in range(0, shards, SHARDS_A_PASS):
        indexes = []
        for shard in range(first, min(first + SHARDS_A_PASS, shards)):  # each of bounded size
            own = [(r.item_id, r.text) for r in items.where(F.col("shard") == shard).collect()]
            counts = df.where(F.array_contains("shards", F.lit(shard))).select("h", "df").collect()
            idf = {r.h: float(np.log(1 + (n - r.df + 0.5) / (r.df + 0.5))) for r in counts}
            indexes += [Index.build(own, idf, mean_length, longest)] if idf else []
        if indexes:
            part = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(indexes), threshold, question, answer), out)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], out) if found is None else found
