"""Language identification with bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the byte n-grams of its training texts. The
filters share their hash functions and are stored bit-sliced: one row for each
bit position, one bit of that row for each language. Looking up an n-gram and
ANDing its rows returns the bitmask of all languages that contain it. The hits
of a document are counted for each language, corrected for the filter's rate of
false positives, and the largest corrected count decides.

A filter holds every n-gram seen in the language's training texts, up to the size
it is made for: of more than ``per_language`` the most frequent ones, and ``left_out``
says what share of the language's n-gram occurrences the rest have. All training
texts are counted, in pieces, and only counts leave the tasks: of four bytes each, the
n-grams of a language are few beside its texts. A caller may ask for about
``max_training`` documents of each language instead, chosen by a hash of id and text, so
that texts that share an id are drawn apart.

Texts that are null or have no letter are ``und`` with score 0; so is every
text if nothing could be learned. Ties go to the first language by name. Whole
texts are read, however long; rows are judged alone, so repeated rows and null ids
change nothing. An empty table gives no rows. Of the table only doc_id, lang and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textio import BASE, LOWER, mix, segment_sums, slices, utf8

UNKNOWN = "und"
#: Bytes of an n-gram; it must fit 32 bits.
N = 4
_HASHES = 3
_ROWS = 1 << 21
#: Languages up to which their sizes are broadcast, a few bytes each.
BROADCAST_LANGUAGES = 100_000
#: Counts that a task of :func:`learn` holds, at most, before it passes them on.
_HELD = 1 << 20
#: Steps of explained shares from which thresholds are derived.
_STEPS = 10_000
#: Runs of these bytes count as one blank.
_BLANK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_FOLDED = np.where(_BLANK, 32, LOWER).astype(np.uint8)
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of folded texts as numbers, and each row's first one.

    ASCII letters are lower-cased; runs of other ASCII bytes become one blank.
    """
    folded = _FOLDED[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    cuts = offsets[:-1]
    keep[cuts[cuts < len(folded)]] = True
    kept = np.zeros(len(folded) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    folded, offsets = folded[keep], kept[offsets]
    size = max(0, len(folded) - N + 1)
    h = np.zeros(size, np.uint32)
    for i in range(N):
        h <<= np.uint32(8)
        h |= folded[i : i + size]
    whole = np.ones(size, bool)
    for k in range(1, N):  # those that would go on into the next row
        last = offsets[1:] - k
        last = last[last >= offsets[:-1]]
        whole[last[last < size]] = False
    firsts = np.zeros(len(offsets), np.int64)
    np.cumsum(np.maximum(np.diff(offsets) - N + 1, 0), out=firsts[1:])
    return h[whole], firsts


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of :func:`_windows`, and each row's first one."""
    h, firsts = _windows(data, offsets)
    return mix(h * BASE), firsts


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    found = segment_sums(_ASCII_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return found


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(_HASHES):
        yield (hashes >> np.uint64(21 * k)).astype(np.int64) & (_ROWS - 1)


@dataclass
class Filters:
    """Bit-sliced filters: ``slices[row, word]`` has a bit for each language."""

    languages: list[str]
    slices: np.ndarray
    left_out: dict[str, float] = field(default_factory=dict)

    @classmethod
    def build(cls, members: dict[str, np.ndarray], left_out: dict[str, float] | None = None) -> Filters:
        languages = sorted(members)
        table = np.zeros((_ROWS, max(1, -(-len(languages) // 64))), np.uint64)
        for i, name in enumerate(languages):
            for place in _places(members[name].astype(np.uint64)):
                table[place, i // 64] |= np.uint64(1 << (i % 64))
        return cls(languages, table, left_out or {})

    def false_positive_rates(self) -> np.ndarray:
        fill = [((self.slices[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.minimum(np.array(fill) ** _HASHES, 0.99)

    def masks(self, hashes: np.ndarray, word: int) -> np.ndarray:
        places = _places(hashes)
        out = self.slices[next(places), word]
        for place in places:
            out &= self.slices[place, word]
        return out

    def predict(self, column: pa.Array, rates: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the winner's part of all corrected hits) and the share of n-grams it explains."""
        return self.measure(column, rates)[:3]

    def measure(self, column: pa.Array, rates: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """What :meth:`predict` gives, and the number of n-grams."""
        data, offsets = utf8(column)
        hashes, firsts = grams(data, offsets)
        n = np.diff(firsts)
        hits = np.zeros((len(n), len(self.languages)))
        for word in range(self.slices.shape[1]):
            masks = self.masks(hashes, word)
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits[:, i] = segment_sums((masks >> np.uint64(i % 64)) & np.uint64(1), firsts)
        hits = np.clip((hits - n[:, None] * rates) / (1 - rates), 0, None)
        known = has_letter(data, offsets) & ~column.is_null().to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n)), n
        best = hits.argmax(axis=1)
        top = hits[np.arange(len(n)), best]
        score = np.where(known, np.where(top > 0, top / np.maximum(hits.sum(axis=1), 1e-9), 0.0), 0.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.clip(score, 0, 1), np.where(known, top / np.maximum(n, 1), 0.0), n


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language and half, summed within a task as far as it can hold them."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        lang = pa.array(list(names), pa.string()).take(pa.array((keys >> np.uint64(33)).astype(np.int64)))
        half = ((keys >> np.uint64(32)) & np.uint64(1)).astype(np.int8)
        hashes = mix((keys & np.uint64(0xFFFFFFFF)) * BASE)
        return pa.record_batch([lang, pa.array(half), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["lang", "half", "gram", "n"])

    for batch in batches:
        for part in slices(batch):
            own = np.array([names.setdefault(k, len(names)) for k in part.column("lang").to_pylist()], np.uint64)
            windows, firsts = _windows(*utf8(part.column("text")))
            group = (own << np.uint64(1)) | part.column("half").to_numpy().astype(np.uint64)
            keys = np.repeat(group << np.uint64(32), np.diff(firsts))
            keys |= windows
            held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > _HELD:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > _HELD // 2:
                    yield out(*held.pop())
    if held:
        yield out(*_summed(*map(np.concatenate, zip(*held, strict=True))))


def _drawn(rows: DataFrame, of: str, most: int) -> DataFrame:
    """About ``most`` rows of each lang, by a hash of id and text. The sizes by lang, written once, are broadcast if few."""
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n_docs")), "sizes")
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(of)), F.lit(1 << 20))
    return rows.join(F.broadcast(sizes) if few else sizes, "lang").where(turn < F.lit(float(most) * (1 << 20)) / F.col("n_docs")).select("lang", "half", "text")


def _rows(docs: DataFrame) -> DataFrame:
    """Rows with an id, a language and a text, and the half they belong to, by a hash of id and text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and lang is not null and text is not null").withColumn("half", F.pmod(F.xxhash64("doc_id", "text", F.lit("half")), F.lit(2)).cast("tinyint"))


def _counts(rows: DataFrame) -> DataFrame:
    """n of each lang, half and gram."""
    return rows.select("lang", "half", "text").mapInArrow(_counted, "lang string, half tinyint, gram bigint, n bigint").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def _fitted(counts: DataFrame, per_language: int) -> Filters:
    """Filters of the most frequent n-grams of each lang."""
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    held = counts.withColumns({"place": F.row_number().over(by_count), "upto": F.sum("n").over(by_count), "total": F.sum("n").over(Window.partitionBy("lang"))}).where(F.col("place") <= per_language)
    # at most per_language rows for each language
    table = held.select("lang", "gram", (1 - F.col("upto") / F.col("total")).alias("rest")).toArrow().to_pandas()
    return Filters.build({k: v.to_numpy() for k, v in table.groupby("lang")["gram"]}, table.groupby("lang")["rest"].min().to_dict())


def learn(docs: DataFrame, training: F.Column, *, max_training: int | None = None, per_language: int = 1 << 17) -> Filters:
    """Fit filters on rows of ``docs`` where ``training`` (over ``doc_id``) holds and lang is not null; on about ``max_training`` of each language if given."""
    rows = _rows(docs).where(training)
    rows = rows if max_training is None else _drawn(rows, "sample", max_training)
    return _fitted(_counts(rows), per_language)


def learn_halves(docs: DataFrame, *, per_language: int = 1 << 17) -> tuple[Filters, tuple[Filters, Filters]]:
    """Filters fitted on all labelled rows, and on each half of them, counted once."""
    counts = materialize(_counts(_rows(docs)), "grams")
    whole = _fitted(counts, per_language)
    halves = tuple(_fitted(counts.where(F.col("half") == k), per_language) for k in (0, 1))
    discard(counts)
    return whole, halves


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score and explained (the share of n-grams found) for every row."""
    rates = filters.false_positive_rates()
    shared = docs.sparkSession.sparkContext.broadcast((filters, rates))  # of a fixed number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fp = shared.value
        for batch in batches:
            for part in slices(batch):
                names, score, explained = own.predict(part.column("text"), fp)
                yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(explained)], names=["doc_id", "lang_pred", "score", "explained"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, explained double")


def least_shares(docs: DataFrame, filters: Filters, halves: tuple[Filters, Filters], lengths: tuple[int, ...], *, floor: float, quantile: float = 0.001, margin: float = 0.5, least_rows: int = 50) -> np.ndarray:
    """Least explained share by language (rows) and number of n-grams (columns: from each of ``lengths`` on; first of 0).

    That is ``margin`` times the low ``quantile`` (nearest rank, shares rounded down to a
    ten-thousandth) among all labelled documents of the same predicted language and length,
    each measured by the filters of the half it is not in (:func:`learn_halves`); ``floor``
    where they are under ``least_rows``. Texts under the first length are too short for
    the share to tell.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple((h, h.false_positive_rates()) for h in halves))  # of a fixed number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, (own, fp) in enumerate(reversed(shared.value)):
                for part in slices(batch.filter(pa.array(batch.column("half").to_numpy() == half))):
                    names, _, explained, n = own.measure(part.column("text"), fp)
                    steps = np.floor(np.clip(explained, 0, 1) * _STEPS).astype(np.int32)
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.searchsorted(lengths, n, "right")), pa.array(steps)], names=["lang", "length", "step"])

    shares = _rows(docs).select("half", "text").mapInArrow(run, "lang string, length bigint, step int").where((F.col("length") > 0) & (F.col("lang") != UNKNOWN))
    group = Window.partitionBy("lang", "length")
    steps = shares.groupBy("lang", "length", "step").agg(F.count("*").alias("n"))  # at most _STEPS + 1 for each language and length
    steps = steps.withColumns({"upto": F.sum("n").over(group.orderBy("step")), "total": F.sum("n").over(group)})
    low = steps.where((F.col("upto") >= quantile * F.col("total")) & (F.col("total") >= least_rows)).groupBy("lang", "length").agg(F.min("step").alias("step"))
    out = np.full((len(filters.languages), len(lengths) + 1), floor)
    out[:, 0] = 0.0
    for r in low.collect():  # one for each language and length
        out[filters.languages.index(r.lang), r.length] = max(floor, margin * r.step / _STEPS)
    return out


def in_known_language(docs: DataFrame, filters: Filters, least: np.ndarray, lengths: tuple[int, ...]) -> DataFrame:
    """Rows of ``docs`` that aren't ``und`` and that reach the shares of :func:`least_shares`.

    Each row is judged by its own text, whatever its doc_id.
    """
    rates = filters.false_positive_rates()
    shared = docs.sparkSession.sparkContext.broadcast((filters, rates))  # of a fixed number of rows
    text = next(c for c in docs.columns if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fp = shared.value
        for batch in batches:
            for part in slices(batch, text):
                names, _, explained, n = own.measure(part.column(text), fp)
                known = np.array(names) != UNKNOWN
                of = np.searchsorted(own.languages, np.where(known, names, own.languages[0]))
                yield part.filter(pa.array(known & (explained >= least[of, np.searchsorted(lengths, n, "right")])))

    return docs.mapInArrow(run, docs.schema)
