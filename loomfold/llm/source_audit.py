"""How the word use of each source differs from its language and from other sources.

Terms are counted where the texts are: the terms of a slice of documents are
packed by length, up to 8 bytes into one big-endian unsigned 64-bit word and up
to 16 into two; these are radix-sorted, 16 bits a pass, and their runs counted.
Longer terms go to buckets of one byte length each, which are sorted as byte
strings. Only the counts by language, source and term leave a task; Spark sums
them, keeps the terms in enough documents of the language, and compares smoothed
shares in whole numbers.

Distances of all sources of a language are summed by tiles: a tile holds two
blocks of ``BLOCK`` sources and one bucket of terms, read in order of the terms,
so a task's memory does not depend on the number of terms, sources or documents.
Terms that neither of two sources has add the same to their distance each, so
their number is enough.

Null text, language and source are empty; texts without terms, and languages
without kept terms, still give their groups. Repeated rows count as often as they
stand there. Equal values rank by the bytes of the item. A slice is one text at
least, however long: memory is about ten times a text. An empty table gives no
rows. Only lang, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textio import LOWER, row_of, slices, utf8, words

#: Bytes between terms: ASCII that is no letter.
_BREAK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: Text bytes that are counted together, about.
SLICE = 1 << 22
#: Shares are counted in parts of SCALE; PRIOR is added to each count.
SCALE, PRIOR = 1_000_000_000, 5
#: Sources of a block, terms compared at once, and kept counts of a bucket of terms, about.
BLOCK, TERMS, BUCKET = 256, 512, 50_000
_HIGH = np.array([0] + [~0 << (64 - 8 * n) & (1 << 64) - 1 for n in range(1, 9)], np.uint64)


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by unsigned 64-bit keys, the most significant first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(changed: np.ndarray, order: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An item of each run, its length and its number of rows; ``changed`` marks the first of each run in ``order``."""
    at = np.flatnonzero(changed)
    other_row = changed.copy()
    other_row[1:] |= rows[order][1:] != rows[order][:-1]
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other_row.astype(np.int64), at) if len(at) else at


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and rows of each distinct term of each group; ``group`` is by row."""
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, _BREAK)
    length, rows = ends - starts, row_of(firsts)
    of = group[rows].astype(np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eights = np.ndarray(len(data) + 9, ">u8", padded, strides=(1,))
    found = []
    for few, most in ((1, 8), (9, 16)):
        pick = np.flatnonzero((length >= few) & (length <= most))
        n = length[pick]
        packed = [eights[starts[pick]] & _HIGH[np.minimum(n, 8)]]
        if most > 8:
            packed.append(eights[starts[pick] + 8] & _HIGH[n - 8])
        keys = [of[pick], *(k.astype(np.uint64) for k in packed)]
        order = radix_order(*keys)
        changed = np.ones(len(pick), bool)
        changed[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        item, count, docs = _runs(changed, order, rows[pick])
        found.append((pick[item], count, docs))
    long = np.flatnonzero(length > 16)
    long = long[np.argsort(length[long], kind="stable")]
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(length[long]) > 0)), len(long)) if len(long) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        pick = long[lo:hi]
        size = int(length[pick[0]])
        text = np.ascontiguousarray(data[starts[pick][:, None] + np.arange(size)]).view(f"S{size}")[:, 0]
        order = np.argsort(text, kind="stable")
        order = order[np.argsort(of[pick][order], kind="stable")]
        changed = np.ones(len(pick), bool)
        changed[1:] = (text[order][1:] != text[order][:-1]) | (of[pick][order][1:] != of[pick][order][:-1])
        item, count, docs = _runs(changed, order, rows[pick])
        found.append((pick[item], count, docs))
    token, count, docs = (np.concatenate(x) for x in zip(*found, strict=True))
    ends_at = np.concatenate([[0], np.cumsum(length[token])])
    taken = data[np.repeat(starts[token] - ends_at[:-1], length[token]) + np.arange(ends_at[-1])]
    terms = pa.Array.from_buffers(pa.large_string(), len(token), [None, pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(taken)])
    return of[token].astype(np.int64), terms, count, docs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            lang, source = (pc.fill_null(part.column(c), "").dictionary_encode() for c in ("lang", "source"))
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            codes, group = np.unique(code, return_inverse=True)
            of, terms, count, docs = count_terms(*utf8(part.column("text")), group)
            of = np.concatenate([of, np.arange(len(codes))])  # each group also without a term
            none = np.zeros(len(codes), np.int64)
            term = pa.concat_arrays([terms, pa.nulls(len(codes), pa.large_string())]).cast(pa.string())
            columns = [lang.dictionary.take(pa.array(codes[of] // len(source.dictionary))), source.dictionary.take(pa.array(codes[of] % len(source.dictionary)))]
            yield pa.record_batch([*columns, term, pa.array(np.concatenate([count, none])), pa.array(np.concatenate([docs, none]))], names=names)


def _share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; null without terms."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(38,0)) * ({count} + {PRIOR})) div nullif({total} + {PRIOR} * {terms}, 0) AS BIGINT)")


class _Tile:
    """Sums of absolute differences between the sources of two blocks, over terms as they come."""

    def __init__(self, key: tuple, left: np.ndarray, right: np.ndarray, base: np.ndarray):
        """``base``: the share of an absent term by column, -1 for no source; left columns and right columns are equal for a tile of one block."""
        self.key, self.left, self.right, self.base = key, left, right, base
        self.sums, self.terms = np.zeros((len(left), len(right)), np.int64), 0

    def add(self, term: np.ndarray, column: np.ndarray, share: np.ndarray) -> None:
        """Terms numbered from 0 in ascending order, each whole."""
        for lo in range(0, int(term[-1]) + 1, TERMS):
            here = slice(*np.searchsorted(term, [lo, lo + TERMS]))
            table = np.tile(self.base, (min(TERMS, int(term[-1]) + 1 - lo), 1))
            table[term[here] - lo, column[here]] = share[here]
            others = table[:, self.right]
            for k, a in enumerate(self.left):
                self.sums[k] += np.abs(others - table[:, a, None]).sum(axis=0)
        self.terms += int(term[-1]) + 1

    def rows(self) -> pa.RecordBatch:
        lang, i, j = self.key
        a, b = np.meshgrid(self.left + i * BLOCK, self.right % BLOCK + j * BLOCK, indexing="ij")
        once = a < b
        n = int(once.sum())
        return pa.record_batch([pa.array([lang] * n, pa.string()), pa.array(a[once]), pa.array(b[once]), pa.array(self.sums[once]), pa.array([self.terms] * n, pa.int64())], names=["lang", "a", "b", "total", "terms"])


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile and bucket, its sources (null term, share of an absent term) first, then by term."""
    tile: _Tile | None = None
    current, base, held = None, None, []

    def flush(whole: bool) -> None:
        """Add the held rows to the tile; the last term stays unless the tile is ``whole``."""
        nonlocal tile, held
        if not held:
            return
        term, column, share = pa.chunked_array([h[0] for h in held]).combine_chunks(), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        new = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) if len(term) > 1 else np.ones(len(term), bool)
        stop = len(term) if whole else int(np.flatnonzero(new)[-1])
        held = [] if whole else [(term[stop:], column[stop:], share[stop:])]
        if stop:
            if tile is None:
                left, right = (np.flatnonzero(base[lo : lo + BLOCK] >= 0) + lo for lo in (0, BLOCK if current[1] != current[2] else 0))
                tile = _Tile(current[:3], left, right, base)
            tile.add((np.cumsum(new) - 1)[:stop], column[:stop], share[:stop])

    for batch in batches:
        lang, keys = batch.column("lang"), [batch.column(c).to_numpy() for c in ("i", "j", "bucket")]
        changed = np.ones(len(lang), bool)
        if len(lang) > 1:
            changed[1:] = np.any([pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False), *(k[1:] != k[:-1] for k in keys)], axis=0)
        cuts = np.append(np.flatnonzero(changed), len(lang)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = (lang[lo].as_py(), *(int(k[lo]) for k in keys))
            if key != current:
                flush(True)
                if tile:
                    yield tile.rows()
                tile, current, base = None, key, np.full(BLOCK * (1 + (key[1] != key[2])), -1, np.int64)
            term = batch.column("term")[lo:hi]
            block, slot, share = (batch.column(c)[lo:hi].to_numpy() for c in ("block", "slot", "share"))
            column = slot + BLOCK * (block != key[1])
            heads = term.null_count  # null terms come first
            base[column[:heads]] = share[:heads]
            if heads < len(term):
                held.append((term[heads:], column[heads:], share[heads:]))
        if sum(len(h[1]) for h in held) > BLOCK * TERMS:
            flush(False)
    flush(True)
    if tile:
        yield tile.rows()


def _distances(kept: DataFrame, groups: DataFrame, entries: int) -> DataFrame:
    """lang, source, item, value of each source and each other one of its language; ``groups`` has a place by language."""
    blocks = F.max(F.col("place")).over(Window.partitionBy("lang").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = groups.withColumns({"block": F.floor(F.col("place") / BLOCK).cast("int"), "slot": F.pmod("place", F.lit(BLOCK)).cast("int"), "blocks": (F.floor(blocks / BLOCK) + 1).cast("int")})
    most = placed.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    buckets = max(1, -(-entries // BUCKET) * 2 // (most + 1))
    tiles = {"other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}
    columns = ["lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "bucket", "term", "block", "slot", "share"]
    heads = placed.where("terms > 0").withColumns(tiles).withColumns({"bucket": F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))), "term": F.lit(None).cast("string"), "share": F.col("absent")})
    rows = kept.join(placed.select("lang", "source", "block", "slot", "blocks"), ["lang", "source"]).withColumns(tiles).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    both = heads.select(*columns).unionByName(rows.select(*columns))
    dealt = both.repartition("lang", "i", "j", "bucket").sortWithinPartitions("lang", "i", "j", "bucket", F.asc_nulls_first("term"))
    sums = dealt.mapInArrow(_tile_sums, "lang string, a bigint, b bigint, total bigint, terms bigint").groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("terms").alias("seen"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("place"), F.col("b").alias("of")), F.struct(F.col("b").alias("place"), F.col("a").alias("of"))))
    sums = sums.select("lang", ends.alias("pair"), "total", "seen").select("lang", "pair.place", "pair.of", "total", "seen")
    # every pair of sources of a language is asked for, those of languages without kept terms too
    one = groups.select("lang", "source", "place", "absent", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("of"), F.col("absent").alias("other_absent"))
    pairs = one.join(other, "lang").where("place != of").join(sums, ["lang", "place", "of"], "left")
    value = F.coalesce("total", F.lit(0)) + (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.abs(F.coalesce("absent", F.lit(0)) - F.coalesce("other_absent", F.lit(0)))
    return pairs.select("lang", "source", "item", value.cast("bigint").alias("value"))


def audit(docs: DataFrame, *, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: distances to other sources, and the terms a source uses more than its language.

    ``docs`` has text, lang and source. Terms in at least ``least_docs`` documents
    of their language are kept; of terms the first ``top_terms`` are returned.
    """
    text = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    counted = text.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    of_term = Window.partitionBy("lang", "term")
    whole = of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = counts.where("term is not null").withColumns({"lang_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "head": (F.row_number().over(of_term.orderBy("source")) == 1).cast("bigint")})
    kept = materialize(known.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "head"), "kept")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("terms"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0)
    groups = groups.withColumns({"place": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1, "absent": _share(0, "total", "terms")})
    groups = materialize(groups, "groups")
    discard(counts)
    shares = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    shares = shares.withColumns({"share": _share("n", "total", "terms"), "of_lang": _share("lang_n", "lang_total", "terms")})
    by_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(by_source)
    more = shares.where("share > of_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("of_lang")).alias("value"))
    pairs = _distances(shares.select("lang", "source", "term", "share"), groups, kept.count()).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top_terms).select(*columns))
