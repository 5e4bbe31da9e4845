"""Near-duplicate documents by banded MinHash and sequential Bayesian verification.

1. Documents with equal shingle sets collapse to a class with one signature.
2. Signatures are cut into bands; classes that share a band's value share a
   bucket. A pair is compared signature batch after signature batch, and dropped
   once the posterior probability that its similarity reaches the threshold is
   below ``miss``; survivors are verified on their full sets. Every class first
   meets the smallest class among all its buckets, which settles most groups with
   one pair for each class.
3. Buckets that still hold several components are compared inside, block by block.
   Each class puts forward its likeliest partner of another component; these pairs
   are verified.
4. In buckets that are still mixed, all pairs between components that the
   signatures leave possible are verified, block by block with the sets at hand,
   but for those that a confirmed link has joined meanwhile.

A pair that shares several bands is compared in the bucket of the first one only.

Classes of mixed buckets with over BLOCK classes are first counted for shingles
that no other of them has. These can be in no intersection, which bounds a class's
similarity to all others of these buckets, exactly; so classes that share boilerplate
only leave them before any pair is made. Their smaller buckets may hold other classes,
for which the bound does not hold, and keep them.

A bucket of n classes is cut into at most MOST_BLOCKS blocks (more where a block
would pass BLOCK_ROWS rows or BLOCK_BYTES), and each class is sent once for each
block: up to MOST_BLOCKS * BLOCK_ROWS classes that is a constant number of rows for
each class and bucket. Comparisons inside remain quadratic where classes are many,
alike below the threshold and without shingles of their own.

Nulls and texts without words have no shingles and link with nothing. Very long
texts are read whole; their sets make smaller blocks. Rows with the same doc_id are
one node, which links by each of their texts: classes have numbers of their own, in
order of the smallest doc_id. Repeated rows get equal results, ties go to the
smaller number, rows with a null doc_id are returned unlinked, with a null
component, kept. An empty table gives no rows. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import shingles, signatures
from .storage import discard, materialize
from .textio import mix, segment_sums, slices

BANDS, WIDTH = 32, 4
HASHES = BANDS * WIDTH
#: Hashes compared between two looks at the posterior.
BATCH = 16
#: Columns that name a class.
KEY = ["key1", "key2", "n_shingles"]
#: Rows of one block of a bucket where that makes no more than MOST_BLOCKS.
BLOCK, MOST_BLOCKS = 512, 8
#: Rows and bytes of a block, about, at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 25


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, matches needed): below, P(similarity >= threshold) < miss for a uniform prior."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, h = shingles(part.column("text"), size)
                firsts = np.searchsorted(rows, np.arange(len(part) + 1))
                sig = signatures(h, firsts, HASHES)
                key = [segment_sums(mix(h ^ np.uint64(s)), firsts).view(np.int64) for s in (1, 2)]
                sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), len(part), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(firsts)), *map(pa.array, key), sigs], names=["doc_id", "n_shingles", "key1", "key2", "sig"])

    return run


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _buckets(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    acc = np.tile(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), 1))
    for j in range(WIDTH):
        acc = mix(acc ^ sig[:, j::WIDTH].astype(np.uint64))
    return acc.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        ids = np.repeat(batch.column("rep").to_numpy(), BANDS)
        yield pa.record_batch([pa.array(ids), pa.array(_buckets(_signatures_of(batch.column("sig"))).ravel())], names=["rep", "bucket"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, h = shingles(part.column("text"), size)
                firsts = np.searchsorted(rows, np.arange(len(part) + 1))
                key = [segment_sums(mix(h ^ np.uint64(s)), firsts).view(np.int64) for s in (1, 2)]
                held = [h[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(firsts)), *map(pa.array, key), pa.array(held, pa.binary())], names=["doc_id", "n_shingles", "key1", "key2", "held"])

    return run


def _possible(x: np.ndarray, y: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures, row by row, that no look at the posterior drops, and their matches."""
    at, matches, seen = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for upto, least in needed:
        matches = matches + (x[at, seen:upto] == y[at, seen:upto]).sum(axis=1)
        keep = matches >= least
        at, matches, seen = at[keep], matches[keep], upto
    return at, matches


def _confirmed(percent: int, miss: float):
    """Pairs that their signatures leave possible and their sets confirm."""
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = _possible(_signatures_of(batch.column("sig_a")), _signatures_of(batch.column("sig_b")), needed)
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = [i for i in at.tolist() if _jaccard_at_least(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


#: Pairs compared at once.
_PAIRS = 1 << 16


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole (bucket, i, j) groups from rows sorted by them."""
    pending = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if pending is None else [pending, batch]).combine_chunks()
        if not len(table):
            continue
        batch = table.to_batches()[0]
        key = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        at = int(new[-1]) if len(new) else 0
        if at:
            yield batch.slice(0, at)
        pending = batch.slice(at)
    if pending is not None and len(pending):
        yield pending


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _survivors(batch: pa.RecordBatch, percent: int, needed: list[tuple[int, int]], root: np.ndarray | None = None) -> Iterator[Pairs]:
    """Rows of pairs within groups, of different components, that stay possible, and their matches.

    A pair counts in the first band that it shares only. ``root``, changed between steps, joins components further on.
    """
    bucket, i, j, side, component, size = (batch.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "component", "n_shingles"))
    common = batch.column("common").to_numpy()
    sig = _signatures_of(batch.column("sig"))
    band = np.argmax(_buckets(sig) == bucket[:, None], axis=1)
    n = len(batch)
    root = component if root is None else root
    new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    end = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
    partners = end - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(partners)])
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + _PAIRS, "right")) - 1)
        rows = np.arange(start, stop)
        left = np.repeat(rows, partners[start:stop])
        right = left + 1 + np.arange(len(left)) - (upto[left] - upto[start])
        start = stop
        a, b = size[left], size[right]
        most = np.minimum(np.minimum(a, b), np.minimum(common[left], common[right]))
        fits = (root[left] != root[right]) & ((i[left] == j[left]) | (side[left] != side[right])) & ((100 + percent) * most >= percent * (a + b))
        left, right = left[fits], right[fits]
        at, matches = _possible(sig[left], sig[right], needed)
        left, right = left[at], right[at]
        shared = (sig[left] == sig[right]).reshape(-1, BANDS, WIDTH).all(axis=2)
        here = np.argmax(shared, axis=1) == band[left]
        if here.any():
            yield left[here], right[here], matches[here]


def _likeliest(percent: int, miss: float):
    """For each row the partner with most matches."""
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            rep = batch.column("rep").to_numpy()
            best = np.full(len(rep), -1, np.int64)  # matches, then the smaller partner
            partner = np.zeros(len(rep), np.int64)
            for left, right, matches in _survivors(batch, percent, needed):
                one, other, m = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([matches, matches])
                order = np.lexsort((rep[other], -m, one))
                first = order[np.append(True, one[order][1:] != one[order][:-1])]
                one, other, m = one[first], rep[other[first]], m[first]
                better = (m > best[one]) | ((m == best[one]) & (other < partner[one]))
                best[one[better]], partner[one[better]] = m[better], other[better]
            at = np.flatnonzero(best >= 0)
            yield pa.record_batch([pa.array(x[at]) for x in (rep, best, partner)], names=["rep", "matches", "other"])

    return run


_OPEN = ["bucket", "i", "j", "side", "rep", "n_shingles", "common", "component", "sig"]


def _open_rows(percent: int, miss: float):
    """Rows that have possible partners in another component."""
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            is_open = np.zeros(len(batch), bool)
            for left, right, _ in _survivors(batch, percent, needed):
                is_open[left] = is_open[right] = True
            yield batch.select(_OPEN).take(pa.array(np.flatnonzero(is_open)))

    return run


def _jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def overlaps(values: np.ndarray, firsts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, all of the pairs of one left set at once.

    Of the right sets, only what is in some left set is looked up. A left set that
    pairs with few of them reads these alone.
    """
    lefts, rights = np.unique(left), np.unique(right)
    sets = [values[firsts[x] : firsts[x + 1]] for x in lefts]
    union = np.unique(np.concatenate(sets))
    sizes = firsts[rights + 1] - firsts[rights]
    starts = np.cumsum(sizes) - sizes
    h = values[np.repeat(firsts[rights] - starts, sizes) + np.arange(sizes.sum())]
    place = np.minimum(np.searchsorted(union, h), max(0, len(union) - 1))
    hit = union[place] == h
    place = place[hit]
    upto = np.concatenate([[0], np.cumsum(hit)])[np.append(starts, sizes.sum())]
    out, of = np.zeros(len(left), np.int64), np.searchsorted(rights, right)
    order = np.argsort(left, kind="stable")
    flag = np.zeros(len(union), np.int8)
    for own, at in zip(sets, np.split(order, np.searchsorted(left[order], lefts[1:])), strict=True):
        own = np.searchsorted(union, own)
        flag[own] = 1
        begin, end = upto[of[at]], upto[of[at] + 1]
        ends = np.cumsum(end - begin)
        if 2 * ends[-1] < len(place):
            begin, end, read = ends - (end - begin), ends, np.repeat(end - ends, end - begin) + np.arange(ends[-1])
            found = flag[place[read]]
        else:
            found = flag[place]
        sums = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
        out[at] = sums[end] - sums[begin]
        flag[own] = 0
    return out


def _settled(percent: int, miss: float):
    """Links that join the components of a pair of blocks, at most one fewer than its rows."""
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            rep, size = batch.column("rep").to_numpy(), batch.column("n_shingles").to_numpy()
            held = batch.column("held").cast(pa.large_binary())
            firsts = np.concatenate([[0], np.cumsum(size)])
            values = np.frombuffer(b"".join(held.to_pylist()), np.uint64)
            # components apart for each group, as numbers from 0
            key = [batch.column(c).to_numpy() for c in ("bucket", "i", "j", "component")]
            root = np.unique(np.stack(key, axis=1), axis=0, return_inverse=True)[1].ravel()
            found = []
            for left, right, _ in _survivors(batch, percent, needed, root):
                both = overlaps(values, firsts, left, right)
                linked = np.flatnonzero(100 * both >= percent * (size[left] + size[right] - both))
                for x, y in zip(left[linked].tolist(), right[linked].tolist(), strict=True):
                    if root[x] != root[y]:
                        root[root == root[y]] = root[x]
                        found.append((int(rep[x]), int(rep[y])))
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each class."""
    for batch in batches:
        for part in slices(batch, "held", 1 << 22):
            sets = part.column("held").to_pylist()
            h = np.frombuffer(b"".join(sets), np.int64)
            yield pa.record_batch([pa.array(np.repeat(part.column("rep").to_numpy(), [len(x) // 8 for x in sets])), pa.array(h)], names=["rep", "h"])


def without_own_shingles(rows: DataFrame, held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, common): how many shingles of each class of ``rows`` any other of them has."""
    members = rows.select("rep").distinct()
    each = held.select("rep", "held").join(members, "rep", "left_semi").mapInArrow(_exploded, "rep bigint, h bigint")
    own = each.groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    return members.join(sizes, "rep").join(own, "rep", "left").select("rep", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("common"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents link when their sets of ``size``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; a component is all that links
    reach, its id the smallest doc_id in it.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(_signed(size), "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, sig binary"), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    grouped = some.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    ordered = grouped.repartitionByRange("doc_id", *KEY).sortWithinPartitions("doc_id", *KEY)
    classes = materialize(ordered.withColumn("rep", F.monotonically_increasing_id()), "classes")
    by_rep = classes.select("rep", "sig", "n_shingles")
    banded = by_rep.select("rep", "sig").mapInArrow(_banded, "rep bigint, bucket bigint")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
    shared = materialize(banded.join(buckets, "bucket"), "buckets")
    involved = classes.select("doc_id", *KEY, "rep", "sig").join(shared.select("rep").distinct(), "rep", "left_semi")
    held = texts.join(involved.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, held binary")
    held = held.groupBy("doc_id", *KEY).agg(F.first("held").alias("held"))
    held = materialize(held.join(involved, ["doc_id", *KEY]).select("rep", "held", "sig"), "sets")

    same_id = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    same_id = some.join(same_id, "doc_id").select("doc_id", *KEY).distinct().join(classes.select(*KEY, "rep"), KEY)
    several = materialize(same_id.select("doc_id", "rep"), "ids")
    same_id = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a != b")

    spent = [shared, held, several]

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(held.select(F.col("rep").alias("b"), F.col("held").alias("set_b"), F.col("sig").alias("sig_b")), "b")
        joined = joined.join(held.select(F.col("rep").alias("a"), F.col("held").alias("set_a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "set_a", "set_b", "sig_a", "sig_b")
        spent.append(materialize(joined.mapInArrow(_confirmed(percent, miss), "a bigint, b bigint"), "links"))
        return spent[-1]

    def mixed_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
        """Rows of the buckets with several components."""
        labelled = rows.drop("component").join(state.withColumnRenamed("node", "rep"), "rep", "left")
        labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
        mixed = labelled.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("bucket")
        return labelled.join(mixed, "bucket")

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Rows once for each pair of blocks they stand in."""
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("own_rows"), F.sum(F.col("n_shingles") * 8 + 4 * HASHES).alias("own_bytes"))
        blocks = F.greatest(F.least(F.ceil(F.col("own_rows") / BLOCK), F.lit(MOST_BLOCKS)), F.ceil(F.col("own_rows") / BLOCK_ROWS), F.ceil(F.col("own_bytes") / BLOCK_BYTES))
        rows = rows.join(sizes.select("bucket", blocks.cast("int").alias("blocks")), "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("bucket", "rep", "n_shingles", "common", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        return rows.join(by_rep.select("rep", "sig"), "rep")

    def edges(state: DataFrame) -> DataFrame:
        return state.select(F.col("component").alias("a"), F.col("node").alias("b"))

    def by_group(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    first = shared.groupBy("rep").agg(F.min("leader").alias("a")).select("a", F.col("rep").alias("b")).where("a != b")
    state = connected_components(verified(first).union(same_id))

    sizes = by_rep.select("rep", "n_shingles")
    mixed = materialize(mixed_rows(shared.select("bucket", "n", "rep").join(sizes, "rep"), state), "mixed")
    large = mixed.where(F.col("n") > BLOCK)
    common = materialize(without_own_shingles(large, held, sizes), "common")
    # percent times the size of the largest class that can be near, were all common shingles in it
    bounded = mixed.join(common, "rep", "left").withColumn("common", F.coalesce(F.when(F.col("n") > BLOCK, F.col("common")), "n_shingles"))
    bounded = bounded.withColumn("reach", (100 + percent) * F.col("common") - percent * F.col("n_shingles")).where(100 * F.col("reach") >= percent * percent * F.col("n_shingles"))
    least = bounded.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    bounded = materialize(bounded.join(least, "bucket").where(F.col("reach") >= percent * F.col("least")).drop("reach", "least", "n"), "bounded")
    likeliest = by_group(in_blocks(bounded)).mapInArrow(_likeliest(percent, miss), "rep bigint, matches bigint, other bigint")
    likeliest = likeliest.groupBy("rep").agg(F.max(F.struct("matches", (-F.col("other")).alias("other"))).alias("best")).select(F.least("rep", -F.col("best.other")).alias("a"), F.greatest("rep", -F.col("best.other")).alias("b"))
    pairs = materialize(likeliest.distinct(), "pairs")
    found = verified(pairs)
    spent += [pairs, mixed, common, bounded]
    if not found.isEmpty():
        spent.append(state)
        state = connected_components(edges(state).union(found))

    schema = "bucket bigint, i int, j int, side int, rep bigint, n_shingles bigint, common bigint, component bigint, sig binary"
    left = materialize(by_group(in_blocks(mixed_rows(bounded, state))).mapInArrow(_open_rows(percent, miss), schema), "open")
    if not left.isEmpty():
        settled = by_group(left.join(held.select("rep", "held"), "rep")).mapInArrow(_settled(percent, miss), "a bigint, b bigint")
        settled = materialize(settled, "links")
        spent.append(settled)
        if not settled.isEmpty():
            spent.append(state)
            state = connected_components(edges(state).union(settled))
    discard(left, *spent)

    named = classes.select(*KEY, "doc_id", "rep").join(state.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*KEY, "doc_id", F.coalesce("component", "rep").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(smallest, "component").drop("component")
    out = signed.drop("sig").join(named, KEY, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
