"""Vectorised access to the UTF-8 bytes of Arrow string columns.

Word boundaries, hashes and n-grams are computed on whole slices of a batch
with numpy; a slice holds at most ``SLICE`` bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
BASES = (BASE, np.uint64(0xD6E8FEB86659FD93))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name



def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose text is at most ``limit`` bytes, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start, n = 0, len(lengths)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-space bytes, and each row's first word."""
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, for exponents up to ``n`` at least."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = 1 << int(n + 1).bit_length()
        tables = []
        for base in (BASES[which], np.uint64(pow(int(BASES[which]), -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[which] = tuple(tables)
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand; ``second``: by another base."""
    up, down = _power_tables(len(data), int(second))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums by row, of unsigned items modulo 2^64; 0 for rows without items."""
    sums = np.zeros(len(values) + 1, np.uint64 if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by both; ``rows`` must be ascending."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]
