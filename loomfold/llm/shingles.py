"""Distinct hashed word shingles of texts, and MinHash signatures of them.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed
and carriage return, after lower-casing A to Z. A text with fewer words than a
shingle has one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textio import LOWER, distinct_by_row, mix, row_of, span_hashes, utf8, words

_STEP = np.uint64(0x100000001B3D)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, 64-bit shingle) pairs, sorted by both."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets)
    h = span_hashes(data, starts, ends)
    rows = row_of(firsts)
    n = max(0, len(h) - size + 1)
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = acc * _STEP + h[j : n + j]
    whole = rows[:n] == rows[size - 1 : n + size - 1]
    out_rows, out = [rows[:n][whole]], [mix(acc[whole])]
    counts = np.diff(firsts)
    for few in range(1, size):
        at = np.flatnonzero(counts == few)
        if len(at):
            acc = np.full(len(at), few, np.uint64)
            for j in range(few):
                acc = acc * _STEP + h[firsts[at] + j]
            out_rows.append(at)
            out.append(mix(acc))
    rows, out = np.concatenate(out_rows), np.concatenate(out)
    if len(out_rows) > 1:
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return distinct_by_row(rows, out)


def permutations(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signatures(hashes: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """MinHash signatures by row, all ones for rows without shingles."""
    out = np.full((len(firsts) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(firsts))
    if len(full):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for k, (a, b) in enumerate(zip(*permutations(n), strict=True)):
            out[full, k] = np.minimum.reduceat(x * a + b, firsts[full])
    return out
