"""Order statistics and ranges over long windows, in numpy over blocks of one symbol's rows.

A kernel gets the values of a block after those of the rows before it, at least one
window of them, and gives a value for each row of the block. Nulls and rows before
the first are NaN. Work is done in pieces of a fixed number of window cells, so memory
depends neither on the block nor on the window's length times it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

#: Cells of windows that are looked at together.
CELLS = 1 << 18

Kernel = Callable[[np.ndarray, int, int], np.ndarray]


def _pieces(start: int, end: int, n: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // n)
    return ((i, min(end, i + step)) for i in range(start, end, step))


def _trailing(x: np.ndarray, lo: int, hi: int, n: int) -> np.ndarray:
    """The ``n`` values up to each row of [lo, hi), a row of the result for each."""
    return sliding_window_view(x[lo - n + 1 : hi], n)


def rank_share(x: np.ndarray, start: int, n: int) -> np.ndarray:
    """Share of a full window's values that are at most the newest."""
    out = np.full(len(x) - start, np.nan)
    for lo, hi in _pieces(start, len(x), n):
        at_most = np.count_nonzero(_trailing(x, lo, hi, n) <= x[lo:hi, None], axis=1)
        out[lo - start : hi - start] = at_most / n
    known = np.append(0, np.cumsum(~np.isnan(x)))
    full = known[start + 1 :] - known[start + 1 - n : len(x) + 1 - n] == n
    return np.where(full, out, np.nan)


def rescaled_range(x: np.ndarray, start: int, n: int, least: int, least_spread: float) -> np.ndarray:
    """ln(R/S) / ln(m/2) of the m values that a window has, from ``least`` on; NaN where S is under ``least_spread``."""
    out = np.full(len(x) - start, np.nan)
    for lo, hi in _pieces(start, len(x), n):
        w = _trailing(x, lo, hi, n)
        known = ~np.isnan(w)
        m = known.sum(axis=1)
        off = np.where(known, w, 0.0)
        off = np.where(known, w - (off.sum(axis=1) / np.maximum(m, 1))[:, None], 0.0)
        spread = np.sqrt((off * off).sum(axis=1) / np.maximum(m - 1, 1))
        path = np.cumsum(off, axis=1)
        reach = np.where(known, path, -np.inf).max(axis=1) - np.where(known, path, np.inf).min(axis=1)
        right = (m >= least) & (spread >= least_spread) & (reach > 0)
        out[lo - start : hi - start][right] = np.log(reach[right] / spread[right]) / np.log(m[right] / 2)
    return out


def path_quality(x: np.ndarray, start: int, n: int, least: int) -> np.ndarray:
    """abs(Spearman) times squared Pearson correlation with time of the m values that a window has, from ``least`` on.

    The sum of place times average rank slides: only pairs with the value that
    enters or the one that leaves change it, and so do the groups of equal values. Both
    are sums of halves, so nothing is lost on the way.
    """
    place = np.cumsum(~np.isnan(x)).astype(float)

    def shares(v: np.ndarray, c: np.ndarray, rest: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What values at places ``c`` add to the sum, and to that of cubes, beside the rest of their windows."""
        equal = rest == v[:, None]
        n_equal = np.count_nonzero(equal, axis=1).astype(float)
        under = np.count_nonzero(rest < v[:, None], axis=1) + n_equal / 2
        raised = np.einsum("ij,ij->i", rest > v[:, None], places) + np.einsum("ij,ij->i", equal, places) / 2
        there = ~np.isnan(v)
        return np.where(there, c * (1 + under) + raised, 0.0), np.where(there, (n_equal + 1) ** 3 - n_equal**3, 0.0)

    before = x[start - n : start]
    there = ~np.isnan(before)
    _, of, counts = np.unique(before[there], return_inverse=True, return_counts=True)
    ranked = (place[start - n : start][there] * (np.cumsum(counts) - (counts - 1) / 2)[of]).sum()
    cubes = (counts.astype(float) ** 3).sum()
    out = np.full(len(x) - start, np.nan)
    for lo, hi in _pieces(start, len(x), n):
        w, places = _trailing(x, lo, hi, n), _trailing(place, lo, hi, n)
        came = shares(x[lo:hi], place[lo:hi], w[:, :-1], places[:, :-1])
        went = shares(x[lo - n : hi - n], place[lo - n : hi - n], w[:, :-1], places[:, :-1])
        sums, groups = ranked + np.cumsum(came[0] - went[0]), cubes + np.cumsum(came[1] - went[1])
        ranked, cubes = sums[-1], groups[-1]
        known = ~np.isnan(w)
        m = known.sum(axis=1).astype(float)
        off = np.where(known, w, 0.0)
        varied = np.where(known, w, -np.inf).max(axis=1) > np.where(known, w, np.inf).min(axis=1)
        off = np.where(known, w - (off.sum(axis=1) / np.maximum(m, 1))[:, None], 0.0)
        earlier = place[lo:hi] - m
        line = np.einsum("ij,ij->i", off, places) - (earlier + (m + 1) / 2) * off.sum(axis=1)
        square = (off * off).sum(axis=1)
        right = (m >= least) & varied & (square > 0)
        m, times = m[right], (m * (m * m - 1) / 12)[right]
        rho = (sums[right] - earlier[right] * m * (m + 1) / 2 - m * ((m + 1) / 2) ** 2) / np.sqrt((m**3 - groups[right]) / 12 * times)
        out[lo - start : hi - start][right] = np.abs(rho) * line[right] ** 2 / (square[right] * times)
    return out


def over_blocks(kernel: Kernel, n: int):
    """A function of two columns, a block's values and those of the block before it (null at the head), that gives its results."""

    @F.arrow_udf("array<double>")
    def run(earlier: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for before, values in zip(earlier, own, strict=True):
            head = before.values.to_numpy(zero_copy_only=False)[-n:] if before.is_valid else np.zeros(0)
            x = np.concatenate([np.full(n - len(head), np.nan), head, values.values.to_numpy(zero_copy_only=False)])
            out.append(pa.array(kernel(x, n, n), from_pandas=True))
        offsets = np.append(0, np.cumsum([len(o) for o in out])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(out) if out else pa.array([], pa.float64()))

    return run
