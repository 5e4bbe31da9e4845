"""Rolling operators along each symbol's rows.

A window of n rows gives null until it holds n non-null values, unless stated
otherwise; windows count rows of the dense grid.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans import sliding
from ..plans.expr import EPS, Expr, along, cell, let, slide, trailing, ts

#: Windows of up to so many rows are lists on the JVM; longer ones slide over blocks of rows in numpy. Results agree.
LIST_ROWS = 60


def rolling(name: str, x: Expr, n: int, fn: Callable[[Column], Column], least: int | None = None, lag: int = 0) -> Expr:
    """``fn`` over the trailing window where it has ``least`` (by default n) values."""
    if n < 1 or (least or 0) > n:
        raise ValueError(f"{name}: a window of {n} rows cannot hold {least or 1} values")

    def build(a: Column) -> Column:
        w = trailing(n, lag)
        return F.when(F.count(a).over(w) >= (n if least is None else least), fn(a).over(w))

    return ts((name, n, least, lag), build, x)


def Ts_Sum(x: Expr, window: int) -> Expr:
    return rolling("sum", x, window, F.sum)


def Ts_Mean(x: Expr, window: int) -> Expr:
    return rolling("avg", x, window, F.avg)


def Ts_Max(x: Expr, window: int) -> Expr:
    return rolling("max", x, window, F.max)


def Ts_Min(x: Expr, window: int) -> Expr:
    return rolling("min", x, window, F.min)


def Ts_Std(x: Expr, window: int) -> Expr:
    """Sample standard deviation; 0 over a constant window, null for a window of one row."""
    return rolling("std", x, window, F.stddev_samp)


def Ts_Delay(x: Expr, period: int) -> Expr:
    """The value ``period`` rows ago; a negative period looks ahead."""
    return ts(("delay", period), lambda a: F.lag(a, period).over(along()) if period >= 0 else F.lead(a, -period).over(along()), x)


def Ts_Delta(x: Expr, period: int) -> Expr:
    return x - Ts_Delay(x, period)


def Ts_Fill(x: Expr) -> Expr:
    """The last non-null value so far."""
    return ts("ffill", lambda a: F.last(a, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0)), x)


def Pct_Change(x: Expr, period: int = 1, fill: bool = True) -> Expr:
    """Relative change; by default nulls are filled forward first. Null where the old value is 0."""
    x = Ts_Fill(x) if fill else x
    return x / Ts_Delay(x, period) - 1


def Ts_Rank(x: Expr, window: int) -> Expr:
    """Share of the window's values that are at most the current one."""
    if window > LIST_ROWS:
        return slide("rank", sliding.rank_share, x, window)

    def share(a: Column) -> Column:
        held = F.collect_list(a).over(trailing(window))
        return F.when(F.size(held) >= window, held)

    held = ts(("list", window), share, x)
    return cell("share", lambda h, a: F.size(F.filter(h, lambda v: v <= a)) / F.size(h), held, x)


def Ts_Corr(x: Expr, y: Expr, window: int) -> Expr:
    """Pearson correlation over rows where both are given, as many as the window; null if either is constant."""

    def corr(a: Column, b: Column) -> Column:
        w = trailing(window)
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        varied = (F.max(a).over(w) > F.min(a).over(w)) & (F.max(b).over(w) > F.min(b).over(w))
        r = F.try_divide(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w))
        return F.when((F.count(a).over(w) >= window) & varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))

    return ts(("corr", window), corr, x, y)


def Ts_Autocorr(x: Expr, lag: int, window: int) -> Expr:
    if window <= lag:
        raise ValueError(f"Ts_Autocorr: the window ({window}) must exceed the lag ({lag})")
    return Ts_Corr(x, Ts_Delay(x, lag), window)


def _moment(name: str, x: Expr, window: int, least: int, constant: float, fn: Callable[[Column, Column], Column]) -> Expr:
    if window < least:
        raise ValueError(f"{name}: the window must have at least {least} rows")

    def build(a: Column) -> Column:
        w = trailing(window)
        n = F.count(a).over(w).cast("double")
        flat = F.max(a).over(w) == F.min(a).over(w)
        return F.when(n >= window, F.when(flat, F.lit(constant)).otherwise(fn(n, a)))

    return ts((name, window), build, x)


def Ts_Skew(x: Expr, window: int) -> Expr:
    """Bias-corrected skewness; 0 over a constant window."""
    return _moment("skew", x, window, 3, 0.0, lambda n, a: F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(a).over(trailing(window)))


def Ts_Kurt(x: Expr, window: int) -> Expr:
    """Bias-corrected excess kurtosis; -3 over a constant window."""
    return _moment("kurt", x, window, 4, -3.0, lambda n, a: (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(a).over(trailing(window)) + 6))


def _list(x: Expr, window: int, least: int) -> Expr:
    def build(a: Column) -> Column:
        held = F.collect_list(a).over(trailing(window))
        return F.when(F.size(held) >= least, held)

    return ts(("list", window, least), build, x)


def Ts_Hurst(x: Expr, window: int) -> Expr:
    """ln(R/S) / ln(n/2) of the window's values, from 8 values and half the window on; null where S is under 1e-10."""
    if window < 8:
        raise ValueError("Ts_Hurst: the window must have at least 8 rows")
    least = max(8, window // 2)
    if window > LIST_ROWS:
        return slide("hurst", partial(sliding.rescaled_range, least=least, least_spread=EPS), x, window)

    def build(h: Column) -> Column:
        n = F.size(h).cast("double")

        def spread(mean: Column) -> Column:
            start = F.struct(*(F.lit(v).alias(k) for k, v in (("c", 0.0), ("hi", float("-inf")), ("lo", float("inf")), ("q", 0.0))))

            def step(s: Column, v: Column) -> Column:
                c = s["c"] + v - mean
                return F.struct(c.alias("c"), F.greatest(s["hi"], c).alias("hi"), F.least(s["lo"], c).alias("lo"), (s["q"] + (v - mean) * (v - mean)).alias("q"))

            return F.aggregate(h, start, step)

        def exponent(s: Column) -> Column:
            sd, r = F.sqrt(s["q"] / (n - 1)), s["hi"] - s["lo"]
            return F.when((sd >= EPS) & (r > 0), F.ln(F.try_divide(r, sd)) / F.ln(n / 2))

        return F.when(h.isNotNull(), let(let(F.aggregate(h, F.lit(0.0), lambda s, v: s + v) / n, spread), exponent))

    return cell("hurst", build, _list(x, window, least))


def Decay_Linear(x: Expr, d: int) -> Expr:
    """Weighted mean with weights d … 1 from the newest value back, over the values there are, from max(1, d//2) on."""
    if d < 1:
        raise ValueError("Decay_Linear: d must be positive")

    def build(a: Column) -> Column:
        num, den = F.lit(0.0), F.lit(0.0)
        for k in range(d):
            v = F.lag(a, k).over(along()) if k else a
            num, den = num + F.coalesce((d - k) * v, F.lit(0.0)), den + F.when(v.isNotNull(), float(d - k)).otherwise(0.0)
        return F.when(F.count(a).over(trailing(d)) >= max(1, d // 2), F.try_divide(num, den))

    return ts(("decay", d), build, x)
