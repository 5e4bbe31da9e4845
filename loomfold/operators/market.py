"""Price/volume, momentum, technical and composite operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import sliding
from ..plans.expr import TIME, Expr, cell, col, eps_guard, ewm, let, slide, trailing, ts
from .crosssection import ZScore
from .timeseries import LIST_ROWS, Pct_Change, Ts_Delay, Ts_Delta, Ts_Max, Ts_Mean, Ts_Min, Ts_Std, Ts_Sum, _list, rolling


def VWAP(close: Expr, volume: Expr, window: int) -> Expr:
    return Ts_Sum(close * volume, window) / Ts_Sum(volume, window)


def VWAP_Bias(close: Expr, volume: Expr, window: int) -> Expr:
    return close / eps_guard(VWAP(close, volume, window)) - 1


def PVDeviation(close: Expr, volume: Expr, window: int) -> Expr:
    return (close - VWAP(close, volume, window)) / eps_guard(Ts_Std(close, window))


def Amihud(close: Expr, volume: Expr, window: int) -> Expr:
    """Mean of absolute return by volume; a volume of 0 is null."""
    return Ts_Mean(Pct_Change(close).abs() / volume.nullif(0.0), window)


def RiskAdjMomentum(close: Expr, window: int, vol_window: int) -> Expr:
    return Pct_Change(close, window) / eps_guard(Ts_Std(Pct_Change(close), vol_window))


def PricePathQuality(close: Expr, window: int) -> Expr:
    """abs(Spearman) times squared Pearson correlation of the window's values with time, from 4 values and half the window on."""
    if window < 4:
        raise ValueError("PricePathQuality: the window must have at least 4 rows")
    least = max(4, window // 2)
    if window > LIST_ROWS:
        return slide("path", partial(sliding.path_quality, least=least), close, window)

    def corr_with_time(h: Column, mean: Column) -> Column:
        n = F.size(h).cast("double")
        start = F.struct(*(F.lit(0.0).alias(k) for k in ("i", "q", "p")))

        def step(s: Column, v: Column) -> Column:
            d = v - mean
            return F.struct((s["i"] + 1).alias("i"), (s["q"] + d * d).alias("q"), (s["p"] + (s["i"] - (n - 1) / 2) * d).alias("p"))

        return F.aggregate(h, start, step, lambda s: F.try_divide(s["p"], F.sqrt(s["q"] * n * (n * n - 1) / 12)))

    def ranked(h: Column) -> Column:
        """Average ranks: halfway between the first and the last place in sorted order."""
        places = F.struct(F.array_sort(h).alias("up"), F.sort_array(h, asc=False).alias("down"))
        n = F.size(h)
        return let(places, lambda p: F.transform(h, lambda v: (F.array_position(p["up"], v) + n + 1 - F.array_position(p["down"], v)) / F.lit(2.0)))

    def build(h: Column) -> Column:
        n = F.size(h).cast("double")
        r = let(F.aggregate(h, F.lit(0.0), lambda s, v: s + v) / n, lambda mean: corr_with_time(h, mean))
        rho = let(ranked(h), lambda k: corr_with_time(k, (n + 1) / 2))
        return F.when(F.array_max(h) > F.array_min(h), F.abs(rho) * let(r, lambda x: x * x))

    return cell("path", build, _list(close, window, least))


def RangeBreakout(close: Expr, high: Expr, low: Expr, window: int) -> Expr:
    floor = Ts_Min(low, window)
    return (close - floor) / eps_guard(Ts_Max(high, window) - floor)


def Ewm(x: Expr, span: float, min_periods: int) -> Expr:
    """Exponential mean (no adjustment) with alpha = 2 / (span + 1)."""
    return ewm(x, 2.0 / (span + 1), min_periods)


def RSI(close: Expr, window: int = 14) -> Expr:
    """Null, not 100, where the mean loss is 0."""
    move = Ts_Delta(close, 1)
    gain, loss = (Ewm(m.clip(low=0.0), 2 * window - 1, window) for m in (move, -move))
    return 100 - 100 / (1 + gain / loss.nullif(0.0))


def KDJ(close: Expr, high: Expr, low: Expr, n: int = 9, m1: int = 3, m2: int = 3) -> Expr:
    """The K line; ``m2`` belongs to the D line, see :func:`KDJ_Lines`."""
    floor = Ts_Min(low, n)
    return Ewm(100 * (close - floor) / eps_guard(Ts_Max(high, n) - floor), 2 * m1 - 1, n)


def KDJ_Lines(close: Expr, high: Expr, low: Expr, n: int = 9, m1: int = 3, m2: int = 3) -> tuple[Expr, Expr, Expr]:
    """K, D (the mean of K) and J = 3K - 2D."""
    k = KDJ(close, high, low, n, m1)
    d = Ewm(k, 2 * m2 - 1, 1)
    return k, d, 3 * k - 2 * d


def MACD(close: Expr, fast: int = 12, slow: int = 26, signal: int = 9) -> Expr:
    """The histogram: MACD line less its signal line."""
    line = Ewm(close, fast, fast) - Ewm(close, slow, slow)
    return line - Ewm(line, signal, signal)


def _mean_ratio(x: Expr, n_short: int, n_long: int) -> Expr:
    return Ts_Mean(x, n_short) / eps_guard(rolling("avg", x, n_long, F.avg, lag=n_short))


def VolSpike(turnover: Expr, n_short: int = 3, n_long: int = 10, n_multiple: float = 2.0) -> Expr:
    """Recent mean over the mean before it; ``n_multiple`` is a threshold for users of the value and doesn't enter it."""
    return _mean_ratio(turnover, n_short, n_long)


def PriceMeanShrink(close: Expr, n_short: int = 3, n_long: int = 10, n_multiple: float = 0.98) -> Expr:
    return _mean_ratio(close, n_short, n_long)


def _pooled_variance(a: Expr, b: Expr, n: int, lag: int = 0) -> Expr:
    """Sample variance of both series' values in the window, from 3 values and row n - 1 on."""

    def build(x: Column, y: Column, t: Column) -> Column:
        w = trailing(n, lag)
        n1, n2 = (F.count(c).over(w).cast("double") for c in (x, y))
        m1, m2, v1, v2 = (F.coalesce(f(c).over(w), F.lit(0.0)) for f in (F.avg, F.var_pop) for c in (x, y))
        total = n1 + n2
        squares = n1 * v1 + n2 * v2 + F.coalesce(F.try_divide((m1 - m2) * (m1 - m2) * n1 * n2, total), F.lit(0.0))
        return F.when((total >= 3) & (t >= n - 1), F.try_divide(squares, total - 1))

    return ts(("pooled", n, lag), build, a, b, col(TIME))


def PriceVarShrink(close: Expr, open_: Expr, n_short: int = 3, n_long: int = 10, n_multiple: float = 0.5) -> Expr:
    """Recent pooled variance of open and close over that of the window before it."""
    return _pooled_variance(close, open_, n_short) / eps_guard(_pooled_variance(close, open_, n_long, n_short))


def VolSpikeStablePrice(
    turnover: Expr, close: Expr, open_: Expr, n_short: int = 3, n_long: int = 10, n_multiple: float = 2.0,
    vol_mult: float = 2.0, pricevar_shrink: float = 0.5, price_shrink: float = 0.98,
) -> Expr:
    """Mean of the z-scores of a volume spike, a shrinking variance and a shrinking price."""
    spike = VolSpike(turnover, n_short, n_long)
    calm = PriceVarShrink(close, open_, n_short, n_long)
    flat = PriceMeanShrink(close, n_short, n_long)
    return (ZScore(spike) + ZScore(-calm) + ZScore(-flat)) / 3


def Bollinger_Outlier_Frequency(close: Expr, period: int = 30, k: float = 3.5, lookback_window: int = 60) -> Expr:
    """Share of recent rows outside mean ± k deviations; a constant window has no outliers."""
    mean, sd = Ts_Mean(close, period), eps_guard(Ts_Std(close, period))
    outside = ((close > mean + k * sd) | (close < mean - k * sd)).fillna(False)
    flag = cell("flag", lambda o, m: F.when(m.isNotNull(), o.cast("double")), outside, mean)
    return Ts_Mean(flag, lookback_window)


def Turnover_Proxy(volume: Expr, window: int = 252, least: int = 60) -> Expr:
    """Volume by its rolling mean, 0 as null, at least 0."""
    return (volume / rolling("avg", volume, window, F.avg, least=least)).nullif(0.0).clip(low=0.0)


def Williams_R(close: Expr, high: Expr, low: Expr, window: int) -> Expr:
    top = Ts_Max(high, window)
    return (close - top) / (top - Ts_Min(low, window) + 1e-8)


def Skip_Momentum(close: Expr, far: int = 21, near: int = 5) -> Expr:
    return close / Ts_Delay(close, far) - close / Ts_Delay(close, near)


FactorFn = Callable[..., Expr]
