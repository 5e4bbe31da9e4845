"""Operators against pandas on a panel with nulls, constants, ties and gaps."""

import math

import numpy as np
import pandas as pd
import pytest

from loomfold.operators import ops
from loomfold.plans.expr import col, compile_exprs
from loomfold.plans.panel import Panel
from loomfold.sources.bars import with_industry

C, O, H, L, V = map(col, ("close", "open", "high", "low", "volume"))


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(7)
    dates = pd.bdate_range("2024-01-01", periods=60)
    close = pd.DataFrame(np.round(50 + rng.normal(size=(60, 8)).cumsum(axis=0), 3), index=dates, columns=[f"00000{i}" for i in range(8)])
    close = close.mask(rng.random(close.shape) < 0.08)
    close.iloc[:, 0] = 10.0
    close.iloc[:20, 1] = np.nan
    close.iloc[:, 3] = close.iloc[:, 2]
    out = {"close": close}
    out["open"] = (close + rng.normal(0, 0.3, close.shape)).round(3).mask(rng.random(close.shape) < 0.05)
    out["high"], out["low"] = close + 1, close - 1.5
    volume = pd.DataFrame(rng.integers(0, 50, close.shape).astype(float), index=dates, columns=close.columns)
    out["volume"] = volume.mask(rng.random(close.shape) < 0.05)
    return out


@pytest.fixture(scope="module")
def panel(spark, wide):
    long = pd.concat({k: v.stack(future_stack=True) for k, v in wide.items()}, axis=1).reset_index(names=["date", "symbol"])
    long["date"] = long.date.dt.date
    industry = spark.createDataFrame([("000000", "a"), ("000001", "a"), ("000002", "b"), ("000003", "b"), ("000004", None), ("000005", "b")], "symbol string, industry string")
    df = Panel.from_facts(spark.createDataFrame(long.astype(object).where(long.notna(), None), "date date, symbol string, close double, open double, high double, low double, volume double")).df
    return Panel(with_industry(df, industry).cache(), industry)


def got(panel, e):
    return panel.factor(e).toPandas().pivot(index="t_idx", columns="symbol", values="value").astype(float).to_numpy()


def div(a, b):
    return (a / b).replace([np.inf, -np.inf], np.nan)


def decay(x, d):
    num = sum((d - k) * x.shift(k).fillna(0) for k in range(d))
    den = sum((d - k) * x.shift(k).notna() for k in range(d))
    return (num / den.where(den > 0)).where(x.rolling(d, min_periods=0).count() >= max(1, d // 2))


def hurst(a):
    x = a[~np.isnan(a)]
    dev = np.cumsum(x - x.mean())
    s = x.std(ddof=1)
    return math.log((dev.max() - dev.min()) / s) / math.log(len(x) / 2) if s >= 1e-10 else np.nan


def path(a):
    x = pd.Series(a[~np.isnan(a)])
    t = pd.Series(np.arange(len(x)))
    return np.nan if x.nunique() < 2 else abs(t.corr(x.rank())) * t.corr(x) ** 2


def ewm(x, span, least):
    return x.ewm(span=span, adjust=False, min_periods=least).mean()


def rank(x):
    return x.rank(axis=1, pct=True)


def corr(a, b, n):
    a, b = a.where(b.notna()), b.where(a.notna())
    out = pd.DataFrame({c: a[c].rolling(n, min_periods=n).corr(b[c]) for c in a})
    flat = (a.rolling(n).max() == a.rolling(n).min()) | (b.rolling(n).max() == b.rolling(n).min())
    return out.mask(flat)


def guard(x):
    return x.mask(x.abs() < 1e-10)


def rsi(c):
    d = c.diff()
    g, loss = ewm(d.clip(lower=0), 27, 14), ewm((-d).clip(lower=0), 27, 14)
    return 100 - 100 / (1 + g / loss.replace(0, np.nan))


def kdj(w):
    lo, hi = w["low"].rolling(9).min(), w["high"].rolling(9).max()
    return ewm(100 * (w["close"] - lo) / guard(hi - lo), 5, 9)


def macd(c):
    line = ewm(c, 12, 12) - ewm(c, 26, 26)
    return line - ewm(line, 9, 9)


def zscore(x):
    sd = x.std(axis=1)
    return x.sub(x.mean(axis=1), axis=0).div(sd.where(sd >= 1e-10), axis=0)


def vwap(w, n):
    return div((w["close"] * w["volume"]).rolling(n).sum(), w["volume"].rolling(n).sum())


CASES = {
    "sum": (ops.Ts_Sum(V, 5), lambda w: w["volume"].rolling(5).sum()),
    "mean": (ops.Ts_Mean(C, 5), lambda w: w["close"].rolling(5).mean()),
    "max": (ops.Ts_Max(C, 5), lambda w: w["close"].rolling(5).max()),
    "min": (ops.Ts_Min(C, 5), lambda w: w["close"].rolling(5).min()),
    "std": (ops.Ts_Std(C, 5), lambda w: w["close"].rolling(5).std().mask(w["close"].rolling(5).max() == w["close"].rolling(5).min(), 0.0)),
    "delta": (ops.Ts_Delta(C, 3), lambda w: w["close"].diff(3)),
    "lead": (ops.Ts_Delay(C, -2), lambda w: w["close"].shift(-2)),
    "ts_rank": (ops.Ts_Rank(C, 6), lambda w: w["close"].rolling(6).apply(lambda x: (x <= x[-1]).mean(), raw=True)),
    "corr": (ops.Ts_Corr(C, V, 8), lambda w: corr(w["close"], w["volume"], 8)),
    "autocorr": (ops.Ts_Autocorr(C, 2, 8), lambda w: corr(w["close"], w["close"].shift(2), 8)),
    "skew": (ops.Ts_Skew(C, 8), lambda w: w["close"].rolling(8).skew().mask(w["close"].rolling(8).std() == 0, 0.0)),
    "kurt": (ops.Ts_Kurt(C, 8), lambda w: w["close"].rolling(8).kurt().mask(w["close"].rolling(8).std() == 0, -3.0)),
    "hurst": (ops.Ts_Hurst(C, 16), lambda w: w["close"].rolling(16, min_periods=8).apply(hurst, raw=True)),
    "decay": (ops.Decay_Linear(C, 5), lambda w: decay(w["close"], 5)),
    "rank": (ops.Rank(C), lambda w: rank(w["close"])),
    "zscore": (ops.ZScore(C), lambda w: zscore(w["close"])),
    "scale": (ops.Scale(C, 2), lambda w: w["close"].mul(2).div(w["close"].abs().sum(axis=1), axis=0)),
    "vwap": (ops.VWAP(C, V, 4), lambda w: vwap(w, 4)),
    "bias": (ops.VWAP_Bias(C, V, 4), lambda w: w["close"] / guard(vwap(w, 4)) - 1),
    "pv": (ops.PVDeviation(C, V, 4), lambda w: (w["close"] - vwap(w, 4)) / guard(w["close"].rolling(4).std())),
    "amihud": (ops.Amihud(C, V, 3), lambda w: (w["close"].ffill().pct_change(fill_method=None).abs() / w["volume"].replace(0, np.nan)).rolling(3).mean()),
    "momentum": (ops.RiskAdjMomentum(C, 5, 6), lambda w: w["close"].ffill().pct_change(5, fill_method=None) / guard(w["close"].ffill().pct_change(fill_method=None).rolling(6).std())),
    "path": (ops.PricePathQuality(C, 10), lambda w: w["close"].rolling(10, min_periods=5).apply(path, raw=True)),
    "breakout": (ops.RangeBreakout(C, H, L, 6), lambda w: (w["close"] - w["low"].rolling(6).min()) / guard(w["high"].rolling(6).max() - w["low"].rolling(6).min())),
    "rsi": (ops.RSI(C, 14), lambda w: rsi(w["close"])),
    "kdj": (ops.KDJ(C, H, L), kdj),
    "macd": (ops.MACD(C), lambda w: macd(w["close"])),
    "spike": (ops.VolSpike(V), lambda w: w["volume"].rolling(3).mean() / guard(w["volume"].shift(3).rolling(10).mean())),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(panel, wide, name):
    e, want = CASES[name]
    want = want(wide).to_numpy(float)
    have = got(panel, e)
    assert np.array_equal(np.isnan(have), np.isnan(want)), name
    assert np.allclose(have, want, rtol=1e-7, atol=1e-8, equal_nan=True)
    assert np.isfinite(want).sum() > 20


def test_pooled_variance(panel, wide):
    a, b = wide["close"].to_numpy(), wide["open"].to_numpy()

    def pooled(n, lag):
        out = np.full(a.shape, np.nan)
        for t in range(n - 1, len(a)):
            for s in range(a.shape[1]):
                lo, hi = max(0, t - n + 1 - lag), t + 1 - lag
                x = np.concatenate([a[lo:hi, s], b[lo:hi, s]]) if hi > 0 else np.zeros(0)
                x = x[~np.isnan(x)]
                if len(x) >= 3:
                    out[t, s] = x.var(ddof=1)
        return out

    base = pooled(10, 3)
    want = pooled(3, 0) / np.where(np.abs(base) < 1e-10, np.nan, base)
    assert np.allclose(got(panel, ops.PriceVarShrink(C, O)), want, equal_nan=True)


def test_neutralize(panel, wide):
    groups = {"000000": "a", "000001": "a", "000002": "b", "000003": "b", "000005": "b"}
    have = got(panel, ops.Neutralize(C))
    for t, row in enumerate(wide["close"].to_numpy()):
        s = pd.Series(row, index=wide["close"].columns)
        mapped = s.reindex(["000000", "000001", "000002", "000003", "000004", "000005"])
        if mapped.notna().sum() < 3:
            want = mapped
        else:
            by = pd.Series(groups)
            want = mapped.copy()
            for g in "ab":
                own = by[by == g].index
                want[own] = mapped[own] - mapped[own].mean()
        want = want.reindex(s.index)
        assert np.allclose(have[t], want.to_numpy(float), equal_nan=True)


def test_bollinger_constant_is_no_outlier(panel):
    have = got(panel, ops.Bollinger_Outlier_Frequency(C, 5, 1.0, 4))
    assert np.nanmax(have[:, 0]) == 0 and np.nanmax(have) > 0 and np.isnan(have[:7, 0]).all()


@pytest.mark.parametrize(
    "make", [lambda: ops.Ts_Skew(C, 2), lambda: ops.Ts_Kurt(C, 3), lambda: ops.Ts_Hurst(C, 7), lambda: ops.PricePathQuality(C, 3), lambda: ops.Ts_Autocorr(C, 5, 5), lambda: ops.Ts_Mean(C, 0)]
)
def test_short_windows_raise(make):
    with pytest.raises(ValueError):
        make()


@pytest.fixture
def flat(spark):
    """A panel without a plan of its own, so that all exchanges are those of the factors."""
    return spark.createDataFrame([(0, "a", 1.0, 2.0)], "t_idx int, symbol string, close double, high double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_nodes_are_computed_once_and_share_an_exchange(flat):
    mean = ops.Ts_Mean(C, 5)
    text = plan(compile_exprs(flat, {"a": mean + ops.Ts_Std(C, 5), "b": mean * 2, "c": ops.Ts_Max(H, 3)}))
    assert text.count("avg(close") == 1
    assert text.count("Exchange hashpartitioning(symbol") == 1
    assert "Python" not in text and "Arrow" not in text


def test_ts_then_xs_takes_two_exchanges(flat):
    text = plan(compile_exprs(flat, {"a": ops.Rank(ops.Ts_Delta(C, 5))}))
    assert text.count("Exchange hashpartitioning") == 2
