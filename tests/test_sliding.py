"""Statistics of long windows by blocks against pandas and against lists, at any block and piece size."""

import math
import time

import numpy as np
import pandas as pd
import pytest

from loomfold.operators import market, ops, timeseries
from loomfold.plans import expr, sliding
from loomfold.plans.expr import col, compile_exprs

X = col("x")


def panel(spark, dates=330, symbols=6, gaps=0.1, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (dates, symbols)).cumsum(axis=0).round(1)  # with many ties
    x[rng.random(x.shape) < gaps] = np.nan
    x[:, 0] = 3.0
    x[:, 1] = np.where(np.isnan(x[:, 1]), 0.0, x[:, 1])
    x[:, 2] = np.nan
    x[40:150, 3] = np.nan
    rows = [(t, f"s{s}", None if np.isnan(x[t, s]) else float(x[t, s]), [t]) for t in range(dates) for s in range(symbols)]
    return pd.DataFrame(x), spark.createDataFrame(rows, "t_idx int, symbol string, x double, other array<int>")


def hurst(a):
    v = a[~np.isnan(a)]
    path, s = np.cumsum(v - v.mean()), v.std(ddof=1)
    return math.log((path.max() - path.min()) / s) / math.log(len(v) / 2) if s >= 1e-10 else np.nan


def quality(a):
    v = pd.Series(a[~np.isnan(a)])
    t = pd.Series(np.arange(len(v)))
    return np.nan if v.nunique() < 2 else abs(t.corr(v.rank())) * t.corr(v) ** 2


def found(df, exprs):
    out = compile_exprs(df, exprs)
    assert out.columns == [*df.columns, *exprs]
    out = out.toPandas()
    return {k: out.pivot(index="t_idx", columns="symbol", values=k).to_numpy(float) for k in exprs}


@pytest.mark.parametrize("rows, cells", [(1, 1), (1024, 1 << 18), (100, 700)])
def test_long_windows_equal_pandas(spark, monkeypatch, rows, cells):
    monkeypatch.setattr(expr, "SLIDE_ROWS", rows)
    monkeypatch.setattr(sliding, "CELLS", cells)
    n = 64
    x, df = panel(spark)
    have = found(df, {"rank": ops.Ts_Rank(X, n), "hurst": ops.Ts_Hurst(X, n), "path": ops.PricePathQuality(X, n), "twice": ops.Ts_Rank(-ops.Ts_Rank(X, n), 61)})
    rank = x.rolling(n).apply(lambda w: (w <= w[-1]).mean(), raw=True)
    want = {
        "rank": rank,
        "hurst": x.rolling(n, min_periods=n // 2).apply(hurst, raw=True),
        "path": x.rolling(n, min_periods=n // 2).apply(quality, raw=True),
        "twice": (-rank).rolling(61).apply(lambda w: (w <= w[-1]).mean(), raw=True),
    }
    for k, w in want.items():
        assert np.isfinite(w.to_numpy()).sum() > 100, k
        np.testing.assert_allclose(have[k], w.to_numpy(), rtol=1e-9, atol=1e-12, err_msg=k)


def test_lists_and_slides_agree(spark, monkeypatch):
    _, df = panel(spark)
    exprs = {"rank": lambda: ops.Ts_Rank(X, 9), "hurst": lambda: ops.Ts_Hurst(X, 20), "path": lambda: ops.PricePathQuality(X, 9)}
    lists = found(df, {k: e() for k, e in exprs.items()})
    monkeypatch.setattr(timeseries, "LIST_ROWS", 0)
    monkeypatch.setattr(market, "LIST_ROWS", 0)
    slides = found(df, {k: e() for k, e in exprs.items()})
    for k in exprs:
        np.testing.assert_allclose(slides[k], lists[k], rtol=1e-9, atol=1e-12, err_msg=k)


def test_only_long_windows_leave_the_jvm_and_one_exchange_serves_all(spark):
    flat = spark.createDataFrame([(0, "a", 1.0)], "t_idx int, symbol string, x double")

    def plan(e):
        return compile_exprs(flat, {"v": e})._jdf.queryExecution().executedPlan().toString()

    assert "Python" not in plan(ops.Ts_Rank(X, timeseries.LIST_ROWS))
    long = plan(ops.Ts_Rank(ops.Ts_Mean(X, 5), 500) + ops.PricePathQuality(ops.Ts_Mean(X, 5), 300))
    assert "ArrowEvalPython" in long and long.count("Exchange hashpartitioning") == 1


def test_empty_panel(spark):
    _, df = panel(spark, dates=1)
    assert compile_exprs(df.limit(0), {"v": ops.Ts_Rank(X, 100)}).count() == 0
    assert compile_exprs(df, {"v": ops.Ts_Rank(X, 100)}).where("v is not null").count() == 0


@pytest.mark.parametrize("make", [ops.Ts_Rank, ops.Ts_Hurst, ops.PricePathQuality])
def test_time_grows_far_slower_than_the_window(spark, make):
    df = spark.range(40).crossJoin(spark.range(5000).withColumnRenamed("id", "t_idx")).selectExpr("cast(id as string) symbol", "cast(t_idx as int) t_idx", "rand(1) x")
    df = df.cache()
    df.count()
    took = {}
    for n in (20, 500, 20, 500):
        start = time.monotonic()
        compile_exprs(df, {"v": make(X, n)}).selectExpr("sum(v)").collect()
        took[n] = min(took.get(n, math.inf), time.monotonic() - start)
    df.unpersist()
    print(make.__name__, took)
    assert took[500] < 5 * took[20] + 1
