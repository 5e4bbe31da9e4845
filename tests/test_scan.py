"""Exponential means by blocks against pandas, at any block size."""

import numpy as np
import pandas as pd
import pytest

from loomfold.operators import ops
from loomfold.plans import expr
from loomfold.plans.expr import col, compile_exprs, ewm

SPANS = {"a": (5, 1), "b": (27, 14), "c": (1, 2), "d": (1.01, 1), "e": (60, 3)}


def panel(spark, seed=1, dates=60, symbols=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 3, (dates, symbols))
    x[rng.random((dates, symbols)) < 0.3] = np.nan
    x[:, 5] = np.nan
    x[10:50, 2] = np.nan
    rows = [(t, str(s), float(x[t, s])) for t in range(dates) for s in range(symbols)]  # NaN is a gap, too
    return x, spark.createDataFrame(rows, "t_idx int, symbol string, x double")


def wide(df, name):
    return df.pivot(index="t_idx", columns="symbol", values=name).to_numpy(float)


@pytest.mark.parametrize("rows", [1, 3, 7, 256])
def test_means_equal_pandas(spark, monkeypatch, rows):
    monkeypatch.setattr(expr, "SCAN_ROWS", rows)
    x, df = panel(spark)
    found = compile_exprs(df, {k: ewm(col("x"), 2 / (span + 1), least) for k, (span, least) in SPANS.items()} | {"twice": ewm(ewm(col("x"), 1 / 3, 1), 1 / 3, 9)})
    assert found.columns == ["t_idx", "symbol", "x", *SPANS, "twice"]
    found = found.toPandas()
    for k, (span, least) in SPANS.items():
        want = pd.DataFrame(x).ewm(span=span, adjust=False, min_periods=least).mean().to_numpy()
        np.testing.assert_allclose(wide(found, k), want, rtol=1e-12)
    once = pd.DataFrame(x).ewm(span=5, adjust=False, min_periods=1).mean()
    np.testing.assert_allclose(wide(found, "twice"), once.ewm(span=5, adjust=False, min_periods=9).mean().to_numpy(), rtol=1e-12)


def test_long_series_and_huge_gaps_keep_their_precision(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(0, 1, 3000))
    x[500:1900] = np.nan
    x[0] = 1e12
    df = spark.createDataFrame([(t, "s", float(v)) for t, v in enumerate(x)], "t_idx int, symbol string, x double")
    found = compile_exprs(df, {"a": ewm(col("x"), 2 / 6, 1), "b": ewm(col("x"), 0.999, 1)}).toPandas().sort_values("t_idx")
    for k, alpha in (("a", 2 / 6), ("b", 0.999)):
        np.testing.assert_allclose(found[k].to_numpy(), pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy(), rtol=1e-9)


def test_no_python_and_no_second_scan(spark):
    _, df = panel(spark)
    for e in (ops.RSI(col("x"), 14), ops.MACD(col("x")), ops.KDJ_Lines(col("x"), col("x"), col("x"))[2]):
        plan = compile_exprs(df, {"v": e})._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and plan.count("Scan ExistingRDD") == 1


def test_empty_panel(spark):
    _, df = panel(spark)
    assert compile_exprs(df.limit(0), {"v": ewm(col("x"), 0.5, 1)}).count() == 0
