"""Statistics of panels against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest

from loomfold.plans import statistics as st


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SHARES = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("leaf", [1, 7, 10_000])
def test_exact_quantiles(spark, monkeypatch, leaf):
    monkeypatch.setattr(st, "LEAF", leaf)
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.random(500), "skewed": np.exp(rng.normal(0, 30, 400)), "ties": np.repeat([1.0, 2.0, 2.5], [5, 300, 4]), "one": np.array([3.5]), "equal": np.full(90, -7.0),
        None: rng.integers(-3, 3, 200) * 1.0, "two": np.array([1e300, -1e300]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("none", None), ("even", None), ("even", float("nan"))]
    found = st.exact_quantiles(frame(spark, rows, "k string, x double").repartition(5), "x", SHARES, ["k"]).collect()
    assert len(found) == len(SHARES) * 8
    for r in found:
        if r.k == "none":
            assert r.value is None
        else:
            assert r.value == pytest.approx(pd.Series(groups[r.k]).quantile(r.share), rel=1e-12)
    whole = st.exact_quantiles(frame(spark, rows, "k string, x double"), "x", [0.5]).collect()
    assert len(whole) == 1 and whole[0].value == pytest.approx(pd.Series(np.concatenate(list(groups.values()))).median())
    with pytest.raises(ValueError):
        st.exact_quantiles(frame(spark, rows, "k string, x double"), "x", [1.5])


def test_factor_correlations(spark):
    rng = np.random.default_rng(2)
    n, dates = 12, 9
    x = {c: rng.normal(size=(dates, n)) for c in "abcd"}
    for c in "abc":
        x[c][rng.random((dates, n)) < 0.3] = np.nan
    x["d"][:] = 1.0  # constant
    x["c"][3, 4:] = np.nan  # too few names
    rows = [(t, str(s), *(None if np.isnan(x[c][t, s]) else float(x[c][t, s]) for c in "abcd")) for t in range(dates) for s in range(n)]
    df = frame(spark, rows, "t_idx int, symbol string, a double, b double, c double, d double")
    for last in (5, None):
        got = {(r.a, r.b): r.correlation for r in st.factor_correlations(df, list("abcd"), last=last).collect()}
        assert len(got) == 16
        for p in "abcd":
            for q in "abcd":
                daily = [pd.Series(x[p][t]).corr(pd.Series(x[q][t])) for t in range(dates - (last or dates), dates) if (~np.isnan(x[p][t] + x[q][t])).sum() > 5] if "d" not in (p, q) else []
                want = 1.0 if p == q else np.nanmean(daily) if daily else None
                assert got[p, q] == (None if want is None else pytest.approx(want, rel=1e-9)), (p, q)
    assert [tuple(r) for r in st.factor_correlations(df, ["a"]).collect()] == [("a", "a", 1.0)]


def test_counts_pivots_extremes(spark):
    df = frame(spark, [("x", 1, 2.0), ("y", 1, 4.0), ("x", 2, None), (None, 2, 4.0), ("z", 1, 1.0), ("y", 2, 3.0)], "k string, c int, v double")
    assert [tuple(r) for r in st.value_counts(df, "k").orderBy("rank").collect()] == [("x", 2, 1), ("y", 2, 2), ("z", 1, 3)]
    wide = {r.k: (r["1"], r["2"]) for r in st.pivot_mean(df, "v", "k", "c", [1, 2]).collect()}
    assert wide == {"x": (2.0, None), "y": (4.0, 3.0), None: (None, 4.0), "z": (1.0, None)}
    got = [(r.side, r["rank"], r.k) for r in st.extremes(df, "v", 2, "k").orderBy("side", "rank").collect()]
    assert got == [("bottom", 1, "z"), ("bottom", 2, "x"), ("top", 1, None), ("top", 2, "y")]


def test_density(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 0.5, 200)])
    got = st.density(frame(spark, [(float(v),) for v in x] + [(None,)], "x double"), "x").orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert len(got) == 300 and np.allclose(got.kde, want, atol=2e-5) and np.trapezoid(got.kde, got.x) == pytest.approx(1, abs=0.05)
    assert got.normal.max() == pytest.approx(1 / (x.std(ddof=1) * np.sqrt(2 * np.pi)), rel=1e-3)
    assert st.density(frame(spark, [(1.0,), (1.0,)], "x double"), "x").count() == 0
