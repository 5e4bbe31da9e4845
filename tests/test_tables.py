"""Combiners on tables of different grids."""

import datetime as dt

import numpy as np
import pytest

from loomfold.plans.fusion import MLCombiner, StatisticalCombiner, from_tables
from loomfold.plans.panel import intersected

DAY = dt.date(2024, 1, 1)


def table(spark, cells):
    return spark.createDataFrame([(None if d is None else DAY + dt.timedelta(d), s, v) for d, s, v in cells], "date date, symbol string, value double")


def test_grid_is_what_all_tables_have(spark):
    a = table(spark, [(d, s, float(d)) for d in range(5) for s in "abcd"] + [(None, "a", 1.0), (1, None, 1.0)])
    b = table(spark, [(d, s, None if d == 2 else 10.0 * d) for d in range(1, 7) for s in "bcde" if (d, s) != (3, "c")] + [(1, "b", 99.0), (1, "b", float("nan"))])
    rows = [tuple(r) for r in intersected({"f": a, "g": b}).orderBy("date", "symbol").collect()]
    want = [
        (DAY + dt.timedelta(d), d - 1, s, i, float(d), None if d == 2 or (d, s) == (3, "c") else 99.0 if (d, s) == (1, "b") else 10.0 * d) for d in range(1, 5) for i, s in enumerate("bcd")
    ]
    assert rows == want
    assert intersected({"f": a, "g": table(spark, [(30, "z", 1.0)])}).count() == 0
    with pytest.raises(ValueError):
        intersected({})


def test_combiners_fit_and_predict_tables(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.normal(size=(40, 12)) for k in "pqr"}
    y = 0.5 * x["p"] - 0.2 * x["q"] + rng.normal(0, 0.1, (40, 12))
    cut = {"p": (0, 40, 12), "q": (3, 40, 11), "r": (0, 38, 12)}
    tables = [table(spark, [(d, f"s{s:02}", float(x[k][d, s])) for d in range(lo, hi) for s in range(n)]) for k, (lo, hi, n) in cut.items()]
    label = table(spark, [(d, f"s{s:02}", float(y[d, s])) for d in range(40) for s in range(1, 12)])
    for model in (StatisticalCombiner("ic_weighted"), MLCombiner("ridge", min_train_periods=10, refit_freq=10)):
        panel, factors, own = from_tables(tables, label)
        a = model.fit_tables(tables, label).predict_tables(tables)
        assert a.agg({"date": "count"}).first()[0] == 35 * 11  # dates 3 to 37, symbols s00 to s10: the label's grid does not bound predictions
        b = type(model)(*((model.method,) if isinstance(model, StatisticalCombiner) else ("ridge", 10, 10))).fit(panel, factors, own)
        got, want = (m.predict(panel).orderBy("date", "symbol").toPandas() for m in (model, b))
        assert len(want) == 35 * 10 and np.allclose(got.value.astype(float), want.value.astype(float), equal_nan=True)
    with pytest.raises(ValueError):
        model.predict_tables(tables[:2])
