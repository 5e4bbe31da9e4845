"""Forests of an expanding window against trees grown one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.operators import ops
from loomfold.plans import forest
from loomfold.plans.expr import col
from loomfold.plans.forest import BINS, bins_of, grow, weight
from loomfold.plans.fusion import Labeler, MLCombiner
from loomfold.plans.panel import Panel
from loomfold.sources.synthetic import SyntheticMarket

C = col("close")
FACTORS = [ops.Ts_Delta(C, 2), -ops.Ts_Std(C, 4), ops.Ts_Mean(C, 3) / C]
LABEL = Labeler.set_label("close", 2)
ENDS, TREES, DEPTH = [3, 8, 14, 20], 4, 3


@pytest.fixture(scope="module")
def panel(spark):
    p = SyntheticMarket(n_stocks=15, n_days=40, n_industries=3, seed=5).generate(spark)
    return Panel(p.df.cache(), p.industry)


def rows(seed=1, n=400, labels=None):
    rng = np.random.default_rng(seed)
    x = np.ceil(rng.random((n, 3)) * 37) / 37
    y = labels(x, rng) if labels else np.sign(x[:, 0] - 0.4) * (x[:, 1] > 0.7) + rng.normal(0, 0.3, n)
    return rng.integers(0, 20, n), rng.integers(-(2**62), 2**62, n), x, y


def frame(spark, t, key, x, y):
    return spark.createDataFrame([(int(a), int(k), *map(float, v), float(b)) for a, k, v, b in zip(t, key, x, y, strict=True)], "t_idx int, key bigint, x0 double, x1 double, x2 double, y double")


def grown(bins, y, w, depth, node=0):
    """{node: (feature, bin, mean, rows)} by trying every cut."""
    n, mean = int(w.sum()), (w * y).sum() / w.sum()
    best = (0.0, None, None)
    if depth:
        total = (w * y).sum() ** 2 / n
        for f in range(bins.shape[1]):
            for b in range(BINS):
                left = bins[:, f] <= b
                nl = w[left].sum()
                if 0 < nl < n:
                    gain = (w * y)[left].sum() ** 2 / nl + (w * y)[~left].sum() ** 2 / (n - nl) - total
                    if gain > best[0] + 1e-9:
                        best = (gain, f, b)
    out = {node: (-1 if best[1] is None else best[1], best[2], mean, n)}
    if best[1] is not None:
        left = bins[:, best[1]] <= best[2]
        out |= grown(bins[left], y[left], w[left], depth - 1, 2 * node + 1) | grown(bins[~left], y[~left], w[~left], depth - 1, 2 * node + 2)
    return out


@pytest.mark.parametrize("purge", [0, 2])
def test_trees_equal_those_grown_one_by_one(spark, purge):
    t, key, x, y = rows()
    got = grow(frame(spark, t, key, x, y), 3, ENDS, trees=TREES, depth=DEPTH, purge=purge)
    for r, end in enumerate(ENDS):
        on = t < end - purge
        for m in range(TREES):
            w = weight(key.view(np.uint64), m)[on]
            own = w > 0
            want = grown(bins_of(x[on][own]), y[on][own], w[own], DEPTH)
            assert {n: int(got.rows[r, m, n]) for n in np.flatnonzero(got.rows[r, m])} == {n: v[3] for n, v in want.items()}
            for n, (feature, cut, mean, _) in want.items():
                assert got.feature[r, m, n] == feature and (feature < 0 or got.bin[r, m, n] == cut) and got.value[r, m, n] == pytest.approx(mean, abs=1e-6)


def test_partitions_batches_and_flushes_change_nothing(spark, monkeypatch):
    t, key, x, y = rows(2, 300)
    df = frame(spark, t, key, x, y)
    a = grow(df.repartition(1), 3, ENDS, trees=3, depth=3)
    b = grow(df.repartition(7), 3, ENDS, trees=3, depth=3)
    for name in ("feature", "bin", "value", "rows", "gain"):
        assert np.array_equal(getattr(a, name), getattr(b, name))
    # a task that flushes after every batch gives the same sums
    import pyarrow as pa

    own = forest.Forest.empty(ENDS, 2, 2)
    shared = type("Shared", (), {"value": own})
    batch = pa.record_batch([pa.array(t.astype(np.int32)), pa.array(key), *(pa.array(x[:, i]) for i in range(3)), pa.array(y)], names=["t_idx", "key", "x0", "x1", "x2", "y"])
    sums = []
    for counters, size in ((1 << 22, 8192), (1, 50)):
        monkeypatch.setattr(forest, "COUNTERS", counters)
        monkeypatch.setattr(forest, "ROWS", size)
        total = {}
        for out in forest._counter(shared, 3, 0, 0, 2.0**-30)(iter([batch])):
            for *k, n, s in zip(*(c.to_pylist() for c in out.columns), strict=True):
                old = total.get(tuple(k), (0, 0))
                total[tuple(k)] = old[0] + n, old[1] + s
        sums.append(total)
    assert sums[0] == sums[1] and len(sums[0]) > 100


def test_passes_do_not_depend_on_refits(spark):
    t, key, x, y = rows(3, 200)
    df = frame(spark, t, key, x, y)
    tracker = spark.sparkContext.statusTracker()

    def jobs(ends):
        spark.sparkContext.setJobGroup(f"forest {len(ends)}", "")
        grow(df, 3, ends, trees=2, depth=3)
        return len(tracker.getJobIdsForGroup(f"forest {len(ends)}"))

    try:
        assert jobs([18]) == jobs(list(range(4, 20)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_edges(spark):
    assert not grow(frame(spark, *(v[:0] for v in rows())), 3, ENDS, trees=2, depth=2).rows.any()
    t, key, x, y = rows(4, 60, lambda x, rng: np.full(len(x), 2.5))
    flat = grow(frame(spark, t, key, x, y), 3, [20], trees=2, depth=3)
    assert (flat.feature == -1).all() and flat.value[0, :, 0] == pytest.approx([2.5, 2.5]) and flat.importances(3).tolist() == [0, 0, 0]
    few = grow(frame(spark, t, key, x, y), 3, [1, 20], trees=2, depth=1)
    assert few.trained(1) and few.trained(0) == ((t < 1).sum() >= 10)
    big = grow(frame(spark, t, key, x, y * 1e300), 3, [20], trees=1, depth=1)
    assert big.value[0, 0, 0] == pytest.approx(2.5e300)
    assert np.bincount(weight(np.arange(200_000, dtype=np.uint64), 3))[:3] / 200_000 == pytest.approx([0.3679, 0.3679, 0.1839], abs=5e-3)


def values(df):
    return df.orderBy("t_idx", "symbol").select("value").toPandas().value.to_numpy(float)


@pytest.mark.parametrize("kind", ["random_forest", "ridge"])
def test_predictions_are_written_once_saved_and_loaded(spark, panel, tmp_path, kind):
    model = MLCombiner(kind, min_train_periods=20, refit_freq=7, rf_n_estimators=3, rf_max_depth=3).fit(panel, FACTORS, LABEL)
    first = model.predict(panel)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"again {kind}", "")
    try:
        assert model.predict(panel, FACTORS) is first and not tracker.getJobIdsForGroup(f"again {kind}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = values(first)
    assert np.isnan(got[: 20 * 15]).all() and (~np.isnan(got[20 * 15 :])).sum() > 200
    # other values of the same dates and symbols are predicted anew
    other = Panel(panel.df.withColumn("close", F.col("close") * (1 + F.col("symbol_pos") % 3)))
    anew = values(model.predict(other))
    assert not np.allclose(anew, got, equal_nan=True) and np.array_equal(np.isnan(anew), np.isnan(got))
    # and other dates or symbols by the last model, which has seen all rows
    fewer = Panel(panel.df.where("symbol_pos < 9"))
    by_last = values(model.predict(fewer))
    ranked = model._ranked(fewer, model.factors).orderBy("t_idx", "symbol").toPandas()
    x = ranked[["x0", "x1", "x2"]].to_numpy(float)
    on = ~np.isnan(x).any(axis=1) & (ranked.t_idx.to_numpy() >= 20)
    want = model.forest.predict(bins_of(x[on]), len(model.ends) - 1) if kind == "random_forest" else x[on] @ model.blocks[-1]["coef"] + model.blocks[-1]["intercept"]
    assert np.allclose(by_last[on], want) and np.isnan(by_last[~on]).all()
    folder = f"file://{tmp_path}/{kind}"
    model.save(spark, folder, save_predictions=True)
    again = MLCombiner.load(spark.newSession(), folder, FACTORS)
    for p, v in ((panel, got), (other, anew), (fewer, by_last)):
        assert np.allclose(values(again.predict(p)), v, equal_nan=True, rtol=1e-12)
    same = MLCombiner.load(spark, folder, FACTORS, panel)
    assert same._predictions is not None and np.array_equal(values(same.predict(panel)), got, equal_nan=True) and np.array_equal(same.importances, model.importances)


def test_forest_learns_and_explains(spark, panel):
    label = ops.Rank(FACTORS[1])  # what it is to find is one of its factors
    model = MLCombiner("random_forest", min_train_periods=15, refit_freq=10, rf_n_estimators=5, rf_max_depth=4).fit(panel, FACTORS, label)
    both = model.predict(panel).join(panel.factor(label, "y").select("t_idx", "symbol", "y"), ["t_idx", "symbol"]).dropna()
    assert both.stat.corr("value", "y") > 0.95 and model.importances.argmax() == 1 and model.importances.sum() == pytest.approx(1)
