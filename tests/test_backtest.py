"""Back-test equivalences, contracts, fusion and tuning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.operators import ops
from loomfold.plans import performance
from loomfold.plans.backtest import VectorEngine
from loomfold.plans.expr import col
from loomfold.plans.fusion import Labeler, MLCombiner, StatisticalCombiner, min_variance_weights
from loomfold.plans.panel import Panel
from loomfold.plans.report import panels, text_summary
from loomfold.plans.tuning import ParameterTuner, build_combos
from loomfold.sources.synthetic import SyntheticMarket

C = col("close")
SIGNAL = ops.Rank(-ops.Ts_Delta(C, 5))


@pytest.fixture(scope="module")
def panel(spark):
    p = SyntheticMarket(n_stocks=12, n_days=70, n_industries=3).generate(spark)
    return Panel(p.df.cache(), p.industry)


def nav(engine):
    return [r.nav for r in engine.run().daily.orderBy("t_idx").select("nav").collect()]


def test_delay_equals_delayed_factor(panel):
    a = VectorEngine(SIGNAL, panel, rebalance_freq=5, top_n=4, delay=1)
    b = VectorEngine(ops.Ts_Delay(SIGNAL, 1), panel, rebalance_freq=5, top_n=4, delay=0)
    assert np.allclose(nav(a), nav(b))


def test_decay_equals_decayed_factor(panel):
    a = VectorEngine(SIGNAL, panel, rebalance_freq=5, top_n=4, delay=1, decay=5)
    b = VectorEngine(ops.Decay_Linear(ops.Ts_Delay(SIGNAL, 1), 5), panel, rebalance_freq=5, top_n=4, delay=0)
    assert np.allclose(nav(a), nav(b))


def test_industry_equals_neutralized_factor(panel):
    move = -ops.Ts_Delta(C, 5)  # ranks would leave ties to the order of summation
    a = VectorEngine(move, panel, rebalance_freq=5, top_n=4, delay=0, industry=True)
    b = VectorEngine(ops.Neutralize(move), panel, rebalance_freq=5, top_n=4, delay=0)
    assert np.allclose(nav(a), nav(b))


def test_factor_table_equals_expression(panel):
    table = panel.factor(SIGNAL).select("date", "symbol", "value")
    assert np.allclose(nav(VectorEngine(SIGNAL, panel, top_n=4)), nav(VectorEngine(table, panel, top_n=4)))


def test_weights_sum_to_one_or_zero(panel):
    rows = VectorEngine(SIGNAL, panel, rebalance_freq=5, top_n=4, weight_method="factor_weighted").run().weights.groupBy("t_idx").agg(F.sum("weight").alias("w"), F.sum((F.col("weight") > 0).cast("int")).alias("n")).collect()
    assert all(abs(r.w - 1) < 1e-9 or r.w == 0 for r in rows) and max(r.n for r in rows) == 4


def test_no_factor_means_no_position(panel):
    daily = VectorEngine(ops.Ts_Delay(C, 500), panel).run()
    row = daily.metrics.first()
    assert row.ann_return == 0 and row.sharpe == 0 and row.ic_mean is None and row.fitness == 0


def test_contracts(panel):
    with pytest.raises(ValueError):
        VectorEngine(SIGNAL, panel, weight_method="other")
    with pytest.raises(ValueError):
        VectorEngine(SIGNAL, panel, start_date="2050-01-01").run()
    for bad in ({"target": "x"}, {"method": "x"}, {"horizon": 0}, {"horizon": 1.5}):
        with pytest.raises(ValueError):
            Labeler.set_label(**bad)
    with pytest.raises(ValueError):
        ParameterTuner(lambda *a: SIGNAL, panel, {}, {"unknown": [1]})
    with pytest.raises(ValueError):
        ParameterTuner(lambda *a: SIGNAL, panel, n_jobs=0)


def test_annual_return_uses_the_row_count(spark):
    daily = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 0.1), (1, 1.1, 0.1, 0.0, 0.5, 0.2), (2, 0.99, -0.1, 0.0, 0.5, None)], "t_idx int, nav double, net_return double, cost double, turnover double, ic double")
    row = performance.summary(daily).first()
    assert row.ann_return == pytest.approx(0.99 ** (252 / 3) - 1) and row.max_drawdown == pytest.approx(-0.1) and row.ic_win_rate == 1


def test_min_variance_weights():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.normal(size=(4, 6))
        cov = a @ a.T
        w = min_variance_weights(cov)
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
        for _ in range(200):
            v = rng.dirichlet(np.ones(4) * 0.4)
            assert w @ cov @ w <= v @ cov @ v + 1e-9


FACTORS = [ops.Ts_Delta(C, 3), -ops.Ts_Std(C, 5)]
LABEL = Labeler.set_label("close", 2)


def test_ridge_equals_a_direct_solution(panel):
    model = MLCombiner("ridge", min_train_periods=40, refit_freq=20).fit(panel, FACTORS, LABEL)
    df = model._ranked(panel, model.factors, y=LABEL).dropna(subset=["x0", "x1", "y"]).where("t_idx < 40").toPandas()
    x = df[["x0", "x1"]].to_numpy()
    xc, yc = x - x.mean(axis=0), df.y - df.y.mean()
    assert np.allclose(model.blocks[0]["coef"], np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc))
    rows = model.predict(panel)
    assert rows.where("t_idx < 40 and value is not null").isEmpty() and not rows.where("t_idx >= 40 and value is not null").isEmpty()


def test_combiners_save_and_load(spark, panel, tmp_path):
    for k, model in enumerate((StatisticalCombiner("ic_weighted"), StatisticalCombiner("min_variance"), MLCombiner("linear", 40))):
        model.fit(panel, FACTORS, LABEL)
        model.save(spark, str(tmp_path / str(k)))
        again = type(model).load(spark, str(tmp_path / str(k)), FACTORS)
        a, b = (m.predict(panel).orderBy("t_idx", "symbol").select("value").toPandas().value for m in (model, again))
        assert np.allclose(a.astype(float), b.astype(float), equal_nan=True)
        with pytest.raises(TypeError):
            (MLCombiner if k < 2 else StatisticalCombiner).load(spark, str(tmp_path / str(k)), FACTORS)
    with pytest.raises(ValueError):
        again.predict(panel, FACTORS[:1])
    with pytest.raises(RuntimeError):
        StatisticalCombiner().predict(panel)
    assert again.evaluate(panel, top_n=3).daily.count() == 70


def test_xgboost_is_optional():
    try:
        import xgboost  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            MLCombiner("xgboost")


def test_tuner(panel):
    def factor(close, volume, high, low, days):
        if days == 0:
            raise ValueError("no")
        return ops.Rank(ops.Ts_Delta(close, days))

    t = ParameterTuner(factor, panel, {"days": [0, 3]}, {"top_n": [3]}, n_jobs=2)
    with pytest.raises(RuntimeError):
        t.top()
    table = t.run()
    assert table.combo_id.tolist() == ["days=3|top_n=3", "days=0|top_n=3"] and t.get_result(2)["sharpe"] != t.get_result(2)["sharpe"]
    with pytest.raises(IndexError):
        t.get_result(3)
    with pytest.raises(KeyError):
        t.get_result_by_id("x")
    assert build_combos({}, {})[0]["id"] == "default"


def test_report(panel):
    result = VectorEngine(SIGNAL, panel, rebalance_freq=5, top_n=4).run()
    tables = panels(result)
    assert tables["nav"].count() == 70 and sum(r.n for r in tables["returns"].collect()) == 70 and "sharpe" in text_summary(result)
