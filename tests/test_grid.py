"""Many back-tests in one plan against one engine each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.operators import ops
from loomfold.plans import grid
from loomfold.plans.backtest import VectorEngine
from loomfold.plans.expr import cell, col
from loomfold.plans.panel import Panel
from loomfold.plans.tuning import ParameterTuner
from loomfold.sources.synthetic import SyntheticMarket

C = col("close")
SHOWN = ["t_idx", "gross_return", "turnover", "cost", "net_return", "nav", "ic"]


@pytest.fixture(scope="module")
def panel(spark):
    p = SyntheticMarket(n_stocks=14, n_days=40, n_industries=3, seed=3).generate(spark)
    df = p.df.withColumns({
        "close": F.when(F.pmod(F.xxhash64("symbol", "t_idx"), F.lit(11)) > 0, F.col("close")),
        "is_suspended": F.pmod(F.xxhash64("t_idx", "symbol"), F.lit(9)) == 0,
    })
    return Panel(df.cache(), p.industry)


def engines(panel):
    fast, slow = -ops.Ts_Delta(C, 2), ops.Ts_Mean(C, 7) / C
    return {
        0: VectorEngine(fast, panel, rebalance_freq=3, top_n=4),
        1: VectorEngine(fast, panel, rebalance_freq=1, top_n=2, weight_method="factor_weighted", cost_rate=0.01),
        2: VectorEngine(fast, panel, rebalance_freq=3, top_n=30, delay=0),
        5: VectorEngine(slow, panel, rebalance_freq=7, top_n=3, decay=4),
        6: VectorEngine(slow, panel, rebalance_freq=7, top_n=3, decay=4, industry=True, weight_method="factor_weighted"),
        8: VectorEngine(C * 0, panel, rebalance_freq=2, top_n=3, weight_method="factor_weighted"),  # all tie, weights are 0
        9: VectorEngine(cell("none", lambda c: F.when(c < 0, c), C), panel, rebalance_freq=2, top_n=3),  # nothing to hold
    }


def table(rows):
    return np.array([[np.nan if r[c] is None else r[c] for c in SHOWN] for r in rows], float)


def test_daily_tables_equal_the_engines(panel):
    own = engines(panel)
    wide, runs = grid.signals(own)
    assert len({r.signal for r in runs}) == 6  # 0 and 1 share theirs
    rows = grid.daily(wide, runs).orderBy("run", "t_idx").collect()
    for number, engine in own.items():
        want = engine.run().daily.orderBy("t_idx").collect()
        got = [r for r in rows if r.run == number]
        np.testing.assert_allclose(table(got), table(want), rtol=1e-9, atol=1e-12)
        assert [(r.date, r.is_rebalance) for r in got] == [(r.date, r.is_rebalance) for r in want]


def test_metrics_equal_the_engines_in_one_or_several_plans(panel, monkeypatch):
    own = engines(panel)
    found = [grid.metrics(own)]
    monkeypatch.setattr(grid, "SIGNALS_A_PLAN", 2)
    found.append(grid.metrics(own))
    for number, engine in own.items():
        want = engine.run().metrics.first().asDict()
        for f in found:
            assert f[number].keys() == want.keys()
            for k, v in want.items():
                assert (f[number][k] is None) == (v is None) and (v is None or f[number][k] == pytest.approx(v, rel=1e-8, abs=1e-12)), (number, k)


def test_dates_are_clipped_and_renumbered(panel):
    dates = [r.date for r in panel.df.select("date").distinct().orderBy("date").collect()]
    own = {n: VectorEngine(-ops.Ts_Delta(C, 2), panel, rebalance_freq=3, top_n=n, start_date=dates[11], end_date=dates[30]) for n in (2, 5)}
    for number, found in grid.metrics(own).items():
        assert found == pytest.approx(own[number].run().metrics.first().asDict(), nan_ok=True)


def test_one_scan_of_the_panel_however_many_combinations(panel):
    """The signals' frame reads the panel once and shuffles it as often for many combinations as for few."""

    def exchanges(n):
        own = {k: VectorEngine(-ops.Ts_Delta(C, 1 + k % 4), panel, rebalance_freq=1 + k % 3, top_n=2 + k, decay=(0, 3)[k % 2]) for k in range(n)}
        wide, runs = grid.signals(own)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert plan.count("InMemoryTableScan") == 1 and len(runs) == n
        return plan.count("Exchange")

    assert exchanges(2) == exchanges(48)


def test_tuner_ranks_fails_and_falls_back(panel, monkeypatch):
    def factor(close, volume, high, low, days):
        if days == 0:
            raise ValueError("no days")
        if days == 1:
            return col("absent")
        return cell(("strict", days), lambda c: F.when(F.lit(days == 7), F.raise_error(F.lit("at run time")).cast("double")).otherwise(c), ops.Ts_Delta(close, days))

    bounds = {"top_n": [2, 4], "start_date": [None, "2200-01-01"]}
    table = ParameterTuner(factor, panel, {"days": [0, 1, 2, 3]}, bounds, opt_target={"sharpe": "asc"}).run()
    good = table[table.error.isna()]
    assert sorted(good.combo_id) == sorted(f"days={d}|start_date=None|top_n={n}" for d in (2, 3) for n in (2, 4)) and good.sharpe.is_monotonic_increasing
    assert table["rank"].tolist() == list(range(1, 17)) and table.error.notna().sum() == 12 and table.sharpe.isna()[4:].all()
    # one that fails as it runs does not take the others with it
    table = ParameterTuner(factor, panel, {"days": [3, 7]}, {"top_n": [2]}, n_jobs=2).run()
    assert table.combo_id.tolist() == ["days=3|top_n=2", "days=7|top_n=2"] and "at run time" in table.error[1]
    alone = VectorEngine(ops.Ts_Delta(C, 3), panel, top_n=2).run().metrics.first()
    assert table.sharpe[0] == pytest.approx(alone.sharpe)
