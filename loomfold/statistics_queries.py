"""Registered queries of statistics, tuned factors and combined tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backtest_queries import METRICS_SQL, _rounded, engine_sql
from .data_queries import FACTORS, LABEL, _tuner_sql, tuner_grid
from .factor_queries import BY, CLOSE, PANEL_SQL, VOLUME, rank_sql, roll, zscore_sql
from .operators import ops
from .plans import performance, statistics
from .plans.expr import col, compile_exprs
from .plans.fusion import MLCombiner, StatisticalCombiner
from .plans.tuning import ParameterTuner
from .sources.bars import supplier_industries, supplier_panel
from .sources.shared import written

POOL = {"move3": ops.Ts_Delta(CLOSE, 3), "volume3": -ops.Ts_Mean(VOLUME, 3), "spread6": ops.Ts_Std(CLOSE, 6), "move12": ops.Ts_Delta(CLOSE, 12), "level5": CLOSE / ops.Ts_Mean(CLOSE, 5)}
POOL_SQL = {
    "move3": f"close - lag(close, 3) OVER {BY}", "volume3": f"-({roll('avg', 'volume', 3)})", "spread6": roll("stddev_samp", "close", 6), "move12": f"close - lag(close, 12) OVER {BY}",
    "level5": f"close / ({roll('avg', 'close', 5)})",
}


def factor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = compile_exprs(supplier_panel(spark, sf_dir).df, POOL)
    return _rounded(statistics.factor_correlations(panel, list(POOL), last=60), "a", "b")


def _factor_matrix_sql() -> str:
    names = list(POOL)
    cells = [f"SELECT '{a}' AS a, '{a}' AS b, CAST(1.0 AS DOUBLE) AS correlation" for a in names]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            daily = f"SELECT CASE WHEN count(*) > 5 AND max({a}) > min({a}) AND max({b}) > min({b}) THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END AS r FROM p1 WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY t_idx"
            cells += [f"SELECT '{x}' AS a, '{y}' AS b, round(avg(r), 6) + 0.0 AS correlation FROM ({daily})" for x, y in ((a, b), (b, a))]
    return f"WITH {PANEL_SQL}, p0 AS (SELECT *, {', '.join(f'{sql} AS {n}' for n, sql in POOL_SQL.items())} FROM panel), p1 AS (SELECT * FROM p0 WHERE t_idx > (SELECT max(t_idx) FROM p0) - 60) " + " UNION ALL ".join(cells)


SHARES = (0.01, 0.05, 0.5, 0.95, 0.99)


def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _rounded(statistics.exact_quantiles(lines, "l_extendedprice", SHARES, ["l_returnflag", "l_linestatus"]), "l_returnflag", "l_linestatus", "share")


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of monthly bars compound to huge numbers, hence the logarithm."""
    stats = performance.universe_statistics(supplier_panel(spark, sf_dir).df)
    return stats.withColumn("log_return", F.round(F.ln(1 + F.col("cum_return")), 6) + F.lit(0.0)).drop("cum_return")


def universe_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_universe(spark, sf_dir), "symbol", "industry", "log_return")


def universe_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.extremes(_universe(spark, sf_dir).select("symbol", "industry", "log_return"), "log_return", 10, "symbol")


_UNIVERSE = (
    f"WITH {PANEL_SQL}, t0 AS (SELECT *, close / nullif(lag(close) OVER {BY}, 0) - 1 AS r FROM panel),"
    " u AS (SELECT symbol, industry, round(ln(product(1 + r)), 6) + 0.0 AS log_return, round(stddev_samp(r) * sqrt(252), 6) + 0.0 AS ann_vol FROM t0 GROUP BY symbol, industry)"
)


def industry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.value_counts(supplier_industries(spark, sf_dir), "industry")


def tuner_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = statistics.pivot_mean(tuner_grid(spark, sf_dir), "sharpe", "f_days", "b_top_n", [5, 10])
    return wide.select("f_days", *((F.round(F.col(n), 5) + F.lit(0.0)).alias(f"top_{n}") for n in ("5", "10")))


def return_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compile_exprs(supplier_panel(spark, sf_dir).df, {"r": CLOSE / ops.Ts_Delay(CLOSE, 1) - 1})
    return _rounded(statistics.density(df, "r"), "point")


_DENSITY = f"""WITH {PANEL_SQL}, r AS (SELECT close / nullif(lag(close) OVER {BY}, 0) - 1 AS x FROM panel),
e AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_samp(x) AS sd, stddev_samp(x) * pow(count(x), -0.2) AS h FROM r),
b AS (SELECT least(1999, floor((x - lo) / ((hi - lo) / 2000))) AS bin, count(*) AS c FROM r, e WHERE x IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 299) AS x FROM range(300) t(i), e)
SELECT point, round(g.x, 6) + 0.0 AS x, round(sum(c * exp(-0.5 * pow((g.x - (lo + (bin + 0.5) * ((hi - lo) / 2000))) / h, 2)) / (h * sqrt(2 * pi()))) / any_value(n), 6) + 0.0 AS kde,
  round(any_value(exp(-0.5 * pow((g.x - m) / sd, 2)) / (sd * sqrt(2 * pi()))), 6) + 0.0 AS normal FROM g, b, e GROUP BY point, g.x"""

WINDOWS, SPREADS, PERIODS = (3, 6), (4, 8), (2, 5)


def _tuned(tuner: ParameterTuner) -> DataFrame:
    tuner.run()
    found = tuner.results().withColumns({c: F.ln(1 + F.col(c)) for c in ("ann_return", "calmar")})
    return _rounded(found, *(c for c in found.columns if c[:2] in ("f_", "b_") or c in ("rank", "combo_id")))


def tuner_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the move by its deviation, or that value itself."""

    def factor(close, volume, high, low, window: int, vol_window: int, use_rank: bool):
        move = ops.Ts_Delta(close, window) / ops.Ts_Std(close, vol_window).nullif(0.0)
        return ops.Rank(move) if use_rank else move

    space = {"window": list(WINDOWS), "vol_window": list(SPREADS), "use_rank": [False, True]}
    return _tuned(ParameterTuner(factor, supplier_panel(spark, sf_dir), space, {"top_n": [5], "rebalance_freq": [1, 3]}, decimals=6))  # as many as the table has


def tuner_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank or z-score of the fall; with equal weights both hold the same names and tie, so the table has no rank."""

    def factor(close, volume, high, low, period: int, use_zscore: bool):
        return ops.ZScore(-ops.Ts_Delta(close, period)) if use_zscore else ops.Rank(-ops.Ts_Delta(close, period))

    space = {"period": list(PERIODS), "use_zscore": [False, True]}
    return _tuned(ParameterTuner(factor, supplier_panel(spark, sf_dir), space, {"top_n": [4, 8], "weight_method": ["equal", "factor_weighted"]})).drop("rank")


_METRICS = "ann_return, ann_vol, sharpe, calmar, max_drawdown, ic_mean, icir, ic_win_rate, avg_turnover, fitness"


def _ranked_sql(rows: list[tuple[str, dict[str, str], str]], columns: list[str]) -> str:
    """A tuner's table from (combination, its columns, its SQL)."""
    parts = [f"SELECT '{name}' AS combo_id, {', '.join(f'{v} AS {k}' for k, v in own.items())}, * FROM ({sql})" for name, own, sql in rows]
    return f"SELECT row_number() OVER (ORDER BY sharpe DESC) AS rank, combo_id, {', '.join(columns)}, {_METRICS} FROM ({' UNION ALL '.join(parts)})"


def _momentum_sql() -> str:
    rows = []
    for ranked in (False, True):
        for spread in SPREADS:
            for window in WINDOWS:
                for freq in (1, 3):
                    move = f"(close - lag(close, {window}) OVER {BY}) / nullif(({roll('stddev_samp', 'close', spread)}), 0)"
                    sql = engine_sql(freq=freq, top=5, move=move, factor=rank_sql("d") if ranked else "d") + METRICS_SQL
                    name = f"use_rank={ranked}|vol_window={spread}|window={window}|rebalance_freq={freq}|top_n=5"
                    rows.append((name, {"f_use_rank": str(ranked), "f_vol_window": f"{spread}::BIGINT", "f_window": f"{window}::BIGINT", "b_rebalance_freq": f"{freq}::BIGINT", "b_top_n": "5::BIGINT"}, sql))
    return _ranked_sql(rows, list(rows[0][1]))


def _reversal_sql() -> str:
    rows = []
    for period in PERIODS:
        for scored in (False, True):
            for top in (4, 8):
                for method in ("equal", "factor_weighted"):
                    sql = engine_sql(method, freq=1, top=top, move=f"-(close - lag(close, {period}) OVER {BY})", factor=zscore_sql("d") if scored else rank_sql("d")) + METRICS_SQL
                    own = {"f_period": f"{period}::BIGINT", "f_use_zscore": str(scored), "b_top_n": f"{top}::BIGINT", "b_weight_method": f"'{method}'"}
                    rows.append((f"period={period}|use_zscore={scored}|top_n={top}|weight_method={method}", own, sql))
    return _ranked_sql(rows, list(rows[0][1]))


#: What each of the three tables and the label have of the panel's grid.
_GRIDS = ("symbol % 7 <> 0 AND t_idx >= 10", "symbol % 5 <> 1 AND t_idx < 75", "t_idx % 9 <> 4", "symbol % 11 <> 3")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    panel = written(compile_exprs(supplier_panel(spark, sf_dir).df, {f"v{i}": e for i, e in enumerate([*FACTORS, LABEL])}), "panel")
    tables = [panel.where(where).select("date", "symbol", F.col(f"v{i}").alias("value")) for i, where in enumerate(_GRIDS)]
    return tables[:3], tables[3]


def fusion_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IC weights of three tables and a label of four grids."""
    factors, label = _tables(spark, sf_dir)
    found = StatisticalCombiner("ic_weighted").fit_tables(factors, label).predict_tables(factors)
    return _rounded(found.select("date", "symbol", "value"), "date", "symbol", nudge=3e-8)


def fusion_tables_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the same tables; trees have no SQL, tests grow them one by one."""
    factors, label = _tables(spark, sf_dir)
    model = MLCombiner("random_forest", min_train_periods=24, refit_freq=20, rf_n_estimators=10, rf_max_depth=4)
    return _rounded(model.fit_tables(factors, label).predict_tables(factors).select("date", "symbol", "value"), "date", "symbol")


def _fusion_tables_sql() -> str:
    def grid(which: range, name: str) -> str:
        where = " AND ".join(f"{c} IN (SELECT {c} FROM q0 WHERE {_GRIDS[i]})" for i in which for c in ("date", "symbol"))
        cells = ", ".join(f"CASE WHEN {_GRIDS[i]} THEN v{i} END AS v{i}" for i in which)
        return f"{name} AS (SELECT date, t_idx, symbol, {cells} FROM q0 WHERE {where})"

    def ic(i: int) -> str:
        a, b = f"CASE WHEN y IS NOT NULL THEN x{i} END", f"CASE WHEN x{i} IS NOT NULL THEN y END"
        return f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END AS ic_{i}"

    values = [f"close - lag(close, 3) OVER {BY}", f"-({roll('avg', 'volume', 3)})", roll("stddev_samp", "close", 6), f"lead(close, 2) OVER {BY} / nullif(close, 0) - 1"]
    ranks = ", ".join(f"{rank_sql(f'v{i}')} AS x{i}" for i in range(3))
    return (
        f"WITH {PANEL_SQL}, q0 AS (SELECT *, {', '.join(f'{v} AS v{i}' for i, v in enumerate(values))} FROM panel), {grid(range(4), 'a0')}, a1 AS (SELECT t_idx, {ranks}, {rank_sql('v3')} AS y FROM a0),"
        f" a2 AS (SELECT {ic(0)}, {ic(1)}, {ic(2)} FROM a1 GROUP BY t_idx), a3 AS (SELECT avg(ic_0) AS a, avg(ic_1) AS b, avg(ic_2) AS c FROM a2), a4 AS (SELECT a / (abs(a) + abs(b) + abs(c)) AS a, b / (abs(a) + abs(b) + abs(c)) AS b, c / (abs(a) + abs(b) + abs(c)) AS c FROM a3),"
        f" {grid(range(3), 'b0')}, b1 AS (SELECT date, symbol, {ranks} FROM b0)"
        " SELECT CAST(date AS DATE) AS date, symbol, round(CASE WHEN coalesce(x0, x1, x2) IS NOT NULL THEN a * coalesce(x0, 0) + b * coalesce(x1, 0) + c * coalesce(x2, 0) END + 3e-8, 6) + 0.0 AS value FROM b1 CROSS JOIN a4"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        factor_matrix, exact_quantiles, universe_returns, universe_extremes, industry_counts, tuner_pivot, return_density, tuner_momentum, tuner_reversal, fusion_tables, fusion_tables_forest,
    )
}
ORACLES: dict[str, str] = {
    "factor_matrix": _factor_matrix_sql(),
    "exact_quantiles": " UNION ALL ".join(
        f"SELECT l_returnflag, l_linestatus, CAST({s} AS DOUBLE) AS share, round(quantile_cont(l_extendedprice, {s}), 6) + 0.0 AS value FROM lineitem GROUP BY l_returnflag, l_linestatus" for s in SHARES
    ),
    "universe_returns": _UNIVERSE + " SELECT * FROM u",
    "universe_extremes": _UNIVERSE
    + ", s AS (SELECT symbol, industry, log_return, 'top' AS side, CAST(row_number() OVER (ORDER BY log_return DESC, symbol) AS INTEGER) AS rank FROM u WHERE log_return IS NOT NULL"
    " UNION ALL SELECT symbol, industry, log_return, 'bottom', CAST(row_number() OVER (ORDER BY log_return, symbol) AS INTEGER) FROM u WHERE log_return IS NOT NULL) SELECT * FROM s WHERE rank <= 10",
    "industry_counts": "SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM (SELECT r_name AS value, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 17 <> 0 GROUP BY r_name)",
    "tuner_pivot": f"SELECT f_days, round(avg(sharpe) FILTER (WHERE b_top_n = 5), 5) + 0.0 AS top_5, round(avg(sharpe) FILTER (WHERE b_top_n = 10), 5) + 0.0 AS top_10 FROM ({_tuner_sql()}) GROUP BY f_days",
    "return_density": _DENSITY,
    "tuner_momentum": _momentum_sql(),
    "tuner_reversal": f"SELECT * EXCLUDE (rank) FROM ({_reversal_sql()})",
    "fusion_tables": _fusion_tables_sql(),
}
