"""Registered queries of the back-test and its metrics, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .factor_queries import BY, CLOSE, PANEL_SQL, _round, decay_sql, rank_sql
from .operators import ops
from .plans import performance
from .plans.backtest import VectorEngine
from .plans.expr import Expr, col, compile_exprs
from .sources.bars import supplier_panel

FREQ, TOP, COST = 5, 5, 0.0015
MOVE = _round(ops.Ts_Delta(CLOSE, 20), 6)
SIGNAL = ops.Rank(MOVE)


def _engine(spark: SparkSession, sf_dir: str, factor: Expr = SIGNAL, **kw) -> VectorEngine:
    return VectorEngine(factor, supplier_panel(spark, sf_dir), rebalance_freq=FREQ, top_n=TOP, cost_rate=COST, **kw)


def _rounded(df: DataFrame, *exact: str, nudge: float = 0.0) -> DataFrame:
    """Six places; ``nudge`` moves values that lie exactly midway between two."""
    return df.select(*exact, *((F.round(F.col(c) + nudge, 6) + F.lit(0.0)).alias(c) for c in df.columns if c not in exact))


def engine_sql(method: str = "equal", decay: int = 0, neutral: bool = False, *, ranked: bool | None = None, days: int = 20, freq: int = FREQ, top: int = TOP, move: str | None = None, factor: str | None = None) -> str:
    """CTEs up to ``daily`` of the engine; ``move`` replaces the move d by other SQL over the panel, ``factor`` what is made of d."""
    ranked = not neutral if ranked is None else ranked
    f1 = f"lag(f0) OVER {BY} AS f1"
    f2 = f"{decay_sql('f1', decay)} AS f2" if decay else "f1 AS f2"
    f3 = (
        "CASE WHEN industry_known THEN CASE WHEN count(CASE WHEN industry_known THEN f2 END) OVER (PARTITION BY t_idx) < n_industries + 1 OR industry IS NULL THEN f2"
        " ELSE f2 - avg(f2) OVER (PARTITION BY t_idx, industry) END END AS f"
        if neutral
        else "f2 AS f"
    )
    weight = "1.0 / n" if method == "equal" else "CASE WHEN s > 1e-10 THEN abs(x) / s ELSE 1.0 / n END"
    return f"""WITH {PANEL_SQL},
a0 AS (SELECT *, {move or f"round(close - lag(close, {days}) OVER {BY}, 6)"} AS d, close / nullif(lag(close) OVER {BY}, 0) - 1 AS ret FROM panel),
a1 AS (SELECT *, {factor or (rank_sql('d') if ranked else 'd')} AS f0 FROM a0),
a2 AS (SELECT *, {f1} FROM a1),
a3 AS (SELECT *, {f2} FROM a2),
a4 AS (SELECT *, {f3} FROM a3),
b0 AS (SELECT *, CASE WHEN t_idx % {freq} = 0 AND NOT (is_suspended OR is_limit) THEN f END AS x FROM a4),
b1 AS (SELECT *, row_number() OVER (PARTITION BY t_idx ORDER BY x DESC NULLS LAST, symbol_pos) AS k FROM b0),
b2 AS (SELECT *, k <= {top} AND x IS NOT NULL AS picked FROM b1),
b3 AS (SELECT *, sum(CASE WHEN picked THEN 1 ELSE 0 END) OVER (PARTITION BY t_idx) AS n, sum(CASE WHEN picked THEN abs(x) END) OVER (PARTITION BY t_idx) AS s FROM b2),
b4 AS (SELECT *, CASE WHEN t_idx % {freq} = 0 THEN CASE WHEN picked THEN {weight} ELSE 0.0 END END AS w0 FROM b3),
b5 AS (SELECT h.*, coalesce(r.w0, 0) AS weight FROM b4 h LEFT JOIN b4 r ON r.symbol = h.symbol AND r.t_idx = h.t_idx - h.t_idx % {freq}),
b6 AS (SELECT *, abs(weight - lag(weight) OVER {BY}) AS traded FROM b5),
g0 AS (SELECT date, t_idx, CASE WHEN t_idx = 0 THEN 0.0 ELSE coalesce(sum(weight * ret), 0) END AS gross_return, CASE WHEN t_idx = 0 THEN 0.0 ELSE coalesce(sum(traded) / 2, 0) END AS turnover FROM b6 GROUP BY date, t_idx),
g1 AS (SELECT *, turnover * {COST} AS cost, gross_return - turnover * {COST} AS net_return FROM g0),
g2 AS (SELECT *, CASE WHEN t_idx = 0 THEN 1.0 ELSE product(1 + net_return) OVER (ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS nav FROM g1),
i0 AS (SELECT t_idx, {rank_sql('f')} AS rf, {rank_sql('ret')} AS rr FROM b6),
i1 AS (SELECT t_idx, rf - avg(rf) OVER (PARTITION BY t_idx) AS rf, rr - avg(rr) OVER (PARTITION BY t_idx) AS rr FROM i0),
i2 AS (SELECT t_idx, coalesce(sum(rf * rr), 0) / nullif(sqrt(sum(rf * rf)) * sqrt(sum(rr * rr)), 0) AS ic FROM i1 GROUP BY t_idx),
daily AS (SELECT g2.*, i2.ic, t_idx % {freq} = 0 AS is_rebalance FROM g2 LEFT JOIN i2 USING (t_idx)),
dd AS (SELECT *, nav / max(nav) OVER (ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM daily)"""


DAILY_SQL = (
    " SELECT CAST(date AS DATE) AS date, t_idx, is_rebalance, round(CAST(gross_return AS DOUBLE), 6) + 0.0 AS gross_return, round(turnover, 6) + 0.0 AS turnover, round(cost, 6) + 0.0 AS cost,"
    " round(net_return, 6) + 0.0 AS net_return, round(nav, 6) + 0.0 AS nav, round(ic, 6) + 0.0 AS ic FROM daily"
)
METRICS_SQL = """,
m0 AS (SELECT count(*) AS n, max_by(nav, t_idx) / min_by(nav, t_idx) AS ratio, avg(net_return) AS mean, stddev_samp(net_return) AS sd, min(drawdown) AS dd, avg(turnover) AS tu, avg(cost) AS co,
  count(ic) AS n_ic, avg(ic) AS icm, stddev_samp(ic) AS ics, avg(CASE WHEN ic IS NOT NULL THEN CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END END) AS win FROM dd),
m1 AS (SELECT *, CASE WHEN ratio <= 0 THEN -1.0 ELSE pow(ratio, 252.0 / n) - 1 END AS ann_return, CASE WHEN sd < 1e-10 THEN 0 ELSE mean / sd * sqrt(252) END AS sharpe FROM m0)
SELECT round(ln(1 + ann_return), 6) + 0.0 AS ann_return, round(sd * sqrt(252), 6) + 0.0 AS ann_vol, round(sharpe, 6) + 0.0 AS sharpe,
  round(ln(1 + CASE WHEN abs(dd) < 1e-10 THEN 0 ELSE ann_return / abs(dd) END), 6) + 0.0 AS calmar, round(dd, 6) + 0.0 AS max_drawdown, round(icm, 6) + 0.0 AS ic_mean, round(ics, 6) + 0.0 AS ic_std,
  round(icm / ics * sqrt(252), 6) + 0.0 AS icir, round(win, 6) + 0.0 AS ic_win_rate, round(icm * sqrt(n_ic) / ics, 6) + 0.0 AS ic_t, round(tu, 6) + 0.0 AS avg_turnover, round(co * 252, 6) + 0.0 AS ann_cost,
  round(CASE WHEN abs(ann_return) < 1e-10 OR tu < 1e-10 THEN 0 ELSE sharpe * sqrt(abs(ann_return) / tu) END, 6) + 0.0 AS fitness FROM m1"""


def backtest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_engine(spark, sf_dir).run().daily, "date", "t_idx", "is_rebalance")


def backtest_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of ranks would tie but for the order of summation, so the factor is the move itself."""
    return _rounded(_engine(spark, sf_dir, MOVE, weight_method="factor_weighted", decay=3, industry=True).run().daily, "date", "t_idx", "is_rebalance")


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _engine(spark, sf_dir).run().metrics  # returns of monthly bars compound to huge years, hence the logarithms
    return _rounded(metrics.withColumn("ann_return", F.ln(1 + F.col("ann_return"))).withColumn("calmar", F.ln(1 + F.col("calmar"))))


def backtest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_engine(spark, sf_dir).run().positions.where("weight > 0").select("t_idx", "symbol", "weight"), "t_idx", "symbol")


def backtest_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.drawdown(_engine(spark, sf_dir).run().daily), "t_idx")


def backtest_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.monthly_returns(_engine(spark, sf_dir).run().daily), "year", "month")


def backtest_rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.rolling_ic(_engine(spark, sf_dir).run().daily), "t_idx")


def _two_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_exprs(supplier_panel(spark, sf_dir).df, {"f": ops.Ts_Delta(CLOSE, 3), "g": ops.Ts_Mean(col("volume"), 3)})


def forward_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.forward_ic_stats(performance.forward_ic(_two_factors(spark, sf_dir), "f", "close", 3)))


def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance.mean_factor_correlation(_two_factors(spark, sf_dir), "f", "g"))


def universe_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = performance.universe_statistics(supplier_panel(spark, sf_dir).df)
    return stats.groupBy("industry").agg(F.count("*").alias("n"), (F.round(F.median("ann_vol"), 6) + F.lit(0.0)).alias("ann_vol"))


_TWO = f"WITH {PANEL_SQL}, t0 AS (SELECT *, close - lag(close, 3) OVER {BY} AS f, CASE WHEN count(volume) OVER w >= 3 THEN avg(volume) OVER w END AS g, lead(close, 3) OVER {BY} / nullif(close, 0) - 1 AS y FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (backtest_daily, backtest_weighted, backtest_metrics, backtest_weights, backtest_drawdown, backtest_monthly, backtest_rolling_ic, forward_ic, factor_correlation, universe_statistics)
}
ORACLES: dict[str, str] = {
    "backtest_daily": engine_sql() + DAILY_SQL,
    "backtest_weighted": engine_sql("factor_weighted", 3, True) + DAILY_SQL,
    "backtest_metrics": engine_sql() + METRICS_SQL,
    "backtest_weights": engine_sql() + " SELECT t_idx, symbol, round(CAST(weight AS DOUBLE), 6) + 0.0 AS weight FROM b5 WHERE weight > 0",
    "backtest_drawdown": engine_sql() + " SELECT t_idx, round(nav, 6) + 0.0 AS nav, round(drawdown, 6) + 0.0 AS drawdown FROM dd",
    "backtest_monthly": engine_sql() + " SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, round(product(1 + net_return) - 1, 6) + 0.0 AS ret FROM daily GROUP BY year(date), month(date)",
    "backtest_rolling_ic": engine_sql()
    + " SELECT t_idx, round(ic, 6) + 0.0 AS ic, round(CASE WHEN count(ic) OVER w >= 20 THEN avg(ic) OVER w END, 6) + 0.0 AS rolling_ic, round(CASE WHEN ic IS NOT NULL THEN sum(ic) OVER (ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS cumulative_ic"
    " FROM daily WINDOW w AS (ORDER BY t_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "forward_ic": _TWO + f""", t1 AS (SELECT * FROM t0 WHERE f IS NOT NULL AND y IS NOT NULL), t2 AS (SELECT t_idx, {rank_sql('f')} AS rf, {rank_sql('y')} AS rr FROM t1),
t3 AS (SELECT t_idx, CASE WHEN count(*) > 10 AND max(rf) > min(rf) AND max(rr) > min(rr) THEN covar_samp(rf, rr) / (stddev_samp(rf) * stddev_samp(rr)) END AS ic FROM t2 GROUP BY t_idx)
SELECT round(avg(ic), 6) + 0.0 AS ic_mean, round(avg(ic) / (stddev_pop(ic) + 1e-10), 6) + 0.0 AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS ic_win FROM t3 WHERE ic IS NOT NULL""",
    "factor_correlation": _TWO + """, t1 AS (SELECT t_idx, CASE WHEN count(*) > 5 AND max(f) > min(f) AND max(g) > min(g) THEN covar_samp(f, g) / (stddev_samp(f) * stddev_samp(g)) END AS r FROM t0 WHERE f IS NOT NULL AND g IS NOT NULL GROUP BY t_idx)
SELECT round(avg(r), 6) + 0.0 AS correlation FROM t1""",
    "universe_statistics": f"WITH {PANEL_SQL}, t0 AS (SELECT *, close / nullif(lag(close) OVER {BY}, 0) - 1 AS r FROM panel), t1 AS (SELECT symbol, industry, stddev_samp(r) * sqrt(252) AS ann_vol FROM t0 GROUP BY symbol, industry)"
    " SELECT industry, count(*) AS n, round(median(ann_vol), 6) + 0.0 AS ann_vol FROM t1 GROUP BY industry",
}
