"""Registered queries of the factor operators, with their SQL twins.

Each query runs over the whole monthly supplier panel and returns t_idx, symbol
and value (rounded to six places); the SQL rebuilds the panel from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ops
from .plans.expr import Expr, col
from .sources.bars import LIMIT, supplier_panel

OPEN, HIGH, LOW, CLOSE, VOLUME = map(col, ("open", "high", "low", "close", "volume"))

PANEL_SQL = f"""
px AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS symbol, l_extendedprice / l_quantity AS p, l_quantity AS q,
    row_number() OVER (PARTITION BY date_trunc('month', l_shipdate), l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k
  FROM lineitem
), bars AS (
  SELECT date, symbol, round(max(CASE WHEN k = 1 THEN p END) + 1e-6, 4) AS open, round(max(p) + 1e-6, 4) AS high, round(min(p) + 1e-6, 4) AS low, round(avg(p) + 1e-6, 4) AS close, round(sum(q), 4) AS volume
  FROM px GROUP BY date, symbol
), cal AS (
  SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t_idx FROM (SELECT DISTINCT date FROM bars)
), syms AS (
  SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS symbol_pos FROM (SELECT DISTINCT symbol FROM bars)
), inds AS (
  SELECT s_suppkey AS symbol, r_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 17 <> 0
), grid AS (
  SELECT c.date, c.t_idx, s.symbol, s.symbol_pos, b.open, b.high, b.low, b.close, b.volume, i.industry, i.symbol IS NOT NULL AS industry_known,
    (SELECT count(DISTINCT industry) FROM inds WHERE symbol IN (SELECT symbol FROM syms)) AS n_industries
  FROM cal c CROSS JOIN syms s LEFT JOIN bars b ON b.date = c.date AND b.symbol = s.symbol LEFT JOIN inds i ON i.symbol = s.symbol
), panel AS (
  SELECT *, close IS NULL OR coalesce(volume = 0, false) AS is_suspended,
    coalesce(abs((close - lag(close) OVER w) / nullif(abs(lag(close) OVER w), 0)) >= {LIMIT}, false) AS is_limit
  FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY t_idx)
)"""


def over(n: int, lag: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN {n + lag - 1} PRECEDING AND {lag or 'CURRENT'} {'PRECEDING' if lag else 'ROW'})"


def roll(fn: str, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {over(n, lag)} >= {n if least is None else least} THEN {fn}({x}) OVER {over(n, lag)} END"


BY = "(PARTITION BY symbol ORDER BY t_idx)"
DAY = "(PARTITION BY t_idx)"


def guard(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 1e-10 THEN {x} END"


def rank_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY t_idx ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY t_idx, {x}) - 1) / 2.0)"
        f" / nullif(count({x}) OVER {DAY}, 0) END"
    )


def zscore_sql(x: str) -> str:
    return f"CASE WHEN stddev_samp({x}) OVER {DAY} >= 1e-10 THEN ({x} - avg({x}) OVER {DAY}) / stddev_samp({x}) OVER {DAY} END"


def corr_sql(a: str, b: str, n: int) -> str:
    """Over columns that are null together."""
    w = over(n)
    return (
        f"CASE WHEN count({a}) OVER {w} >= {n} AND max({a}) OVER {w} > min({a}) OVER {w} AND max({b}) OVER {w} > min({b}) OVER {w}"
        f" THEN greatest(-1.0, least(1.0, covar_samp({a}, {b}) OVER {w} / (stddev_samp({a}) OVER {w} * stddev_samp({b}) OVER {w}))) END"
    )


def staged(*stages: str, value: str = "value") -> str:
    """SQL of a value from stages, each a list of columns added to the one before it."""
    ctes, last = [PANEL_SQL], "panel"
    for k, columns in enumerate(stages):
        ctes.append(f"s{k} AS (SELECT *, {columns} FROM {last})")
        last = f"s{k}"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT t_idx, symbol, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM {last}"


def ewm_sql(steps: list[tuple[str, str, float, int]], *stages: str, value: str) -> str:
    """SQL of exponential means (name, input, span, min_periods) over the last stage, by recursion over dates."""
    ctes, last = [PANEL_SQL], "panel"
    for k, columns in enumerate(stages):
        ctes.append(f"s{k} AS (SELECT *, {columns} FROM {last})")
        last = f"s{k}"
    for name, x, span, least in steps:
        a = 2.0 / (span + 1)
        mean = f"CASE WHEN n.{x} IS NULL THEN r.m WHEN r.m IS NULL THEN n.{x} ELSE (r.w * {1 - a!r} * r.m + {a!r} * n.{x}) / (r.w * {1 - a!r} + {a!r}) END"
        weight = f"CASE WHEN n.{x} IS NOT NULL THEN 1.0 WHEN r.m IS NULL THEN 1.0 ELSE r.w * {1 - a!r} END"
        ctes.append(
            f"r_{name}(t_idx, symbol, m, w, c) AS (SELECT t_idx, symbol, CAST({x} AS DOUBLE), CAST(1.0 AS DOUBLE), CASE WHEN {x} IS NULL THEN 0 ELSE 1 END FROM {last} WHERE t_idx = 0 UNION ALL"
            f" SELECT n.t_idx, n.symbol, {mean}, CAST({weight} AS DOUBLE), r.c + CASE WHEN n.{x} IS NULL THEN 0 ELSE 1 END FROM r_{name} r JOIN {last} n ON n.symbol = r.symbol AND n.t_idx = r.t_idx + 1)"
        )
        ctes.append(f"e_{name} AS (SELECT p.*, CASE WHEN r.c >= {max(1, least)} THEN r.m END AS {name} FROM {last} p JOIN r_{name} r USING (t_idx, symbol))")
        last = f"e_{name}"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT t_idx, symbol, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM {last}"


FILL = "last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f"
RET = f"f / nullif(lag(f) OVER {BY}, 0) - 1 AS ret"
PV = "close * volume AS pv"
VW = f"({roll('sum', 'pv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS vw"


def ratio_sql(x: str, s: int = 3, n: int = 10) -> str:
    return f"({roll('avg', x, s)}) / ({guard('(' + roll('avg', x, n, lag=s) + ')')})"


def pooled_sql(n: int, lag: int = 0) -> str:
    w = over(n, lag)
    n1, n2 = f"(count(close) OVER {w})", f"(count(open) OVER {w})"
    m1, m2, v1, v2 = (f"coalesce({f}({c}) OVER {w}, 0)" for f in ("avg", "var_pop") for c in ("close", "open"))
    total = f"({n1} + {n2})"
    return (
        f"CASE WHEN {total} >= 3 AND t_idx >= {n - 1} THEN ({n1} * {v1} + {n2} * {v2} + coalesce(({m1} - {m2}) * ({m1} - {m2}) * {n1} * {n2} / nullif(CAST({total} AS DOUBLE), 0), 0))"
        f" / nullif({total} - 1, 0) END"
    )


PVS = (f"{pooled_sql(3)} AS v1, {pooled_sql(10, 3)} AS v2", f"v1 / ({guard('v2')}) AS pvs")


def _round(x: Expr, places: int) -> Expr:
    """Rounded values, so that float noise neither makes nor breaks ties."""
    from .plans.expr import cell

    return cell(("round", places), lambda a: F.round(a, places), x)


def hurst_sql(n: int) -> str:
    mean = "(list_sum(h) / len(h))"
    dev = f"list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(h[1:i], lambda v: v - {mean})))"
    sd = f"sqrt(list_sum(list_transform(h, lambda v: (v - {mean}) * (v - {mean}))) / (len(h) - 1))"
    return f"CASE WHEN len(h) >= {max(8, n // 2)} AND {sd} >= 1e-10 AND list_max({dev}) > list_min({dev}) THEN ln((list_max({dev}) - list_min({dev})) / {sd}) / ln(len(h) / 2.0) END"


def list_sql(x: str, n: int) -> str:
    return f"list_filter(list({x}) OVER {over(n)}, lambda v: v IS NOT NULL) AS h"


def path_sql(n: int) -> str:
    ranks = "list_transform(h, lambda v: (len(list_filter(h, lambda u: u < v)) + len(list_filter(h, lambda u: u <= v)) + 1) / 2.0)"

    def corr(y: str) -> str:
        m, c = f"(list_sum({y}) / len(h))", "((len(h) + 1) / 2.0)"
        p = f"list_sum(list_transform(range(1, len(h) + 1), lambda i: (i - {c}) * (({y})[i] - {m})))"
        q = f"list_sum(list_transform({y}, lambda v: (v - {m}) * (v - {m})))"
        return f"({p} / sqrt({q} * len(h) * (len(h) * len(h) - 1) / 12.0))"

    return f"CASE WHEN len(h) >= {max(4, n // 2)} AND list_max(h) > list_min(h) THEN abs({corr('rk')}) * {corr('h')} * {corr('h')} END", f"{ranks} AS rk"


def skew_sql(n: int, fn: str, flat: float) -> str:
    w = over(n)
    return f"CASE WHEN count(close) OVER {w} >= {n} THEN CASE WHEN max(close) OVER {w} = min(close) OVER {w} THEN {flat} ELSE {fn}(close) OVER {w} END END AS value"


def decay_sql(x: str, d: int) -> str:
    num = " + ".join(f"coalesce({d - k} * lag({x}, {k}) OVER {BY}, 0)" for k in range(d))
    den = " + ".join(f"CASE WHEN lag({x}, {k}) OVER {BY} IS NULL THEN 0 ELSE {d - k} END" for k in range(d))
    return f"CASE WHEN count({x}) OVER {over(d)} >= {max(1, d // 2)} THEN ({num}) / nullif(CAST({den} AS DOUBLE), 0) END"


def ts_rank_sql(n: int) -> str:
    return f"CASE WHEN len(h) >= {n} AND close IS NOT NULL THEN len(list_filter(h, lambda v: v <= close)) / CAST(len(h) AS DOUBLE) END AS value"


_path, _rk = path_sql(20)
#: A window over the length up to which lists are used.
LONG = 64
_long_path, _long_rk = path_sql(LONG)
_BOTH = "CASE WHEN volume IS NOT NULL THEN close END AS a, CASE WHEN close IS NOT NULL THEN volume END AS b"
_LAGGED = (f"lag(close, 3) OVER {BY} AS l3", "CASE WHEN l3 IS NOT NULL THEN close END AS a, CASE WHEN close IS NOT NULL THEN l3 END AS b")
_MOVE = (f"close - lag(close) OVER {BY} AS mv", "greatest(mv, 0) AS gain0, greatest(-mv, 0) AS loss0", "CASE WHEN mv IS NOT NULL THEN gain0 END AS gain_in, CASE WHEN mv IS NOT NULL THEN loss0 END AS loss_in")
_RSV = (f"{roll('min', 'low', 9)} AS lo, {roll('max', 'high', 9)} AS hi", f"100 * (close - lo) / ({guard('(hi - lo)')}) AS rsv")
_BOLL = (f"{roll('avg', 'close', 10)} AS m, {roll('stddev_samp', 'close', 10)} AS sd", f"CASE WHEN m IS NOT NULL THEN CASE WHEN coalesce(sd >= 1e-10 AND (close > m + 1.5 * sd OR close < m - 1.5 * sd), false) THEN 1.0 ELSE 0.0 END END AS o")
_VSSP = (f"{ratio_sql('volume')} AS spike, {pooled_sql(3)} AS v1, {pooled_sql(10, 3)} AS v2, {ratio_sql('close')} AS pms", f"-(v1 / ({guard('v2')})) AS npvs, -pms AS npms")
_NEUTRAL = (
    "CASE WHEN industry_known THEN CASE WHEN count(CASE WHEN industry_known THEN close END) OVER (PARTITION BY t_idx) < n_industries + 1 OR industry IS NULL THEN close"
    " ELSE close - avg(close) OVER (PARTITION BY t_idx, industry) END END AS value"
)

#: name: (expression, SQL)
FACTORS: dict[str, tuple[Expr, str]] = {
    "ts_sum": (ops.Ts_Sum(VOLUME, 20), staged(f"{roll('sum', 'volume', 20)} AS value")),
    "ts_mean": (ops.Ts_Mean(CLOSE, 20), staged(f"{roll('avg', 'close', 20)} AS value")),
    "ts_max": (ops.Ts_Max(HIGH, 20), staged(f"{roll('max', 'high', 20)} AS value")),
    "ts_min": (ops.Ts_Min(LOW, 20), staged(f"{roll('min', 'low', 20)} AS value")),
    "ts_std": (ops.Ts_Std(CLOSE, 20), staged(f"{roll('stddev_samp', 'close', 20)} AS value")),
    "ts_delta": (ops.Ts_Delta(CLOSE, 5), staged(f"close - lag(close, 5) OVER {BY} AS value")),
    "ts_delay": (ops.Ts_Delay(CLOSE, 5), staged(f"lag(close, 5) OVER {BY} AS value")),
    "ts_lead": (ops.Ts_Delay(CLOSE, -3), staged(f"lead(close, 3) OVER {BY} AS value")),
    "ts_rank": (ops.Ts_Rank(CLOSE, 12), staged(list_sql("close", 12), ts_rank_sql(12))),
    "ts_rank_long": (ops.Ts_Rank(CLOSE, LONG), staged(list_sql("close", LONG), ts_rank_sql(LONG))),
    "ts_corr": (ops.Ts_Corr(CLOSE, VOLUME, 12), staged(_BOTH, f"{corr_sql('a', 'b', 12)} AS value")),
    "ts_skew": (ops.Ts_Skew(CLOSE, 12), staged(skew_sql(12, "skewness", 0.0))),
    "ts_kurt": (ops.Ts_Kurt(CLOSE, 12), staged(skew_sql(12, "kurtosis", -3.0))),
    "ts_autocorr": (ops.Ts_Autocorr(CLOSE, 3, 15), staged(*_LAGGED, f"{corr_sql('a', 'b', 15)} AS value")),
    "ts_hurst": (ops.Ts_Hurst(CLOSE, 20), staged(list_sql("close", 20), f"{hurst_sql(20)} AS value")),
    "ts_hurst_long": (ops.Ts_Hurst(CLOSE, LONG), staged(list_sql("close", LONG), f"{hurst_sql(LONG)} AS value")),
    "decay_linear": (ops.Decay_Linear(CLOSE, 5), staged(f"{decay_sql('close', 5)} AS value")),
    "rank": (ops.Rank(CLOSE), staged(f"{rank_sql('close')} AS value")),
    "zscore": (ops.ZScore(CLOSE), staged(f"{zscore_sql('close')} AS value")),
    "scale": (ops.Scale(CLOSE, 2.0), staged(f"CASE WHEN sum(abs(close)) OVER {DAY} >= 1e-10 THEN close * 2.0 / sum(abs(close)) OVER {DAY} END AS value")),
    "neutralize": (ops.Neutralize(CLOSE), staged(_NEUTRAL)),
    "vwap": (ops.VWAP(CLOSE, VOLUME, 20), staged(PV, VW, value="vw")),
    "vwap_bias": (ops.VWAP_Bias(CLOSE, VOLUME, 20), staged(PV, VW, value=f"close / ({guard('vw')}) - 1")),
    "pv_deviation": (ops.PVDeviation(CLOSE, VOLUME, 20), staged(PV, f"{VW}, {roll('stddev_samp', 'close', 20)} AS sd", value=f"(close - vw) / ({guard('sd')})")),
    "amihud": (ops.Amihud(CLOSE, VOLUME, 6), staged(FILL, RET, "abs(ret) / nullif(volume, 0) AS il", value=roll("avg", "il", 6))),
    "risk_adj_momentum": (ops.RiskAdjMomentum(CLOSE, 6, 12), staged(FILL, RET, f"{roll('stddev_samp', 'ret', 12)} AS sd, f / nullif(lag(f, 6) OVER {BY}, 0) - 1 AS m", value=f"m / ({guard('sd')})")),
    "price_path_quality": (ops.PricePathQuality(CLOSE, 20), staged(list_sql("close", 20), _rk, f"{_path} AS value")),
    "price_path_quality_long": (ops.PricePathQuality(CLOSE, LONG), staged(list_sql("close", LONG), _long_rk, f"{_long_path} AS value")),
    "range_breakout": (ops.RangeBreakout(CLOSE, HIGH, LOW, 12), staged(f"{roll('min', 'low', 12)} AS lo, {roll('max', 'high', 12)} AS hi", value=f"(close - lo) / ({guard('(hi - lo)')})")),
    "rsi": (ops.RSI(CLOSE, 14), ewm_sql([("g", "gain_in", 27, 14), ("l", "loss_in", 27, 14)], *_MOVE, value="100 - 100 / (1 + g / nullif(l, 0))")),
    "kdj": (ops.KDJ(CLOSE, HIGH, LOW), ewm_sql([("k", "rsv", 5, 9)], *_RSV, value="k")),
    "kdj_j": (ops.KDJ_Lines(CLOSE, HIGH, LOW)[2], ewm_sql([("k", "rsv", 5, 9), ("dd", "k", 5, 1)], *_RSV, value="3 * k - 2 * dd")),
    "vol_spike": (ops.VolSpike(VOLUME), staged(f"{ratio_sql('volume')} AS value")),
    "price_var_shrink": (ops.PriceVarShrink(CLOSE, OPEN), staged(*PVS, value="pvs")),
    "price_mean_shrink": (ops.PriceMeanShrink(CLOSE), staged(f"{ratio_sql('close')} AS value")),
    "vol_spike_stable_price": (ops.VolSpikeStablePrice(VOLUME, CLOSE, OPEN), staged(*_VSSP, value=f"({zscore_sql('spike')} + {zscore_sql('npvs')} + {zscore_sql('npms')}) / 3")),
    "bollinger_outlier_frequency": (ops.Bollinger_Outlier_Frequency(CLOSE, 10, 1.5, 12), staged(*_BOLL, value=roll("avg", "o", 12))),
    "turnover_proxy": (ops.Turnover_Proxy(VOLUME, 24, 6), staged(f"volume / nullif({roll('avg', 'volume', 24, 6)}, 0) AS tp", value="CASE WHEN tp <> 0 THEN greatest(tp, 0) END")),
    "williams_r": (ops.Williams_R(CLOSE, HIGH, LOW, 14), staged(f"{roll('max', 'high', 14)} AS hi, {roll('min', 'low', 14)} AS lo", value="(close - hi) / nullif(hi - lo + 1e-8, 0)")),
    "skip_momentum": (ops.Skip_Momentum(CLOSE), staged(f"close / nullif(lag(close, 21) OVER {BY}, 0) - close / nullif(lag(close, 5) OVER {BY}, 0) AS value")),
    "factor_combination": (
        0.4 * ops.Rank(CLOSE) + 0.4 * ops.Rank(-VOLUME) + 0.2 * ops.Rank(HIGH),
        staged("-volume AS nv", value=f"0.4 * ({rank_sql('close')}) + 0.4 * ({rank_sql('nv')}) + 0.2 * ({rank_sql('high')})"),
    ),
    "factor_technical": (
        ops.ZScore(ops.Decay_Linear(ops.Rank(_round(ops.Ts_Delta(CLOSE, 10), 6)), 5)),
        staged(f"round(close - lag(close, 10) OVER {BY}, 6) AS d", f"{rank_sql('d')} AS r", f"round({decay_sql('r', 5)}, 12) AS dl", value=zscore_sql("dl")),
    ),
    "triple_signal": (
        ops.VolSpike(VOLUME).where((ops.VolSpike(VOLUME) > 1.0) & (ops.PriceVarShrink(CLOSE, OPEN) < 1.0) & (ops.PriceMeanShrink(CLOSE) < 1.0)),
        staged(f"{PVS[0]}, {ratio_sql('volume')} AS spike, {ratio_sql('close')} AS pms", PVS[1], value="CASE WHEN spike > 1.0 AND pvs < 1.0 AND pms < 1.0 THEN spike END"),
    ),
}
_MACD1 = [("f12", "close", 12, 12), ("s26", "close", 26, 26)]


def macd_sql() -> str:
    """The signal line is a mean of the line, so the recursion runs on a stage over the first two."""
    first = ewm_sql(_MACD1, value="f12")
    body = first.split(" SELECT t_idx, symbol, round(CAST(f12")[0]
    second = ewm_sql([("sig", "line", 9, 9)], value="line - sig")
    rest = second[second.index("r_sig(") :].replace("FROM panel", "FROM lines").replace("JOIN panel", "JOIN lines")
    return f"{body}, lines AS (SELECT *, f12 - s26 AS line FROM e_s26), {rest}"


FACTORS["macd"] = (ops.MACD(CLOSE), macd_sql())


def _query(e: Expr) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = supplier_panel(spark, sf_dir).factor(e)
        return value.select("t_idx", "symbol", (F.round("value", 6) + F.lit(0.0)).alias("value"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(e) for k, (e, _) in FACTORS.items()}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in FACTORS.items()}
