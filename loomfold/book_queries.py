"""Registered queries of a book of composed factors, with their SQL twins.

Values are rounded before they are ranked, so that noise in their last digits
neither makes nor breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import factor_queries as fq
from .factor_queries import BY, CLOSE, FILL, HIGH, LOW, PANEL_SQL, PV, RET, VOLUME, _query, _round, corr_sql, decay_sql, guard, list_sql, path_sql, rank_sql, roll, staged
from .operators import ops
from .operators.timeseries import Pct_Change
from .plans.expr import Expr

_TS_RANK = "CASE WHEN len(h) >= {n} AND {x} IS NOT NULL THEN len(list_filter(h, lambda v: v <= {x})) / CAST(len(h) AS DOUBLE) END"
_RANGE20 = f"{roll('min', 'low', 20)} AS lo, {roll('max', 'high', 20)} AS hi"
_BOTH = "CASE WHEN volume IS NOT NULL THEN close END AS a, CASE WHEN close IS NOT NULL THEN volume END AS b"
_PPQ, _RANKS = path_sql(20)


def _ranked(x: Expr, *stages: str, value: str, places: int = 6) -> tuple[Expr, str]:
    """Rank of an expression, and its SQL from stages and the value over the last of them."""
    return ops.Rank(_round(x, places)), staged(*stages, f"round(CAST({value} AS DOUBLE), {places}) AS b0", value=rank_sql("b0"))


def _ranked_of(x: Expr, inner: str, value: str) -> tuple[Expr, str]:
    """The same over a whole query that gives ``value``."""
    return ops.Rank(_round(x, 6)), f"SELECT t_idx, symbol, round(CAST({rank_sql('b0')} AS DOUBLE), 6) + 0.0 AS value FROM (SELECT t_idx, symbol, {value} AS b0 FROM ({inner}))"


def _unrounded(sql: str) -> str:
    """The SQL of a rank with all digits, for what is composed of it."""
    return "), 15) + 0.0 AS value".join(sql.rsplit("), 6) + 0.0 AS value", 1))


def _neutral(x: tuple[Expr, str]) -> tuple[Expr, str]:
    """Residuals by industry of a rank, which the SQL has as ``value``."""
    return ops.Neutralize(x[0]), (
        f"WITH {PANEL_SQL}, n0 AS (SELECT p.*, r.value AS v FROM panel p JOIN ({_unrounded(x[1])}) r USING (t_idx, symbol)) SELECT t_idx, symbol, round(CASE WHEN industry_known THEN"
        " CASE WHEN count(CASE WHEN industry_known THEN v END) OVER (PARTITION BY t_idx) < n_industries + 1 OR industry IS NULL THEN v ELSE v - avg(v) OVER (PARTITION BY t_idx, industry) END END, 6) + 0.0 AS value FROM n0"
    )


_REV5 = _ranked(-ops.Ts_Delta(CLOSE, 5), value=f"-(close - lag(close, 5) OVER {BY})")
_LOWVOL = _ranked(-ops.Ts_Std(Pct_Change(CLOSE), 20), FILL, RET, value=f"-({roll('stddev_samp', 'ret', 20)})")
_CORR = _ranked(-ops.Ts_Corr(VOLUME, CLOSE, 10), _BOTH, value=f"-({corr_sql('b', 'a', 10)})")
_SKEW20 = fq.skew_sql(20, "skewness", 0.0).replace("close", "ret").replace(" AS value", "")

BOOK: dict[str, tuple[Expr, str]] = {
    "book_reversal": _REV5,
    "book_momentum": _ranked(ops.Skip_Momentum(CLOSE), value=f"close / nullif(lag(close, 21) OVER {BY}, 0) - close / nullif(lag(close, 5) OVER {BY}, 0)"),
    "book_decayed_momentum": _ranked(
        ops.Decay_Linear(ops.Rank(_round(ops.Ts_Delta(CLOSE, 10), 6)), 5), f"round(close - lag(close, 10) OVER {BY}, 6) AS d", f"{rank_sql('d')} AS r", value=decay_sql("r", 5), places=9
    ),
    "book_risk_adjusted": _ranked(ops.RiskAdjMomentum(CLOSE, 20, 20), FILL, RET, f"{roll('stddev_samp', 'ret', 20)} AS sd, f / nullif(lag(f, 20) OVER {BY}, 0) - 1 AS m", value=f"m / ({guard('sd')})"),
    "book_path_quality": _ranked(ops.PricePathQuality(CLOSE, 20), list_sql("close", 20), _RANKS, value=_PPQ, places=9),
    "book_volume_rank": _ranked(-ops.Ts_Rank(VOLUME, 20), list_sql("volume", 20), value="-(" + _TS_RANK.format(n=20, x="volume") + ")"),
    "book_breakout": _ranked(
        ops.Ts_Rank(CLOSE, 40) + ops.Ts_Rank(VOLUME, 20), list_sql("close", 40), f"{_TS_RANK.format(n=40, x='close')} AS p", f"{list_sql('volume', 20)}2".replace(" AS h2", " AS g"),
        f"{_TS_RANK.format(n=20, x='volume').replace('len(h)', 'len(g)').replace('list_filter(h', 'list_filter(g')} AS q", value="p + q",
    ),
    "book_pv_deviation": _ranked(-ops.PVDeviation(CLOSE, VOLUME, 10), PV, f"({roll('sum', 'pv', 10)}) / nullif({roll('sum', 'volume', 10)}, 0) AS vw, {roll('stddev_samp', 'close', 10)} AS sd", value=f"-((close - vw) / ({guard('sd')}))"),
    "book_liquidity": _ranked(-ops.Amihud(CLOSE, VOLUME, 20), FILL, RET, "abs(ret) / nullif(volume, 0) AS il", value=f"-({roll('avg', 'il', 20)})", places=9),
    "book_low_volatility": _LOWVOL,
    "book_low_skew": _ranked(-ops.Ts_Skew(Pct_Change(CLOSE), 20), FILL, RET, value=f"-({_SKEW20})"),
    "book_rsi": _ranked_of(100 - ops.RSI(CLOSE, 14), fq.FACTORS["rsi"][1], "100 - value"),
    "book_macd": _ranked_of(ops.MACD(CLOSE), fq.FACTORS["macd"][1], "value"),
    "book_kdj": _ranked_of(50 - ops.KDJ(CLOSE, HIGH, LOW), fq.FACTORS["kdj"][1], "50 - value"),
    "book_range_breakout": _ranked(ops.RangeBreakout(CLOSE, HIGH, LOW, 20), _RANGE20, value=f"(close - lo) / ({guard('(hi - lo)')})"),
    "book_williams": _ranked(-ops.Williams_R(CLOSE, HIGH, LOW, 20), _RANGE20, value="-((close - hi) / nullif(hi - lo + 1e-8, 0))"),
    "book_small_cap": _ranked(-(CLOSE * VOLUME), value="-(close * volume)"),
    "book_price_volume": _CORR,
    "book_combination": (
        0.4 * _REV5[0] + 0.3 * _CORR[0] + 0.3 * _LOWVOL[0],
        f"SELECT t_idx, symbol, round(0.4 * a.value + 0.3 * b.value + 0.3 * c.value, 6) + 0.0 AS value FROM ({_unrounded(_REV5[1])}) a JOIN ({_unrounded(_CORR[1])}) b USING (t_idx, symbol) JOIN ({_unrounded(_LOWVOL[1])}) c USING (t_idx, symbol)",
    ),
}
BOOK["book_reversal_neutral"] = _neutral(_ranked(-ops.Ts_Delta(CLOSE, 20), value=f"-(close - lag(close, 20) OVER {BY})"))
BOOK["book_price_volume_neutral"] = _neutral(_CORR)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(e) for k, (e, _) in BOOK.items()}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in BOOK.items()}
