"""Registered queries of the data layer, fusion, tuning and streams, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backtest_queries import METRICS_SQL, _rounded, engine_sql
from .factor_queries import BY, CLOSE, PANEL_SQL, VOLUME, _round, rank_sql, roll, staged
from .operators import ops
from .plans import performance
from .plans.expr import col
from .plans.fusion import Labeler, MLCombiner, StatisticalCombiner
from .plans.panel import Panel
from .plans.tuning import ParameterTuner
from .sources import loader, providers, validation
from .sources.bars import event_panel, supplier_bars, supplier_panel
from .sources.repository import Repository
from .sources.shared import fresh_folder
from .sources.synthetic import SyntheticMarket
from .streaming.upsert import stream_into

CUT, BACK = "1998-01-01", "1997-06-01"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars before a cut, and corrected bars from an earlier date on."""
    bars = supplier_bars(spark, sf_dir)
    close = F.when(F.col("symbol") % 3 == 0, F.col("close") + 1).when(F.col("symbol") % 5 != 0, F.col("close"))
    return bars.where(F.col("date") < F.lit(CUT).cast("date")), bars.where(F.col("date") >= F.lit(BACK).cast("date")).withColumn("close", close)


_OLD_NEW = f"""WITH {PANEL_SQL}, o AS (SELECT * FROM bars WHERE date < DATE '{CUT}'),
n AS (SELECT date, symbol, open, high, low, CASE WHEN symbol % 3 = 0 THEN close + 1 WHEN symbol % 5 <> 0 THEN close END AS close, volume FROM bars WHERE date >= DATE '{BACK}')"""


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return _rounded(validation.merge(new, old).select("date", "symbol", "close", "volume"), "date", "symbol")


def upsert_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return _rounded(validation.merge_fill(new, old).select("date", "symbol", "close", "volume"), "date", "symbol")


def upsert_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return validation.diff_summary(new, old).select("symbol", "new_rows", "overlap_rows", "kept_rows", "updated_cells")


def validate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = supplier_bars(spark, sf_dir).withColumn("high", F.when(F.col("symbol") % 11 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("symbol") % 13 == 0, -F.col("volume")).otherwise(F.col("volume")))
    return validation.validate(bars, "ohlcv").groupBy("rule").agg(F.sum("n").alias("n"))


_RULES = {
    "duplicate": "false", **{f"null_{c}": f"{c} IS NULL" for c in ("open", "high", "low", "close")},
    **{f"{a}_below_{b}": f"{a} < {b}" for a, b in (("high", "low"), ("high", "open"), ("high", "close"), ("open", "low"), ("close", "low"))},
    **{f"negative_{c}": f"{c} < 0" for c in ("open", "high", "low", "close", "volume")},
}


def _factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars as text symbols, and a factor on some of their dates and on dates outside the calendar."""
    bars = supplier_bars(spark, sf_dir)
    month = F.year("date") * 12 + F.month("date")
    own = bars.where((month + F.col("symbol")) % 9 == 0).select("symbol", "date", (1 + month % 100 / 100).alias("hfq_factor"))
    return bars, own.unionByName(bars.select("symbol", F.date_add("date", 3).alias("date"), F.lit(9.0).alias("hfq_factor")))


_FACTOR_SQL = f"""WITH {PANEL_SQL}, f AS (SELECT symbol, date, 1 + ((year(date) * 12 + month(date)) % 100) / 100.0 AS h FROM bars WHERE (year(date) * 12 + month(date) + symbol) % 9 = 0),
j AS (SELECT g.*, f.h FROM grid g LEFT JOIN f ON f.symbol = g.symbol AND f.date = g.date),
k AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(h IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS hfq FROM j)"""


def factor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, factors = _factors(spark, sf_dir)
    grid = loader.align_factor(Panel.from_facts(bars).df, factors)
    return _rounded(grid.select("t_idx", "symbol", "hfq_factor"), "t_idx", "symbol")


def _loaded(adj_type: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars, factors = _factors(spark, sf_dir)
        df = loader.load(bars, factors, adj_type=adj_type).panel.df
        return _rounded(df.select("t_idx", "symbol", "close", "is_suspended"), "t_idx", "symbol", "is_suspended", nudge=3e-8)

    return run


def _loaded_sql(by: str) -> str:
    return (
        _FACTOR_SQL + f", l AS (SELECT *, close * {by} AS c FROM k), m AS (SELECT *, count(c) OVER (PARTITION BY symbol) AS n FROM l)"
        " SELECT t_idx, symbol, close IS NULL OR coalesce(volume = 0, false) AS is_suspended,"
        " round(last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 3e-8, 6) + 0.0 AS close FROM m WHERE n >= 20"
    )


def adjustment_stairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = supplier_bars(spark, sf_dir)
    month = F.year("date") * 12 + F.month("date")
    scaled = lambda k: bars.select("symbol", "date", (F.col("close") * (1 + month % k / 10)).alias("close"))
    ex = bars.where((month + F.col("symbol")) % 4 == 0).select("symbol", "date")
    return _rounded(providers.adjustment_factors(bars.select("symbol", "date", "close"), scaled(7), scaled(5), ex), "symbol", "date", nudge=3e-8)


_STAIRS = f"""WITH {PANEL_SQL}, r AS (SELECT symbol, date, year(date) * 12 + month(date) AS mo FROM bars WHERE close > 0),
s AS (SELECT symbol, date, (mo + symbol) % 4 = 0 AS ex, 1 + (mo % 7) / 10.0 AS rq, 1 + (mo % 5) / 10.0 AS rh FROM r),
u AS (SELECT *, CASE WHEN ex THEN coalesce(rq / lag(rq) OVER (PARTITION BY symbol ORDER BY date), 1) ELSE 1 END AS sq, CASE WHEN ex THEN coalesce(rh / lag(rh) OVER (PARTITION BY symbol ORDER BY date), 1) ELSE 1 END AS sh FROM s)
SELECT symbol, date, round(product(sq) OVER w * first_value(rq) OVER w + 3e-8, 6) + 0.0 AS qfq_factor, round(product(sh) OVER w * first_value(rh) OVER w + 3e-8, 6) + 0.0 AS hfq_factor
FROM u WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def factor_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = supplier_bars(spark, sf_dir).select("symbol", "date", F.col("close").alias("hfq_factor"))
    return validation.hfq_violations(bars).groupBy("symbol").agg(F.count("*").alias("n"))


FACTORS = [ops.Ts_Delta(CLOSE, 3), -ops.Ts_Mean(VOLUME, 3), ops.Ts_Std(CLOSE, 6)]
LABEL = Labeler.set_label("close", 2)


def _label(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(supplier_panel(spark, sf_dir).factor(Labeler.set_label("close", 3, method)).select("t_idx", "symbol", "value"), "t_idx", "symbol")

    return run


def _combined(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = supplier_panel(spark, sf_dir)
        return _rounded(StatisticalCombiner(method).fit(panel, FACTORS, LABEL).predict(panel).select("t_idx", "symbol", "value"), "t_idx", "symbol", nudge=3e-8)

    return run


_RANKS = (
    f"WITH {PANEL_SQL}, q0 AS (SELECT *, close - lag(close, 3) OVER {BY} AS f0, -({roll('avg', 'volume', 3)}) AS f1, {roll('stddev_samp', 'close', 6)} AS f2, lead(close, 2) OVER {BY} / nullif(close, 0) - 1 AS y0 FROM panel),"
    f" q1 AS (SELECT t_idx, symbol, {rank_sql('f0')} AS x0, {rank_sql('f1')} AS x1, {rank_sql('f2')} AS x2, {rank_sql('y0')} AS y FROM q0)"
)


def _ic(i: int) -> str:
    a, b = f"CASE WHEN y IS NOT NULL THEN x{i} END", f"CASE WHEN x{i} IS NOT NULL THEN y END"
    return f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END AS ic_{i}"


_ICS = _RANKS + f", q2 AS (SELECT t_idx, {_ic(0)}, {_ic(1)}, {_ic(2)} FROM q1 GROUP BY t_idx)"
_WEIGHTED = (
    _ICS + ", q3 AS (SELECT avg(ic_0) AS a, avg(ic_1) AS b, avg(ic_2) AS c FROM q2), q4 AS (SELECT a / (abs(a) + abs(b) + abs(c)) AS a, b / (abs(a) + abs(b) + abs(c)) AS b, c / (abs(a) + abs(b) + abs(c)) AS c FROM q3)"
    " SELECT t_idx, symbol, round(CASE WHEN coalesce(x0, x1, x2) IS NOT NULL THEN a * coalesce(x0, 0) + b * coalesce(x1, 0) + c * coalesce(x2, 0) END + 3e-8, 6) + 0.0 AS value FROM q1 CROSS JOIN q4"
)


_COMPLETE = "x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL"


def _minor(a: str, b: str, c: str, d: str) -> str:
    return f"({a} * {d} - {b} * {c})"


def _det(m: list[list[str]]) -> str:
    """Determinant of a 3 x 3 matrix of column names."""
    (a, b, c), x, y = m
    return f"({a} * {_minor(x[1], x[2], y[1], y[2])} - {b} * {_minor(x[0], x[2], y[0], y[2])} + {c} * {_minor(x[0], x[1], y[0], y[1])})"


def _solved(m: list[list[str]], right: list[str]) -> list[str]:
    """Cramer's rule."""
    whole = _det(m)
    return [f"{_det([[right[r] if c == k else m[r][c] for c in range(3)] for r in range(3)])} / {whole}" for k in range(3)]


def _model_sql(alpha: float) -> str:
    """Linear models of three ranks, refitted every 20 dates from date 24 on, by their normal equations."""
    g = [[f"g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = ", ".join([f"sum(x{i}) AS s{i}, sum(x{i} * y0) AS b{i}" for i in range(3)] + [f"sum(x{i} * x{j}) AS a{i}{j}" for i, j in pairs])
    gram = ", ".join([f"a{i}{j} - s{i} * s{j} / n{f' + {alpha}' if i == j else ''} AS g{i}{j}" for i, j in pairs] + [f"b{i} - s{i} * sy / n AS r{i}" for i in range(3)])
    weights = ", ".join(f"{w} AS w{k}" for k, w in enumerate(_solved(g, ["r0", "r1", "r2"])))
    return (
        _RANKS.replace(" AS y FROM q0)", " AS y, y0 FROM q0)")
        + f", m0 AS (SELECT DISTINCT 24 + 20 * ((t_idx - 24) // 20) AS e FROM q1 WHERE t_idx >= 24), m1 AS (SELECT e, CAST(count(*) AS DOUBLE) AS n, sum(y0) AS sy, {sums} FROM m0 JOIN q1 ON t_idx < e WHERE {_COMPLETE} AND y0 IS NOT NULL GROUP BY e),"
        f" m2 AS (SELECT e, n, sy, s0, s1, s2, {gram} FROM m1), m3 AS (SELECT *, {weights} FROM m2)"
        " SELECT t_idx, symbol, round((sy - w0 * s0 - w1 * s1 - w2 * s2) / n + w0 * x0 + w1 * x1 + w2 * x2, 6) + 0.0 AS value FROM q1 LEFT JOIN m3 ON t_idx >= 24 AND e = 24 + 20 * ((t_idx - 24) // 20)"
    )


def _min_variance_sql() -> str:
    """Of the least-variance weights of every subset of three ranks, the feasible ones of least variance."""
    c = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    found = [[f"{float(i == k)}" for i in range(3)] for k in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        w = f"(({c[j][j]} - {c[i][j]}) / ({c[i][i]} + {c[j][j]} - 2 * {c[i][j]}))"
        found.append([w if k == i else f"(1 - {w})" if k == j else "0.0" for k in range(3)])
    free = _solved(c, ["1", "1", "1"])
    total = f"({' + '.join(free)})"
    found.append([f"({w}) / {total}" for w in free])
    options = " UNION ALL ".join(f"SELECT {', '.join(f'{w} AS w{k}' for k, w in enumerate(ws))}, * FROM v0" for ws in found)
    covariances = ", ".join(f"covar_samp(x{i}, x{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))
    variance = " + ".join(f"w{i} * w{j} * {c[i][j]}" for i in range(3) for j in range(3))
    return (
        _RANKS + f", v0 AS (SELECT {covariances} FROM q1 WHERE {_COMPLETE}), v1 AS ({options}), v2 AS (SELECT * FROM v1 WHERE least(w0, w1, w2) >= 0 ORDER BY {variance} LIMIT 1)"
        " SELECT t_idx, symbol, round(CASE WHEN coalesce(x0, x1, x2) IS NOT NULL THEN w0 * coalesce(x0, 0) + w1 * coalesce(x1, 0) + w2 * coalesce(x2, 0) END + 3e-8, 6) + 0.0 AS value FROM q1 CROSS JOIN v2"
    )


def ic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(StatisticalCombiner("ic_weighted").ic_matrix(supplier_panel(spark, sf_dir), FACTORS, LABEL), "t_idx")


def _model(kind: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = supplier_panel(spark, sf_dir)
        model = MLCombiner(kind, min_train_periods=24, refit_freq=20, **options).fit(panel, FACTORS, LABEL)
        return _rounded(model.predict(panel).select("t_idx", "symbol", "value"), "t_idx", "symbol")

    return run


DAYS, TOPS, DECAYS = (3, 6), (5, 10), (0, 3)


def tuner_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked metrics of all combinations; returns of monthly bars compound to huge years, hence the logarithms."""

    def factor(close, volume, high, low, days: int):
        return _round(ops.Ts_Delta(close, days), 6)

    tuner = ParameterTuner(factor, supplier_panel(spark, sf_dir), {"days": list(DAYS)}, {"top_n": list(TOPS), "decay": list(DECAYS)}, n_jobs=4)
    tuner.run()
    found = tuner.results().withColumns({c: F.ln(1 + F.col(c)) for c in ("ann_return", "calmar")})
    return _rounded(found, "rank", "combo_id", "f_days", "b_decay", "b_top_n")


def _tuner_sql() -> str:
    parts = []
    for days in DAYS:
        for decay in DECAYS:
            for top in TOPS:
                own = engine_sql(decay=decay, ranked=False, days=days, freq=1, top=top) + METRICS_SQL
                parts.append(f"SELECT 'days={days}|decay={decay}|top_n={top}' AS combo_id, {days} AS f_days, {decay} AS b_decay, {top} AS b_top_n, * FROM ({own})")
    metrics = "ann_return, sharpe, calmar, max_drawdown, ic_mean, icir, ic_win_rate, avg_turnover, fitness"
    rows = " UNION ALL ".join(parts)
    return f"SELECT row_number() OVER (ORDER BY sharpe DESC) AS rank, combo_id, CAST(f_days AS BIGINT) AS f_days, CAST(b_decay AS BIGINT) AS b_decay, CAST(b_top_n AS BIGINT) AS b_top_n, ann_vol, {metrics} FROM ({rows})"


def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = supplier_panel(spark, sf_dir).df
    return performance.histogram(df, "volume", 20).select("bin", (F.round("low", 6) + F.lit(0.0)).alias("low"), "n")


def event_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(event_panel(spark, sf_dir).factor(ops.ZScore(col("volume"))).select("t_idx", "symbol", "value"), "t_idx", "symbol")


def weekly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(supplier_panel(spark, sf_dir, "week").factor(ops.Ts_Mean(CLOSE, 4)).select("t_idx", "symbol", "value"), "t_idx", "symbol")


def synthetic_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.backtest import VectorEngine

    panel = SyntheticMarket(n_stocks=40, n_days=120, n_industries=5).generate(spark)
    return VectorEngine(ops.Rank(-ops.Ts_Delta(CLOSE, 5)), panel, rebalance_freq=5, top_n=10).run().daily


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of values by day and type, merged into a repository table; the result is that table."""
    folder = fresh_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq[u]et")
    rows = rows.select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("report_date"), F.to_date("ts").alias("date"), F.struct("ts", "event_id").alias("arrived"), "value")
    repository = Repository(spark, folder, buckets=4)
    stream_into(rows.select("symbol", "date", "value", "arrived"), repository, "ohlcv_events", f"{folder}/checkpoint").awaitTermination()
    return repository.load("ohlcv_events").select("symbol", "date", (F.round("value", 6) + F.lit(0.0)).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "upsert_merge": upsert_merge, "upsert_fill": upsert_fill, "upsert_diff": upsert_diff, "validate_bars": validate_bars, "factor_asof": factor_asof,
    "load_hfq": _loaded("hfq"), "load_qfq": _loaded("qfq"), "load_raw": _loaded("raw"), "adjustment_stairs": adjustment_stairs, "factor_falls": factor_falls,
    "label_return": _label("return"), "label_log_return": _label("log_return"), "ic_matrix": ic_matrix,
    "fusion_equal": _combined("equal"), "fusion_ic_weighted": _combined("ic_weighted"), "fusion_min_variance": _combined("min_variance"),
    "fusion_linear": _model("linear"), "fusion_ridge": _model("ridge"), "fusion_random_forest": _model("random_forest", rf_n_estimators=10, rf_max_depth=4),
    "tuner_grid": tuner_grid, "return_histogram": return_histogram, "event_zscore": event_zscore, "weekly_mean": weekly_mean,
    "synthetic_backtest": synthetic_backtest, "stream_upsert": stream_upsert,
}
_LABEL = f"lead(close, 3) OVER {BY} / nullif(close, 0)"
ORACLES: dict[str, str] = {
    "upsert_merge": _OLD_NEW + " SELECT date, symbol, round(close, 6) AS close, volume FROM n UNION ALL SELECT date, symbol, round(close, 6) AS close, volume FROM o WHERE (date, symbol) NOT IN (SELECT date, symbol FROM n)",
    "upsert_fill": _OLD_NEW + " SELECT coalesce(n.date, o.date) AS date, coalesce(n.symbol, o.symbol) AS symbol, round(coalesce(n.close, o.close), 6) AS close, coalesce(n.volume, o.volume) AS volume FROM n FULL JOIN o ON n.date = o.date AND n.symbol = o.symbol",
    "upsert_diff": _OLD_NEW + """, x AS (SELECT coalesce(n.symbol, o.symbol) AS symbol, o.symbol IS NULL AS only_new, n.symbol IS NULL AS only_old, CASE WHEN o.symbol IS NOT NULL AND n.symbol IS NOT NULL AND (n.close IS NULL OR abs(n.close - o.close) > 1e-12 + 1e-9 * abs(o.close)) THEN 1 ELSE 0 END AS c
 FROM n FULL JOIN o ON n.date = o.date AND n.symbol = o.symbol)
SELECT symbol, CAST(sum(CASE WHEN only_new THEN 1 ELSE 0 END) AS BIGINT) AS new_rows, CAST(sum(CASE WHEN NOT only_new AND NOT only_old THEN 1 ELSE 0 END) AS BIGINT) AS overlap_rows, CAST(sum(CASE WHEN only_old THEN 1 ELSE 0 END) AS BIGINT) AS kept_rows, CAST(sum(c) AS BIGINT) AS updated_cells FROM x GROUP BY symbol""",
    "validate_bars": f"WITH {PANEL_SQL}, b AS (SELECT date, symbol, open, CASE WHEN symbol % 11 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN symbol % 13 = 0 THEN -volume ELSE volume END AS volume FROM bars) "
    + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(coalesce(sum(CASE WHEN {v} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM b" for k, v in _RULES.items()),
    "factor_asof": _FACTOR_SQL + " SELECT t_idx, symbol, round(hfq, 6) + 0.0 AS hfq_factor FROM k",
    "load_hfq": _loaded_sql("hfq"),
    "load_qfq": _loaded_sql("hfq / last_value(hfq) OVER (PARTITION BY symbol ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "load_raw": _loaded_sql("1.0"),
    "adjustment_stairs": _STAIRS,
    "factor_falls": f"WITH {PANEL_SQL}, v AS (SELECT symbol, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS s FROM bars) SELECT symbol, count(*) AS n FROM v WHERE s < -1e-8 GROUP BY symbol",
    "label_return": staged(f"{_LABEL} - 1 AS value"),
    "label_log_return": staged(f"{_LABEL} AS r", value="CASE WHEN r > 0 THEN ln(r) END"),
    "ic_matrix": _ICS + " SELECT t_idx, round(ic_0, 6) + 0.0 AS ic_0, round(ic_1, 6) + 0.0 AS ic_1, round(ic_2, 6) + 0.0 AS ic_2 FROM q2",
    "fusion_equal": _RANKS + " SELECT t_idx, symbol, round(CASE WHEN coalesce(x0, x1, x2) IS NOT NULL THEN (coalesce(x0, 0) + coalesce(x1, 0) + coalesce(x2, 0)) / 3 END + 3e-8, 6) + 0.0 AS value FROM q1",
    "fusion_ic_weighted": _WEIGHTED, "fusion_min_variance": _min_variance_sql(), "fusion_linear": _model_sql(0.0), "fusion_ridge": _model_sql(1.0), "tuner_grid": _tuner_sql(),
    "return_histogram": f"WITH {PANEL_SQL}, e AS (SELECT min(volume) AS lo, max(volume) AS hi FROM panel), b AS (SELECT CAST(least(19, floor((volume - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, lo, (hi - lo) / 20 AS w FROM panel CROSS JOIN e WHERE volume IS NOT NULL)"
    " SELECT bin, round(lo + bin * w, 6) + 0.0 AS low, count(*) AS n FROM b GROUP BY bin, lo, w",
    "event_zscore": """WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type AS symbol, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), c AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t_idx FROM (SELECT DISTINCT date FROM d)),
g AS (SELECT c.t_idx, s.symbol, d.v FROM c CROSS JOIN (SELECT DISTINCT symbol FROM d) s LEFT JOIN d ON d.date = c.date AND d.symbol = s.symbol)
SELECT t_idx, symbol, round(CASE WHEN stddev_samp(v) OVER w >= 1e-10 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w END, 6) + 0.0 AS value FROM g WINDOW w AS (PARTITION BY t_idx)""",
    "weekly_mean": staged(f"{roll('avg', 'close', 4)} AS value").replace("'month'", "'week'"),
    "stream_upsert": "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS value FROM events GROUP BY 1, 2",
}
