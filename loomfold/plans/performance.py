"""Performance metrics as aggregates over small daily tables and over panels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ops
from ..operators.crosssection import place
from .expr import EPS, col as _col, compile_exprs

YEAR = 252
METRICS = (
    "ann_return", "ann_vol", "sharpe", "calmar", "max_drawdown", "ic_mean", "ic_std", "icir", "ic_win_rate", "ic_t",
    "avg_turnover", "ann_cost", "fitness",
)


def _centred(x: Column, *by: str) -> Column:
    """Percentile rank among the non-null values of a group, less the mean rank; exactly 0 where all tie."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), F.try_divide(place(x, Window.partitionBy(*by)), n) - F.try_divide((n + 1) / 2, n))


def ic_rows(panel: DataFrame, factors: list[str], returns: str) -> DataFrame:
    """(t_idx, i, ic): rank correlation of each factor, by its place in the list, with the returns by date.

    Each side is ranked and centred on its own non-null names; the numerator
    sums over names that have both, each denominator over its own names. A factor's
    values of a date are a group of narrow rows, so no task sorts a date for many factors.
    """
    day = Window.partitionBy("t_idx")
    rows = panel.select("t_idx", _centred(F.col(returns), "t_idx").alias("_y"), F.array(*(F.col(f).cast("double") for f in factors)).alias("_all"))
    rows = rows.withColumn("_yy", F.sum(F.col("_y") ** 2).over(day)).select("t_idx", "_y", "_yy", F.posexplode("_all").alias("i", "_x"))
    rows = rows.repartition("t_idx", "i") if len(factors) > 1 else rows
    rows = rows.withColumn("_x", _centred(F.col("_x"), "t_idx", "i"))
    sums = rows.groupBy("t_idx", "i").agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)).alias("xy"), F.sum(F.col("_x") ** 2).alias("xx"), F.max("_yy").alias("yy"))
    return sums.select("t_idx", "i", F.try_divide("xy", F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("ic"))


def ic_series(panel: DataFrame, factor: str, returns: str) -> DataFrame:
    """(t_idx, ic) of one factor, see :func:`ic_rows`."""
    return ic_rows(panel, [factor], returns).select("t_idx", "ic")


def forward_ic(panel: DataFrame, factor: str, price: str, horizon: int, least_names: int = 10) -> DataFrame:
    """(t_idx, ic) of the factor and the ``horizon``-row forward return, ranked among names that have both, with more than ``least_names``."""
    x = compile_exprs(panel, {"_y": ops.Ts_Delay(_col(price), -horizon) / _col(price) - 1})
    both = x.where(F.col(factor).isNotNull() & F.col("_y").isNotNull()).select("t_idx", "symbol", F.col(factor).alias("f"), "_y")
    ranked = compile_exprs(both, {"rf": ops.Rank(_col("f")), "rr": ops.Rank(_col("_y"))})
    varied = (F.max("rf") > F.min("rf")) & (F.max("rr") > F.min("rr"))
    r = F.when((F.count("*") > least_names) & varied, F.try_divide(F.covar_samp("rf", "rr"), F.stddev_samp("rf") * F.stddev_samp("rr")))
    return ranked.groupBy("t_idx").agg(r.alias("ic"))


def forward_ic_stats(ic: DataFrame) -> DataFrame:
    """ic_mean, icir (not annualised, population deviation plus 1e-10) and ic_win of an ic table."""
    return ic.where("ic is not null").agg(
        F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic"), F.stddev_pop("ic") + EPS).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_win")
    )


def rolling_ic(daily: DataFrame, window: int = 20) -> DataFrame:
    """Rolling mean and cumulative sum of a daily table's ic."""
    w = Window.orderBy("t_idx")
    mean = F.when(F.count("ic").over(w.rowsBetween(1 - window, 0)) >= window, F.avg("ic").over(w.rowsBetween(1 - window, 0)))
    total = F.when(F.col("ic").isNotNull(), F.sum("ic").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return daily.select("t_idx", "ic", mean.alias("rolling_ic"), total.alias("cumulative_ic"))


def drawdown(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(t_idx, nav, drawdown) of a daily table, or of each of the tables named by ``by``."""
    top = F.max("nav").over(Window.partitionBy(*by).orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(*by, "t_idx", "nav", F.try_divide(F.col("nav") - top, top).alias("drawdown"))


def summary(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of all metrics from (t_idx, nav, net_return, cost, turnover, ic), or one for each of the tables named by ``by``."""
    top = F.max("nav").over(Window.partitionBy(*by).orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0))
    x = daily.withColumn("drawdown", F.try_divide(F.col("nav") - top, top))
    n = F.col("n")
    base = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.max_by("nav", "t_idx").alias("last"), F.min_by("nav", "t_idx").alias("first"), F.avg("net_return").alias("mean"), F.stddev_samp("net_return").alias("sd"),
        F.min("drawdown").alias("dd"), F.avg("turnover").alias("avg_turnover"), F.avg("cost").alias("mean_cost"),
        F.count("ic").alias("n_ic"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), 
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("ic_win_rate"),
    )

    def unless(bad: Column, value: Column) -> Column:
        return F.when(bad, F.lit(0.0)).otherwise(value)

    ratio = F.try_divide("last", "first")
    base = base.withColumn("ann_return", unless(n < 2, F.when(ratio <= 0, F.lit(-1.0)).otherwise(F.pow(ratio, F.lit(float(YEAR)) / n) - 1)))
    base = base.withColumn("ann_vol", unless(n < 2, F.col("sd") * math.sqrt(YEAR)))
    base = base.withColumn("sharpe", unless((n < 2) | (F.coalesce("sd", F.lit(0.0)) < EPS), F.try_divide("mean", "sd") * math.sqrt(YEAR)))
    base = base.withColumn("max_drawdown", unless(n < 2, F.col("dd")))
    base = base.withColumn("calmar", unless(F.abs("max_drawdown") < EPS, F.try_divide("ann_return", F.abs("max_drawdown"))))
    flat = F.coalesce("ic_sd", F.lit(0.0)) <= EPS
    known = F.col("n_ic") > 0
    base = base.withColumn("icir", F.when(known, unless(flat, F.try_divide("ic_mean", "ic_sd") * math.sqrt(YEAR))))
    base = base.withColumn("ic_t", F.when(known, unless(flat, F.try_divide(F.col("ic_mean") * F.sqrt("n_ic"), F.col("ic_sd")))))
    base = base.withColumn("ic_std", F.when(known, F.col("ic_sd"))).withColumn("ann_cost", F.col("mean_cost") * YEAR)
    idle = (F.abs("ann_return") < EPS) | (F.coalesce("avg_turnover", F.lit(0.0)) < EPS)
    base = base.withColumn("fitness", unless(idle, F.col("sharpe") * F.sqrt(F.try_divide(F.abs("ann_return"), F.col("avg_turnover")))))
    return base.select(*by, *METRICS)


def mean_factor_correlation(panel: DataFrame, a: str, b: str, least_names: int = 5) -> DataFrame:
    """Mean over dates of the cross-sectional correlation of two columns, on dates with more than ``least_names`` common names."""
    both = panel.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    varied = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    daily = both.groupBy("t_idx").agg(F.when((F.count("*") > least_names) & varied, F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))).alias("r"))
    return daily.agg(F.avg("r").alias("correlation"))


def universe_statistics(panel: DataFrame, price: str = "close") -> DataFrame:
    """symbol, industry, cumulative return and annual volatility."""
    x = compile_exprs(panel, {"_r": _col(price) / ops.Ts_Delay(_col(price), 1) - 1})
    return x.groupBy("symbol", "industry").agg((F.product(1 + F.col("_r")) - 1).alias("cum_return"), (F.stddev_samp("_r") * math.sqrt(YEAR)).alias("ann_vol"))


def monthly_returns(daily: DataFrame) -> DataFrame:
    """(year, month, ret) of a daily table; months without dates inside the range return 0."""
    months = daily.groupBy(F.trunc("date", "month").alias("m")).agg((F.product(1 + F.col("net_return")) - 1).alias("ret"))
    spine = daily.agg(F.explode(F.expr("sequence(trunc(min(date), 'month'), trunc(max(date), 'month'), interval 1 month)")).alias("m"))
    return spine.join(months, "m", "left").select(F.year("m").alias("year"), F.month("m").alias("month"), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_pivot(daily: DataFrame) -> DataFrame:
    """Years by months 1 to 12."""
    return monthly_returns(daily).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, n): equal-width counts; the last bin holds the maximum."""
    x = df.where(F.col(column).isNotNull())
    ends = x.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("lo"), width)), F.lit(0))).cast("int")
    return x.crossJoin(F.broadcast(ends)).withColumn("bin", place).groupBy("bin").agg((F.first("lo") + F.col("bin") * F.first(width)).alias("low"), F.count("*").alias("n"))
