"""Panels of bars from order lines and events, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.panel import Panel, densify

#: Share of a price's move from which a bar counts as limited.
LIMIT = 0.3
#: Added before rounding, so that prices midway between two steps round the same way everywhere.
NUDGE = 1e-6


def supplier_bars(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """(date, symbol, open, high, low, close, volume) of unit prices by supplier and month or week."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    rows = rows.select(F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("symbol"), p.alias("p"), F.col("l_quantity").alias("q"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    price = lambda c: F.round(c + NUDGE, 4)
    return rows.groupBy("date", "symbol").agg(
        price(F.min_by("p", "at")).alias("open"), price(F.max("p")).alias("high"), price(F.min("p")).alias("low"),
        price(F.avg("p")).alias("close"), F.round(F.sum("q"), 4).alias("volume"),
    )


def supplier_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, industry): each supplier's region; suppliers whose key is divisible by 17 are outside the map."""
    s, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return named.where(F.col("s_suppkey") % 17 != 0).select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("industry"))


def supplier_panel(spark: SparkSession, sf_dir: str, unit: str = "month") -> Panel:
    """The dense panel of supplier bars, with industries and state flags."""
    industry = supplier_industries(spark, sf_dir)
    df = with_industry(densify(supplier_bars(spark, sf_dir, unit)), industry)
    return Panel(with_flags(df), industry)


def with_industry(df: DataFrame, industry: DataFrame) -> DataFrame:
    """Columns industry, industry_known and n_industries (of the map's symbols in the panel)."""
    known = industry.select("symbol", "industry").withColumn("industry_known", F.lit(True)).dropDuplicates(["symbol"])
    n = known.join(df.select("symbol").distinct(), "symbol", "left_semi").agg(F.countDistinct("industry").cast("int").alias("n_industries"))
    joined = df.join(known, "symbol", "left").withColumn("industry_known", F.coalesce("industry_known", F.lit(False)))
    return joined.crossJoin(F.broadcast(n))  # one row


def with_flags(df: DataFrame, limit: float = LIMIT) -> DataFrame:
    """is_suspended: no close, or volume 0; is_limit: a move of ``limit`` or more."""
    from ..operators import ops
    from ..plans.expr import col, compile_exprs

    move = (ops.Ts_Delta(col("close"), 1) / ops.Ts_Delay(col("close"), 1).abs()).abs()
    df = compile_exprs(df, {"is_limit": (move >= limit).fillna(False)})
    return df.withColumn("is_suspended", F.col("close").isNull() | F.coalesce(F.col("volume") == 0, F.lit(False)))


def event_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Daily mean value and count by event type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("date"), F.col("event_type").alias("symbol"), "value")
    return Panel(densify(rows.groupBy("date", "symbol").agg(F.round(F.avg("value"), 4).alias("close"), F.count("*").cast("double").alias("volume"))))
