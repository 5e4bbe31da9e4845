"""Synthetic daily panels, generated in executors from seeds by symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.panel import Panel


@dataclass(frozen=True)
class SyntheticMarket:
    """Geometric Brownian prices with a shared industry part.

    Draws are a hash of (seed, purpose, symbol, date), so the panel is the same
    on any partitioning; it is not that of any other generator.
    """

    n_stocks: int = 100
    n_days: int = 504
    n_industries: int = 10
    start: str = "2022-01-01"
    seed: int = 42
    mu: float = 0.08
    sigma: float = 0.30
    suspended_ratio: float = 0.04
    limit_pct: float = 0.099

    def __post_init__(self) -> None:
        if self.n_stocks < 2 * self.n_industries:
            raise ValueError("n_stocks must be at least twice n_industries")

    def _uniform(self, purpose: str, *keys: str) -> Column:
        h = F.xxhash64(F.lit(self.seed), F.lit(purpose), *map(F.col, keys))
        return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def _normal(self, purpose: str, *keys: str) -> Column:
        return F.sqrt(-2 * F.ln(self._uniform(purpose + "r", *keys))) * F.cos(6.283185307179586 * self._uniform(purpose + "a", *keys))

    def facts(self, spark: SparkSession) -> DataFrame:
        """(date, t_idx, symbol, symbol_pos, bars, industry, flags) on business days."""
        weeks = self.n_days // 5 + 2
        days = spark.range(7 * weeks).select(F.date_add(F.lit(self.start).cast("date"), F.col("id").cast("int")).alias("date")).where(F.dayofweek("date").between(2, 6))
        days = days.withColumn("t_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("int")).where(F.col("t_idx") < self.n_days)
        stocks = spark.range(self.n_stocks).select(F.col("id").cast("int").alias("symbol_pos"))
        own = F.floor(self._uniform("industry", "symbol_pos") * self.n_industries)
        stocks = stocks.withColumn("industry", F.concat(F.lit("I"), F.when(F.col("symbol_pos") < 2 * self.n_industries, F.col("symbol_pos") % self.n_industries).otherwise(own).cast("string")))
        stocks = stocks.withColumns({
            "symbol": F.lpad((F.col("symbol_pos") + 1).cast("string"), 6, "0"), "m": self.mu + 0.08 * (self._uniform("mu", "symbol_pos") - 0.5),
            "s": F.least(F.lit(0.6), F.greatest(F.lit(0.1), self.sigma + 0.2 * (self._uniform("sigma", "symbol_pos") - 0.5))),
            "p0": 10 + 90 * self._uniform("start", "symbol_pos"), "v0": 5e3 + 4.5e4 * self._uniform("volume", "symbol_pos"),
            "gap": (self._uniform("suspended", "symbol_pos") < self.suspended_ratio) | (F.col("symbol_pos") == 0),
            "gap_at": (self._uniform("gap", "symbol_pos") * max(1, self.n_days - 20)).cast("int"), "gap_n": (5 + 16 * self._uniform("length", "symbol_pos")).cast("int"),
        })
        df = stocks.crossJoin(F.broadcast(days))
        noise = 0.7071067811865476 * (self._normal("market", "industry", "t_idx") + self._normal("own", "symbol_pos", "t_idx"))
        step = (F.col("m") - F.col("s") * F.col("s") / 2) / 252 + F.col("s") / 252**0.5 * noise
        w = Window.partitionBy("symbol").orderBy("t_idx")
        df = df.withColumn("_l", step).withColumn("close", F.col("p0") * F.exp(F.sum("_l").over(w)))
        before = F.lag("close").over(w)
        u = lambda name: self._uniform(name, "symbol_pos", "t_idx")
        first = F.col("t_idx") == 0
        df = df.withColumn("open", F.when(first, F.col("close") * (1 + 0.02 * (u("open") - 0.5))).otherwise(before * (1 + 0.01 * (u("open") - 0.5)))).withColumn("_p", F.when(first, 0.0).otherwise(F.col("close") / before - 1))
        df = df.withColumn("high", F.greatest("open", "close") * (1.001 + 0.024 * u("high"))).withColumn("low", F.least("open", "close") * (1 - (0.001 + 0.024 * u("low"))))
        typical = F.avg(F.abs("_p")).over(Window.partitionBy("symbol"))
        df = df.withColumn("volume", F.col("v0") * (1 + 2 * F.abs("_p") / typical) * F.exp(0.3 * self._normal("v", "symbol_pos", "t_idx")))
        df = df.withColumn("is_suspended", F.col("gap") & (F.col("t_idx") >= F.col("gap_at")) & (F.col("t_idx") < F.col("gap_at") + F.col("gap_n"))).withColumn("is_limit", F.abs("_p") >= self.limit_pct)
        fields = {c: F.when(~F.col("is_suspended"), F.col(c)) for c in ("open", "high", "low", "close", "volume")}
        df = df.withColumns(fields).withColumn("is_limit", F.col("is_limit") & ~F.col("is_suspended"))
        return df.select("date", "t_idx", "symbol", "symbol_pos", *fields, "industry", "is_suspended", "is_limit")

    def generate(self, spark: SparkSession) -> Panel:
        df = self.facts(spark).withColumn("industry_known", F.lit(True)).withColumn("n_industries", F.lit(self.n_industries))
        return Panel(df, df.select("symbol", "industry").distinct())
