"""From stored tables to an adjusted, flagged and filled panel."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.panel import Panel, broadcast_if_small, calendar_of, densify

PRICES = ("open", "high", "low", "close")
LIMIT = 0.099
INDUSTRY_COLUMNS = ("sw1_name", "industry", "行业", "industry_name", "sector")
UNKNOWN = "Unknown"


def _before() -> Any:
    return Window.partitionBy("symbol").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)


def _after() -> Any:
    return Window.partitionBy("symbol").orderBy("t_idx").rowsBetween(0, Window.unboundedFollowing)


@dataclass
class MarketData:
    panel: Panel
    adj_type: str
    missing_symbols: DataFrame

    def summary(self) -> DataFrame:
        """Dates, symbols, range, null, suspended and limited shares, and industries, in one row."""
        return self.panel.df.agg(
            F.countDistinct("t_idx").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
            F.avg(F.col("close").isNull().cast("double")).alias("null_share"), F.avg(F.col("is_suspended").cast("double")).alias("suspended_share"),
            F.avg(F.col("is_limit").cast("double")).alias("limit_share"), F.countDistinct("industry").alias("n_industries"),
        )


def align_factor(grid: DataFrame, factors: DataFrame | None) -> DataFrame:
    """``grid`` with hfq_factor: the last known value by calendar row, else the first to come, else 1."""
    if factors is None:
        return grid.withColumn("hfq_factor", F.lit(1.0))
    joined = grid.join(factors.select("symbol", "date", F.col("hfq_factor").alias("_h")), ["symbol", "date"], "left")
    filled = F.coalesce(F.last("_h", ignorenulls=True).over(_before()), F.first("_h", ignorenulls=True).over(_after()), F.lit(1.0))
    return joined.withColumn("hfq_factor", filled).drop("_h")


def adjust(df: DataFrame, adj_type: str = "hfq") -> DataFrame:
    """Prices times the factor (hfq), times its share of the range's last (qfq), or as they are (raw)."""
    if adj_type not in ("hfq", "qfq", "raw"):
        raise ValueError(f"adj_type must be hfq, qfq or raw, not {adj_type!r}")
    if adj_type == "raw":
        return df
    by = F.col("hfq_factor")
    if adj_type == "qfq":
        whole = Window.partitionBy("symbol").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        by = F.try_divide(by, F.last("hfq_factor", ignorenulls=True).over(whole))
    return df.withColumn("_by", by).withColumns({c: F.col(c) * F.col("_by") for c in (*PRICES, *(["vwap"] if "vwap" in df.columns else []))}).drop("_by")


def load(
    ohlcv: DataFrame, adjustment: DataFrame | None = None, industry: DataFrame | None = None, symbols: list[str] | None = None, start: Any = None, end: Any = None,
    adj_type: str = "hfq", fill_suspended: bool = True, min_trading_days: int = 20,
) -> MarketData:
    """The panel of all symbols in one plan, without a loop over them."""
    facts = ohlcv
    asked = None if symbols is None else ohlcv.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    facts = facts if asked is None else facts.join(broadcast_if_small(asked), "symbol", "left_semi")
    facts = facts if start is None else facts.where(F.col("date") >= F.lit(start).cast("date"))
    facts = facts if end is None else facts.where(F.col("date") <= F.lit(end).cast("date"))
    calendar = calendar_of(facts)
    if calendar.isEmpty():
        raise ValueError("no rows in the range")
    grid = align_factor(densify(facts, calendar=calendar), adjustment)
    grid = grid.withColumn("is_suspended", F.col("close").isNull() | F.coalesce(F.col("volume") == 0, F.lit(False)))
    grid = adjust(grid, adj_type)
    known = grid.groupBy("symbol").agg(F.count("close").alias("n"))
    kept = known.where(F.col("n") >= min_trading_days).select("symbol")
    missing = (known.select("symbol") if asked is None else asked).join(kept, "symbol", "left_anti")
    grid = grid.join(kept, "symbol", "left_semi")
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("t_idx"))
    move = F.abs(F.try_divide(F.col("close") - before, F.abs(before)))
    grid = grid.withColumn("is_limit", F.coalesce(move >= LIMIT, F.lit(False)))
    if fill_suspended:
        grid = grid.withColumns({c: F.last(c, ignorenulls=True).over(_before()) for c in PRICES})
    return MarketData(Panel(label_industry(grid, industry)), adj_type, missing)


def label_industry(df: DataFrame, industry: DataFrame | None) -> DataFrame:
    """``df`` with industry from the first known name column, else 'Unknown'."""
    if industry is None:
        return df.withColumn("industry", F.lit(UNKNOWN))
    named = next((c for c in INDUSTRY_COLUMNS if c in industry.columns), None)
    names = industry.select("symbol", (F.col(named) if named else F.lit(None).cast("string")).alias("industry")).dropDuplicates(["symbol"])
    return df.join(names, "symbol", "left").withColumn("industry", F.coalesce("industry", F.lit(UNKNOWN)))


def field_panel(table: DataFrame, fields: list[str], date: str = "date", symbols: list[str] | None = None) -> DataFrame:
    """Long panel of some fields of a fundamentals table on the union of its dates; no as-of join to trading days."""
    if missing := [c for c in fields if c not in table.columns]:
        raise ValueError(f"missing columns {missing}")
    rows = table.select(F.col(date).alias("date"), "symbol", *fields)
    rows = rows if symbols is None else rows.where(F.col("symbol").isin(symbols))
    return densify(rows)


def matrix(df: DataFrame, value: str) -> DataFrame:
    """Dates by symbols, for export; the only place where a panel becomes wide."""
    return df.groupBy("date").pivot("symbol").agg(F.first(value)).orderBy("date")
