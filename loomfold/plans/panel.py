"""Dense panels: one row for each date of the calendar and each symbol."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .expr import compile_exprs

#: Calendars are broadcast up to so many dates; longer ones are joined by shuffle.
BROADCAST_DATES = 200_000


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c).cast("double")) for c, t in df.dtypes if t in ("double", "float")})


def calendar_of(facts: DataFrame) -> DataFrame:
    """(date, t_idx): the distinct dates, numbered from 0. One row a trading date, so one task orders them."""
    dates = facts.select("date").where("date is not null").distinct()
    return dates.withColumn("t_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """With a broadcast hint up to BROADCAST_DATES rows, counted no further."""
    return F.broadcast(df) if df.limit(BROADCAST_DATES + 1).count() <= BROADCAST_DATES else df


def densify(facts: DataFrame, symbols: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Facts (date, symbol, fields…) on the full grid, with ``t_idx`` and ``symbol_pos``.

    The grid is the product of the calendar and the symbols, which is the panel's
    own size; the facts are joined to it by (date, symbol).
    """
    facts = without_nan(facts)
    calendar = calendar if calendar is not None else calendar_of(facts)
    symbols = symbols if symbols is not None else facts.select("symbol").where("symbol is not null").distinct()
    ranked = symbols.select("symbol").withColumn("symbol_pos", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("int"))
    grid = ranked.crossJoin(broadcast_if_small(calendar))
    fields = [c for c in facts.columns if c not in ("date", "symbol")]
    return grid.join(facts, ["date", "symbol"], "left").select("date", "t_idx", "symbol", "symbol_pos", *fields)


def intersected(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables (date, symbol, value) as columns of the grid of the dates and symbols that all of them have.

    A date or symbol counts for a table with any row, also one without a value. The
    tables meet in one aggregation by date and symbol; of repeated cells the largest value counts.
    """
    if not tables:
        raise ValueError("no tables given")
    rows = None
    for i, table in enumerate(tables.values()):
        own = without_nan(table.select("date", "symbol", F.col("value").cast("double").alias("value"))).withColumn("i", F.lit(i)).where("date is not null and symbol is not null")
        rows = own if rows is None else rows.unionByName(own)
    rows = written(rows, "tables")
    common = {c: broadcast_if_small(rows.groupBy(c).agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(tables)).select(c)) for c in ("date", "symbol")}
    inside = rows.join(common["date"], "date", "left_semi").join(common["symbol"], "symbol", "left_semi")
    cells = inside.groupBy("date", "symbol").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(tables)))
    return densify(cells)


@dataclass(frozen=True)
class Panel:
    """A dense long table and its symbols' industries (symbol, industry), if known."""

    df: DataFrame
    industry: DataFrame | None = None

    @classmethod
    def from_facts(cls, facts: DataFrame, industry: DataFrame | None = None) -> Panel:
        return cls(densify(facts), industry)

    def with_factors(self, **factors: Any) -> DataFrame:
        return compile_exprs(self.df, factors)

    def factor(self, expr: Any, name: str = "value") -> DataFrame:
        """(date, t_idx, symbol, symbol_pos, value)."""
        return compile_exprs(self.df, {name: expr}).select("date", "t_idx", "symbol", "symbol_pos", name)

    def between(self, start: Any = None, end: Any = None) -> Panel:
        """Rows of an inclusive date range, renumbered from 0."""
        df = self.df
        df = df if start is None else df.where(F.col("date") >= F.lit(start).cast("date"))
        df = df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))
        return Panel(df.drop("t_idx").join(broadcast_if_small(calendar_of(df)), "date"), self.industry)

    def universe(self, field: str, most_null: float) -> Panel:
        """Symbols with an industry whose share of nulls in ``field`` is at most ``most_null``."""
        good = self.df.groupBy("symbol").agg(F.avg(F.col(field).isNull().cast("double")).alias("s")).where(F.col("s") <= most_null).select("symbol")
        if self.industry is not None:
            good = good.intersect(self.industry.where("industry is not null").select("symbol"))
        return Panel(self.df.join(good, "symbol", "left_semi"), self.industry)
