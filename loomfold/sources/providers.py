"""Market-data providers: the interface, and the work on what they return.

No network client is included; a provider is any object with the methods of
:class:`Provider`, backed by files or a service of the user's.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names of providers.
COLUMN_NAMES = {
    "日期": "date", "时间": "date", "Date": "date",
    "开盘": "open", "开盘价": "open", "Open": "open",
    "最高": "high", "最高价": "high", "High": "high",
    "最低": "low", "最低价": "low", "Low": "low",
    "收盘": "close", "收盘价": "close", "Close": "close",
    "成交量": "volume", "Volume": "volume",
    "成交额": "turnover", "Turnover": "turnover",
}
#: Line items of statements, the preferred one first.
STATEMENT_ITEMS = {
    "revenue": ("营业收入",), "cost": ("营业成本",), "net_profit": ("归属于母公司所有者的净利润", "净利润"),
    "total_assets": ("资产总计",), "total_equity": ("股东权益合计", "所有者权益(或股东权益)合计"), "operating_cash_flow": ("经营活动产生的现金流量净额",),
}
UNIT = 1e8
REPORT_DATE = "报告日"


class Provider(Protocol):
    def get_stock_list(self) -> DataFrame: ...
    def get_kline_data(self, symbols: list[str], start: str, end: str) -> DataFrame: ...
    def get_market_value_data(self, symbols: list[str], start: str, end: str) -> DataFrame: ...
    def get_financial_indicators(self, symbols: list[str]) -> DataFrame: ...
    def get_adjustment_factors(self, symbols: list[str], start: str, end: str) -> DataFrame: ...


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in COLUMN_NAMES.items() if k in df.columns})


def stock_list(shanghai: DataFrame, shenzhen: DataFrame) -> DataFrame:
    """(symbol, name, exchange) of both exchanges' (symbol, name); of Shenzhen's only codes that begin with 0 or 3."""
    sz = shenzhen.where(F.col("symbol").startswith("0") | F.col("symbol").startswith("3"))
    return shanghai.select("symbol", "name", F.lit("SH").alias("exchange")).unionByName(sz.select("symbol", "name", F.lit("SZ").alias("exchange")))


def vendor_symbol(symbol: Column) -> Column:
    """Kept if it has a dot, else with the suffix of its exchange."""
    shenzhen = symbol.startswith("0") | symbol.startswith("3")
    return F.when(symbol.contains("."), symbol).when(shenzhen, F.concat(symbol, F.lit(".SZ"))).otherwise(F.concat(symbol, F.lit(".SS")))


def is_trading_day(dates: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """``dates`` with is_trading: in the calendar, or Monday to Friday without one."""
    if calendar is None:
        return dates.withColumn("is_trading", F.dayofweek("date").between(2, 6))
    days = calendar.select("date").distinct().withColumn("_t", F.lit(True))
    return dates.join(days, "date", "left").withColumn("is_trading", F.coalesce("_t", F.lit(False))).drop("_t")


def select_mode(end: Any, today: Any, today_is_trading: bool | None) -> str:
    """'update' for an end of today or later on a trading day (or without a calendar), else 'download'."""
    return "update" if end >= today and today_is_trading is not False else "download"


def clean_kline(df: DataFrame, start: Any, end: Any) -> DataFrame:
    """symbol, date and numeric bars of a provider's table, in an inclusive range."""
    if start > end:
        raise ValueError("start is after end")
    df = standardize_columns(df)
    fields = ("open", "high", "low", "close", "volume")
    if missing := [c for c in ("date", *fields) if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    df = df.select("symbol", F.to_date("date").alias("date"), *(F.col(c).cast("string").try_cast("double").alias(c) for c in fields))
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def market_values(bars: DataFrame, shares: DataFrame, snapshot: DataFrame | None = None, now: datetime | None = None, end: Any = None, trading: bool = True) -> DataFrame:
    """Caps in units of 1e8 from close and (symbol, total_shares, circulating_shares).

    A snapshot (symbol, total_market_cap, circulating_market_cap) replaces
    today's row only if the range ends today, on a trading day, from 15 o'clock
    on, and it is plausible.
    """
    out = bars.join(shares, "symbol").select(
        "symbol", "date", (F.col("close") * F.col("total_shares") / UNIT).alias("total_market_cap"), (F.col("close") * F.col("circulating_shares") / UNIT).alias("circulating_market_cap")
    )
    if snapshot is not None and now is not None and trading and now.hour >= 15 and str(end) == str(now.date()):
        good = snapshot.where((F.col("total_market_cap") > 0) & (F.col("circulating_market_cap") <= F.col("total_market_cap") * 1.001))
        new = good.select("symbol", F.lit(str(now.date())).cast("date").alias("date"), "total_market_cap", "circulating_market_cap")
        out = out.join(new.select("symbol", "date"), ["symbol", "date"], "left_anti").unionByName(new)
    return out


def latest_caps(info: DataFrame, spot: DataFrame, today: Any) -> DataFrame:
    """Today's caps in units of 1e8 by symbol from (symbol, item, value) pairs, else from a spot table (symbol, total, circulating)."""
    items = {"总市值": "total_market_cap", "流通市值": "circulating_market_cap"}  # fixed values: names of items
    own = info.groupBy("symbol").pivot("item", list(items)).agg(F.max(F.col("value").cast("string").try_cast("double"))).withColumnsRenamed(items)
    both = own.alias("o").join(spot.alias("s"), "symbol", "full_outer")
    caps = {"total_market_cap": "total", "circulating_market_cap": "circulating"}
    return both.select("symbol", F.lit(str(today)).cast("date").alias("date"), *((F.coalesce(f"o.{k}", f"s.{v}") / UNIT).alias(k) for k, v in caps.items()))


def financial_indicators(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """Indicators by symbol and report date, amounts in units of 1e8, ratios in per cent.

    Of rows repeated for a report date the one that is greatest, item by item, stays.
    """

    def items(df: DataFrame, *names: str) -> DataFrame:
        found = {n: [F.col(f"`{c}`").cast("string").try_cast("double") for c in STATEMENT_ITEMS[n] if c in df.columns] for n in names}
        date = F.try_to_date(F.col(REPORT_DATE).cast("string"), "yyyyMMdd").alias("report_date")
        cols = [(F.coalesce(*v) if v else F.lit(None).cast("double")).alias(n) for n, v in found.items()]
        rows = df.select("symbol", date, *cols).where("report_date is not null")
        return rows.groupBy("symbol", "report_date").agg(F.max(F.struct(*names)).alias("own")).select("symbol", "report_date", *(F.col(f"own.{n}") for n in names))

    x = items(income, "revenue", "cost", "net_profit").join(items(balance, "total_assets", "total_equity"), ["symbol", "report_date"], "left")
    x = x.join(items(cashflow, "operating_cash_flow"), ["symbol", "report_date"], "left")
    equity, revenue = F.nullif(F.col("total_equity"), F.lit(0.0)), F.nullif(F.col("revenue"), F.lit(0.0))
    return x.select(
        "symbol", "report_date", *((F.col(c) / UNIT).alias(c) for c in ("revenue", "net_profit", "total_assets", "total_equity", "operating_cash_flow")),
        (F.try_divide("net_profit", equity) * 100).alias("roe"), (F.try_divide(F.col("revenue") - F.col("cost"), revenue) * 100).alias("gross_profit_margin"),
    )


def adjustment_factors(raw: DataFrame, qfq: DataFrame, hfq: DataFrame, ex_days: DataFrame | None = None) -> DataFrame:
    """(symbol, date, qfq_factor, hfq_factor) from three (symbol, date, close).

    With ex-right days (symbol, date), factors move on those days only, by the
    day's change of the ratio, from the ratio on the first day; without, they
    are the ratios themselves.
    """
    keys = ["symbol", "date"]
    m = raw.where("close > 0").select(*keys, F.col("close").alias("c0"))
    for name, df in (("cq", qfq), ("ch", hfq)):
        m = m.join(df.where("close > 0").select(*keys, F.col("close").alias(name)), keys)
    m = m.select(*keys, (F.col("cq") / F.col("c0")).alias("rq"), (F.col("ch") / F.col("c0")).alias("rh"))
    if ex_days is None:
        return m.select(*keys, F.col("rq").alias("qfq_factor"), F.col("rh").alias("hfq_factor"))
    m = m.join(ex_days.select(*keys).distinct().withColumn("_x", F.lit(True)), keys, "left")
    w = Window.partitionBy("symbol").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def stairs(r: str) -> Column:
        return F.product(f"_{r}").over(upto) * F.first(r).over(upto)

    m = m.withColumns({f"_{r}": F.when(F.col("_x"), F.coalesce(F.try_divide(F.col(r), F.lag(r).over(w)), F.lit(1.0))).otherwise(1.0) for r in ("rq", "rh")})
    return m.select(*keys, stairs("rq").alias("qfq_factor"), stairs("rh").alias("hfq_factor"))


def complete_dataset(bars: DataFrame, values: DataFrame) -> DataFrame:
    """Bars with market values where there are any."""
    return bars.join(values, ["symbol", "date"], "left")


#: Columns of the tables of a bundle, for those that could not be fetched.
BUNDLE = {
    "ohlcv": "symbol string, date date, open double, high double, low double, close double, volume double", "adjustment": "symbol string, date date, qfq_factor double, hfq_factor double",
    "market_value": "symbol string, date date, total_market_cap double, circulating_market_cap double, pe double",
    "financial": "symbol string, report_date date, revenue double, net_profit double, total_assets double, total_equity double, operating_cash_flow double, roe double, gross_profit_margin double",
}


def complete_bundle(spark: SparkSession, fetch: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The four tables of BUNDLE and aligned_daily, the bars with market values where there are any; and what failed.

    A fetch that fails or is not given leaves an empty table.
    """
    tables, errors = {}, {}
    for kind, schema in BUNDLE.items():
        try:
            found = fetch[kind]() if kind in fetch else None
        except Exception as e:  # a vendor's failure is that table's only
            found, errors[kind] = None, str(e)[:500]
        tables[kind] = spark.createDataFrame([], schema) if found is None else found
    return tables | {"aligned_daily": complete_dataset(tables["ohlcv"], tables["market_value"])}, errors


def fundamentals(pairs: DataFrame, items: list[str]) -> DataFrame:
    """One row for each symbol from (symbol, item, value)."""
    return pairs.groupBy("symbol").pivot("item", items).agg(F.first("value"))


def index_constituents(df: DataFrame, column: str) -> DataFrame:
    """Distinct symbols, digits only."""
    return df.select(F.regexp_replace(F.col(column).cast("string"), r"\D", "").alias("symbol")).where("symbol != ''").distinct()
