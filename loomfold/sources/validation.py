"""Validation rules as counts, and the incremental upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "date")
REQUIRED = {
    "ohlcv": ("open", "high", "low", "close", "volume"), "adjustment": ("qfq_factor", "hfq_factor"),
    "market_value": (), "financial": (), "industry": ("symbol", "sw1_name", "sw2_name", "sw3_name"),
}


def _count(rule: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(rule, F.lit(False)).cast("long")), F.lit(0))


def rules(data_type: str, columns: Sequence[str]) -> dict[str, Column]:
    """Rule name to the condition that a bad row meets; comparisons with null are not met."""
    c = F.col
    if data_type == "ohlcv":
        out = {f"null_{x}": c(x).isNull() for x in ("open", "high", "low", "close")}
        out |= {f"{a}_below_{b}": c(a) < c(b) for a, b in (("high", "low"), ("high", "open"), ("high", "close"), ("open", "low"), ("close", "low"))}
        return out | {f"negative_{x}": c(x) < 0 for x in ("open", "high", "low", "close", "volume")}
    if data_type == "adjustment":
        return {f"negative_{x}": c(x) < 0 for x in ("qfq_factor", "hfq_factor")}
    if data_type == "market_value":
        own = {f"negative_{x}": c(x) < 0 for x in ("total_market_cap", "circulating_market_cap") if x in columns}
        if {"total_market_cap", "circulating_market_cap"} <= set(columns):
            own["circulating_above_total"] = c("circulating_market_cap") > c("total_market_cap")
        return own
    return {}


def validate(df: DataFrame, data_type: str) -> DataFrame:
    """(symbol, rule, n): how many rows break each rule; duplicates by date are rule ``duplicate``."""
    missing = [x for x in REQUIRED[data_type] if x not in df.columns]
    if missing:
        raise ValueError(f"{data_type}: missing columns {missing}")
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wrong = [x for x, t in df.dtypes if x in REQUIRED[data_type] and data_type != "industry" and t not in numeric and not t.startswith("decimal")]
    if wrong:
        raise ValueError(f"{data_type}: not numeric: {wrong}")
    found = rules(data_type, df.columns)
    keyed = df.groupBy("symbol", "date").agg(F.count("*").alias("_n"), *(_count(r).alias(k) for k, r in found.items()))
    per = keyed.groupBy("symbol").agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("duplicate"), *(F.sum(k).alias(k) for k in found))
    names = ["duplicate", *found]
    return per.select("symbol", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("rule", "n"))


def check_duplicates(df: DataFrame) -> DataFrame:
    """All rows whose (symbol, date) occurs more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).where("_n > 1").drop("_n")


def merge(new: DataFrame, old: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Old rows whose key is only in old, and all new rows, which replace old ones whole."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_fill(new: DataFrame, old: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer join that takes each new value that isn't null, else the old one."""
    fields = list(dict.fromkeys([c for c in [*old.columns, *new.columns] if c not in keys]))
    n, o = new.alias("n"), old.alias("o")
    joined = n.join(o, list(keys), "full_outer")

    def pick(c: str) -> Column:
        sides = [F.col(f"{a}.{c}") for a, t in (("n", new), ("o", old)) if c in t.columns]
        return F.coalesce(*sides).alias(c)

    return joined.select(*keys, *map(pick, fields))


def close_to(new: Column, old: Column) -> Column:
    """Equal within 1e-12 plus 1e-9 of the old value, or both null."""
    near = F.abs(new - old) <= 1e-12 + 1e-9 * F.abs(old)
    return F.coalesce(near, F.lit(False)) | (new.isNull() & old.isNull())


def diff_summary(new: DataFrame, old: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """By symbol: rows only in new, in both, only in old, changed cells, up to 20 changed dates, and whether columns agree."""
    common = [c for c in old.columns if c in new.columns and c not in keys]
    numeric = {c for c, t in new.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    n = new.select(*keys, F.lit(True).alias("_n"), *(F.col(c).alias(f"n_{c}") for c in common)).alias("n")
    o = old.select(*keys, F.lit(True).alias("_o"), *(F.col(c).alias(f"o_{c}") for c in common)).alias("o")
    joined = n.join(o, list(keys), "full_outer")
    both = F.col("_n").isNotNull() & F.col("_o").isNotNull()
    changed = F.lit(0)
    for c in common:
        a, b = F.col(f"n_{c}"), F.col(f"o_{c}")
        same = close_to(a, b) if c in numeric else a.eqNullSafe(b)
        changed = changed + (~same).cast("int")
    joined = joined.withColumn("_c", F.when(both, changed).otherwise(0))
    return joined.groupBy("symbol").agg(
        _count(F.col("_o").isNull()).alias("new_rows"), _count(both).alias("overlap_rows"), _count(F.col("_n").isNull()).alias("kept_rows"), F.sum("_c").cast("long").alias("updated_cells"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("_c") > 0, F.col(keys[-1])))), 1, 20).alias("changed_dates"),
    ).withColumn("column_consistent", F.lit(set(new.columns) == set(old.columns)))


def missing_dates(new: DataFrame, old: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """(symbol, missing_dates): trading days strictly between old data's end and new data's start; none where they overlap.

    Without a calendar, Monday to Friday are trading days.
    """
    gap = old.groupBy("symbol").agg(F.max("date").alias("a")).join(new.groupBy("symbol").agg(F.min("date").alias("b")), "symbol")
    days = F.when(F.col("b") > F.date_add("a", 1), F.sequence(F.date_add("a", 1), F.date_sub("b", 1)))
    rows = gap.select("symbol", F.explode_outer(days).alias("date"))
    if calendar is None:
        kept = F.when(F.dayofweek("date").between(2, 6), F.col("date"))
    else:
        rows = rows.join(calendar.select(F.col("date").alias("_d")).distinct(), F.col("date") == F.col("_d"), "left")
        kept = F.when(F.col("_d").isNotNull(), F.col("date"))
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(kept)).alias("missing_dates"))


def hfq_violations(df: DataFrame) -> DataFrame:
    """(symbol, date) where the factor falls by more than 1e-8."""
    step = F.col("hfq_factor") - F.lag("hfq_factor").over(Window.partitionBy("symbol").orderBy("date"))
    return df.withColumn("_s", step).where(F.col("_s") < -1e-8).select("symbol", "date")
