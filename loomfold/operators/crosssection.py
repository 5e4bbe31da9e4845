"""Operators over all symbols of a date."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.expr import EPS, TIME, Expr, across, xs


def place(a: Column, group: WindowSpec) -> Column:
    """Place from 1 among the non-null values, ties at the middle of theirs: one sort, as the last of the ties is counted in the same order as the first."""
    ordered = group.orderBy(a.asc_nulls_last())
    upto = F.count(a).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(ordered) + upto) / 2


def Rank(x: Expr) -> Expr:
    """Percentile rank with average ties among the non-null values."""

    def build(a: Column) -> Column:
        return F.when(a.isNotNull(), F.try_divide(place(a, across()), F.count(a).over(across())))

    return xs("rank", build, x)


def ZScore(x: Expr) -> Expr:
    """Null where the date's sample deviation is under 1e-10 or has under two values."""

    def build(a: Column) -> Column:
        sd = F.stddev_samp(a).over(across())
        return F.when(sd >= EPS, F.try_divide(a - F.avg(a).over(across()), sd))

    return xs("zscore", build, x)


def Scale(x: Expr, a: float = 1.0) -> Expr:
    """Scaled to a sum of absolute values of ``a``; null where that sum is under 1e-10."""

    def build(v: Column) -> Column:
        total = F.sum(F.abs(v)).over(across())
        return F.when(total >= EPS, F.try_divide(v * float(a), total))

    return xs(("scale", float(a)), build, x)


def Neutralize(x: Expr, industry: str | Expr = "industry", known: str | Expr = "industry_known", n_industries: str | Expr = "n_industries") -> Expr:
    """Residual of a regression on industry dummies: the value less its industry's mean.

    A date with fewer than n_industries + 1 values of mapped symbols passes
    unchanged. Symbols outside the map are null; a null industry has no dummy,
    so its residual is the value.
    """

    def build(a: Column, group: Column, mapped: Column, n: Column) -> Column:
        here = F.count(F.when(mapped, a)).over(across())
        rest = a - F.avg(a).over(Window.partitionBy(TIME, group))
        return F.when(mapped, F.when((here < n + 1) | group.isNull(), a).otherwise(rest))

    return xs("neutralize", build, x, industry, known, n_industries)
