"""Statistics of panels and factors: correlation matrices, exact quantiles, counts, extremes and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .panel import broadcast_if_small

#: Values between two bounds that are ranked one by one, at most; cuts of a step; accuracy of the sketch that chooses them.
LEAF, CUTS, ACCURACY = 10_000, 64, 2_000


def factor_correlations(panel: DataFrame, factors: Sequence[str], *, last: int | None = 60, least_names: int = 5) -> DataFrame:
    """(a, b, correlation) of all pairs of factors: the mean over dates of the correlation among names that have both.

    The ``last`` dates count (None: all), of these the ones with more than
    ``least_names`` common names and no constant side; a factor's own entry is 1.
    All pairs are one aggregation of the panel's rows.
    """
    rows = panel.select("t_idx", *factors)
    if last is not None:
        newest = panel.agg(F.max("t_idx")).first()[0]
        rows = rows.where(F.col("t_idx") > (newest or 0) - last)
    pairs = [(i, j) for i in range(len(factors)) for j in range(i + 1, len(factors))]
    known = lambda i: F.col(factors[i]).isNotNull()
    each = [F.when(known(i) & known(j), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(factors[i]).cast("double").alias("x"), F.col(factors[j]).cast("double").alias("y"))) for i, j in pairs]
    each = each or [F.lit(None).cast("struct<i:int,j:int,x:double,y:double>")]
    varied = (F.max("x") > F.min("x")) & (F.max("y") > F.min("y")) & (F.count("*") > least_names)
    long = rows.select("t_idx", F.explode(F.array(*each)).alias("p")).where("p is not null").select("t_idx", "p.*")
    daily = long.groupBy("t_idx", "i", "j").agg(F.when(varied, F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))).alias("r"))
    means = daily.groupBy("i", "j").agg(F.avg("r").alias("correlation"))
    spark = panel.sparkSession
    cells = spark.createDataFrame([(a, b, min(i, j), max(i, j)) for i, a in enumerate(factors) for j, b in enumerate(factors)], "a string, b string, i int, j int")
    return cells.join(means, ["i", "j"], "left").select("a", "b", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("correlation")).alias("correlation"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, share and value: exact quantiles between neighbours, linearly, of groups of any size.

    No group's values are held together. Each wanted rank has bounds; a step counts
    the values under some cuts between them, which a sketch spreads evenly, and
    moves the bounds to the cuts around the rank, until at most ``LEAF`` values lie
    between. Equal values are one. Nulls and NaN do not count; groups without values
    give null; groups with a null key are groups.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie in 0 to 1")
    keys = [f"_k{i}" for i in range(len(by))]
    group = F.struct(*(F.col(k) for k in keys)) if keys else F.lit(0)
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("x")).withColumn("g", F.to_json(group, {"ignoreNullFields": "false"}) if keys else F.lit("0"))
    groups = rows.groupBy("g", *keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    values = rows.where("x is not null").select("g", "x")
    wanted = groups.select("*", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")).withColumn("place", F.col("share") * (F.col("n") - 1))
    # below: how many values lie under lo
    state = wanted.select("g", *keys, "share", (F.col("place") - F.floor("place")).alias("part"), F.floor("place").alias("first"), F.ceil("place").alias("second"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    state = written(state, "bounds")
    while True:
        wide = state.where(F.col("inside") > LEAF)
        if wide.isEmpty():
            break
        inside = values.join(broadcast_if_small(wide.select("g", "share", "lo", "hi")), "g").where((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi")))
        cuts = inside.groupBy("g", "share").agg(F.array_distinct(F.percentile_approx("x", [(k + 0.5) / CUTS for k in range(CUTS)], ACCURACY)).alias("cuts"))
        cuts = written(cuts, "cuts")
        # exact counts of values up to each cut and under it, by the number of cuts under a value
        near = values.join(broadcast_if_small(wide.join(cuts, ["g", "share"]).select("g", "share", "lo", "hi", "cuts")), "g").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        under = F.size(F.filter("cuts", lambda c: c < F.col("x")))
        hit = F.array_contains("cuts", F.col("x"))
        counts = near.groupBy("g", "share", under.alias("under"), hit.alias("hit")).agg(F.count("*").alias("n"))
        counts = counts.groupBy("g", "share").agg(F.collect_list(F.struct("under", "hit", "n")).alias("counts"))
        moved = state.join(counts, ["g", "share"], "left").join(cuts, ["g", "share"], "left")

        def up_to(k: Column, with_hit: bool) -> Column:
            """Values under the k-th cut (0-based), or up to it."""
            count = lambda c: F.when((c["under"] < k) | ((c["under"] == k) & (~c["hit"] | F.lit(with_hit))), c["n"]).otherwise(F.lit(0))
            return F.col("below") + F.aggregate(F.transform("counts", count), F.lit(0).cast("bigint"), lambda a, b: a + b)

        edges = F.transform("cuts", lambda c, k: F.struct(c.alias("x"), up_to(k, False).alias("under"), up_to(k, True).alias("upto")))
        moved = moved.withColumn("edges", edges)
        low = F.filter("edges", lambda e: e["under"] <= F.col("first"))
        high = F.filter("edges", lambda e: e["upto"] > F.col("second"))
        some_low, some_high = F.coalesce(F.size(low), F.lit(0)) > 0, F.coalesce(F.size(high), F.lit(0)) > 0
        moved = moved.withColumns({"low": F.when(some_low, F.element_at(low, -1)), "high": F.when(some_high, F.element_at(high, 1))})
        between = F.coalesce(F.col("high.under"), F.col("below") + F.coalesce(F.aggregate(F.transform("counts", lambda c: c["n"]), F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0))) - F.coalesce(F.col("low.upto"), F.col("below"))
        state = written(
            moved.select(
                "g", *keys, "share", "part", "first", "second", F.coalesce("low.x", "lo").alias("lo"), F.coalesce("high.x", "hi").alias("hi"),
                F.coalesce("low.under", "below").alias("below"), F.when(F.col("counts").isNull(), F.lit(0)).otherwise(F.greatest(between, F.lit(0))).cast("bigint").alias("inside"),
            ),
            "bounds",
        )
    near = values.join(broadcast_if_small(state.select("g", "share", "lo", "hi", "below", "first", "second")), "g").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    few = near.groupBy("g", "share", "x", "below", "first", "second").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("g", "share").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.withColumn("upto", upto)
    found = ranked.groupBy("g", "share").agg(F.min(F.when(F.col("upto") > F.col("first"), F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > F.col("second"), F.col("x"))).alias("b"))
    out = state.join(found, ["g", "share"], "left")
    return out.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, rank) of the non-null values, the most frequent first, equal ones by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # a row for each value


def pivot_mean(df: DataFrame, values: str, index: str, columns: str, names: Sequence[Any]) -> DataFrame:
    """Means of ``values`` by ``index``, with a column for each of ``names``."""
    return df.groupBy(index).pivot(columns, list(names)).agg(F.avg(values))


def extremes(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """Rows of ``df`` with the ``n`` largest and smallest values: with side ('top' or 'bottom') and rank; equal values by ``tie``."""
    known = df.where(F.col(column).isNotNull())
    sides = []
    for side, order in (("top", F.desc(column)), ("bottom", F.asc(column))):
        first = known.orderBy(order, tie).limit(n)  # a top-k of each task before they meet
        sides.append(first.withColumn("side", F.lit(side)).withColumn("rank", F.row_number().over(Window.orderBy(order, tie))))
    return sides[0].unionByName(sides[1])


def density(df: DataFrame, column: str, *, points: int = 300, bins: int = 2000) -> DataFrame:
    """(point, x, kde, normal): a Gaussian kernel density with Scott's bandwidth, and the normal curve of the same mean and deviation.

    The kernel runs over ``bins`` equal bins of one histogram, each standing for its
    values at its middle, so its cost does not grow with the rows. Without two different values there are no rows.
    """
    x = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("x")).where("x is not null")
    n, lo, hi, mean, sd = x.agg(F.count("x"), F.min("x"), F.max("x"), F.avg("x"), F.stddev_samp("x")).first()
    spark = df.sparkSession
    if not n or lo == hi:
        return spark.createDataFrame([], "point int, x double, kde double, normal double")
    width = (hi - lo) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width))
    counted = x.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).select((F.lit(lo) + (F.col("bin") + 0.5) * width).alias("at"), "n")
    grid = spark.range(points).select(F.col("id").cast("int").alias("point"), (F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("x"))
    h = sd * n**-0.2
    bell = lambda z, s: F.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi))
    # both sides are of fixed size: points and bins
    kde = grid.crossJoin(F.broadcast(counted)).groupBy("point", "x").agg((F.sum(F.col("n") * bell((F.col("x") - F.col("at")) / h, h)) / n).alias("kde"))
    return kde.withColumn("normal", bell((F.col("x") - mean) / sd, sd))
