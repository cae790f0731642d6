"""Aggregates of document analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, first_seen: str | None = None) -> DataFrame:
    """The value with the most weight a group: of equals the one with the least ``first_seen``, if given, then the smallest.

    Pre-aggregates by value, so a group's rows never meet in one task, only its values.
    """
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"), *([F.min(first_seen).alias("_first")] if first_seen else []))
    order = F.struct((-F.col("weight")).alias("w"), *([F.col("_first").alias("f")] if first_seen else []), F.col(value).alias("v"))
    return sums.groupBy(*keys).agg(F.min_by(value, order).alias(value), F.max("weight").alias("weight"))


def majority(flag: Column, weight: Column) -> Column:
    """Whether flagged rows hold more than half of the weight."""
    return F.sum(F.when(flag, weight).otherwise(0)) * 2 > F.sum(weight)


def placed_values(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the sorted values at places 0 to n - 1, each a function of the group's size n; nulls are left out.

    Counts by value add up to places, so no group's values ever stand in one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counted = counts.withColumn("_all", F.sum("_n").over(group)).withColumn("_upto", upto)
    first = (F.min(F.when(F.col("_upto") > place(F.col("_all")), F.col(value))).alias(name) for name, place in places.items())
    return counted.groupBy(*keys).agg(*first)


def at_share(q: float) -> Callable[[Column], Column]:
    """The place floor((n - 1) q)."""
    return lambda n: F.floor((n - 1) * F.lit(q))


def repeated_margins(margins: DataFrame, keys: list[str], page: str, text: str, share: float = 0.4) -> DataFrame:
    """Texts that stand in the margin of at least two pages and of ``share`` of all."""
    pages = margins.groupBy(*keys).agg(F.count_distinct(page).alias("pages"))
    seen = margins.groupBy(*keys, text).agg(F.count_distinct(page).alias("n"))
    return seen.join(pages, keys).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share))).drop("pages")


def size_clusters(sizes: Column, step: float = 0.6) -> Column:
    """Distinct sizes from the largest down, each kept if it is more than ``step`` below the last kept."""
    down = F.sort_array(F.array_distinct(sizes), asc=False)
    return F.aggregate(down, F.slice(down, 1, 1), lambda kept, s: F.when(F.element_at(kept, -1) - s > step, F.concat(kept, F.array(s))).otherwise(kept))


def nearest_level(size: Column, levels: Column, most: int = 6) -> Column:
    """1-based place of the level nearest to a size, the first of equals, capped."""
    gaps = F.transform(levels, lambda v, i: F.struct(F.abs(v - size).alias("gap"), i.alias("i")))
    return F.least(F.array_min(gaps)["i"] + 1, F.lit(most))


def histogram(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Counts by value 0 to 255."""
    return df.groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin at which the counts add up to ``share`` of all."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return hist.withColumn("c", upto).withColumn("t", total).where(F.col("c") >= F.col("t") * share).groupBy(*keys).agg(F.min("v").alias("v"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The bin that parts a histogram with the most variance between both sides; the first of equals.

    Variances are compared as exact products of whole numbers would be, in doubles.
    """
    by = Window.partitionBy(*keys)
    upto = by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.select(*keys, "v", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s"), F.sum("n").over(by).alias("all_n"), F.sum(F.col("n") * F.col("v")).over(by).alias("all_s"))
    rest = F.col("all_n") - F.col("w")
    gap = F.col("s").cast("double") / F.col("w") - (F.col("all_s") - F.col("s")).cast("double") / rest
    spread = F.when(rest > 0, F.round(F.col("w").cast("double") * rest * gap * gap, 3)).otherwise(F.lit(-1.0))
    return d.withColumn("b", spread).groupBy(*keys).agg(F.min_by("v", F.struct((-F.col("b")).alias("b"), F.col("v").alias("o"))).alias("threshold"))
