"""Trends of yearly scores: least squares, direction, change, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_means(facts: DataFrame, report: list[str], by: list[str]) -> DataFrame:
    """(by..., goal, year, score): the mean over reports of each report's mean, so that a report counts once however many activities it has. ``report`` holds the year."""
    keys = list(dict.fromkeys([*by, *report]))
    micro = F.call_function("div", 2000 * F.sum("milli") + F.count("*"), 2 * F.count("*"))
    per = facts.groupBy(*keys, "goal").agg(micro.alias("m"))
    return per.groupBy(*by, "goal", "year").agg((F.call_function("div", 2 * F.sum("m") + F.count("*"), 2 * F.count("*")) / F.lit(1e6)).alias("score"))


def trends(yearly: DataFrame, by: list[str], year: str = "year", score: str = "score", least_slope: float = 0.01) -> DataFrame:
    """Per group: slope, r2, percent change from the first to the last year, significance and direction. Two years or more.

    With two years the fit is exact and has no degree of freedom left; such a trend counts as significant. A flat series has r2 0 and isn't.
    """
    y, x = F.col(score), F.col(year).cast("double")
    rows = yearly.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.when(F.regr_slope(y, x) == 0, 0.0).otherwise(F.regr_r2(y, x)).alias("r2"), F.min_by(score, year).alias("first"), F.max_by(score, year).alias("last"))
    rows = rows.where("n > 1")
    sure = p_value(F.when(F.col("b") == 0, 0.0).otherwise(F.col("r2")), F.col("n")) < 0.05
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    way = F.when(~sure, "stable").when(F.col("b") > least_slope, "increasing").when(F.col("b") < -least_slope, "decreasing").otherwise("stable")
    return rows.select(*by, "n", F.round("b", 8).alias("slope"), F.round("r2", 6).alias("r2"), F.round(change, 4).alias("percent_change"), sure.alias("is_significant"), way.alias("direction"))


def ranking(found: DataFrame, by: str) -> DataFrame:
    """Groups by their mean slope, the steepest first."""
    means = found.groupBy(by).agg(F.round(F.avg("slope"), 5).alias("mean_slope"))
    return means.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_slope"))))  # one row for each group


def contiguous(years: DataFrame, by: list[str], year: str = "year") -> DataFrame:
    """Span of a group's years and whether none is missing."""
    gap = F.col(year) - F.lag(year).over(Window.partitionBy(*by).orderBy(year))
    rows = years.select(*by, year).distinct().withColumn("gap", gap)
    return rows.groupBy(*by).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.coalesce(F.bool_and(F.col("gap") == 1), F.lit(True)).alias("contiguous"))


def p_value(r2: Column, n: Column) -> Column:
    """Two-sided p of a slope from r2 and the number of years, by the closed sum of Student's t for whole degrees of freedom. 1 if flat, 0 if exact."""
    free = n - 2
    a = F.atan(F.sqrt(r2 / (1 - r2)))  # of t over the root of the degrees of freedom

    def product(upto, factor):
        return F.aggregate(F.when(upto >= 1, F.sequence(F.lit(1).cast("long"), upto.cast("long"))).otherwise(F.array().cast("array<long>")), F.lit(1.0), lambda p, i: p * factor(i))

    def total(first, last, term):
        return F.aggregate(F.when(last >= first, F.sequence(F.lit(first).cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda s, j: s + term(j))

    odd = 1 - 2 / F.pi() * (a + F.sin(a) * total(1, F.floor((free - 1) / 2), lambda j: F.pow(F.cos(a), 2 * j - 1) * product(j - 1, lambda i: 2.0 * i / (2 * i + 1))))
    even = 1 - F.sin(a) * total(0, F.floor(free / 2) - 1, lambda j: F.pow(F.cos(a), 2 * j) * product(j, lambda i: (2.0 * i - 1) / (2 * i)))
    return F.when(n == 2, 0.0).when(r2 <= 0, 1.0).when(r2 >= 1, 0.0).when(free % 2 == 1, odd).otherwise(even)


def with_p_value(yearly: DataFrame, by: list[str], year: str = "year", score: str = "score") -> DataFrame:
    """Per group of two years or more: n, slope, r2 and p."""
    y, x = F.col(score), F.col(year).cast("double")
    rows = yearly.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r")).where("n > 1").withColumn("r", F.when(F.col("b") == 0, 0.0).otherwise(F.col("r")))
    return rows.select(*by, "n", F.round("b", 8).alias("slope"), F.round("r", 6).alias("r2"), F.round(p_value(F.col("r"), F.col("n")), 6).alias("p_value"))


def dense(scores: DataFrame, report: list[str], goals, score: str = "score") -> DataFrame:
    """Every goal for every report, 0 where it has no score."""
    grid = scores.select(*report).distinct().withColumn("goal", F.explode(F.array(*(F.lit(g) for g in goals))))
    return grid.join(scores, [*report, "goal"], "left").select(*report, "goal", F.coalesce(F.col(score), F.lit(0.0)).alias(score))


def strongest(found: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k trends with the steepest slopes, up or down."""
    return found.orderBy(F.desc(F.abs("slope")), *by).limit(k).select(*by, "slope")
