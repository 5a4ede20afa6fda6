"""Weights of a score's variants: searched on a simplex with folds, and what each contributes to a wrong boost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simplex(dim: int, units: int) -> list[tuple[int, ...]]:
    """All ways to share ``units`` among ``dim`` variants, in order; a fixed number of points whatever the data."""
    if dim == 1:
        return [(units,)]
    return [(k, *rest) for k in range(units + 1) for rest in simplex(dim - 1, units - k)]


def _grid(points) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in p)) for p in points))


def _score(parts: Column, weights: Column, units: int) -> Column:
    """Rounded, so that sums in another order tie alike."""
    return F.round(F.aggregate(F.zip_with(parts, weights, lambda s, w: s * w), F.lit(0.0), lambda a, x: a + x) / units, 9)


def top_hits(facts: DataFrame, key: str, variants: list[str], truth: str, fold: str, units: int = 10) -> DataFrame:
    """(fold, point, n, hits): for each point of the grid how often the best goal is the true one, from long facts (key, goal, variants' scores, truth, fold).

    A key's scores stand together once, a row of as many as there are goals; all points are evaluated on it and counted in one
    aggregation that is combined before it is shuffled. Of equal scores the lower goal wins.
    """
    points = simplex(len(variants), units)
    rows = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("goal", F.array(*variants).alias("s")))).alias("g"), F.first(truth).alias("t"), F.first(fold).alias("fold"))

    def best(weights: Column) -> Column:
        places = F.transform(F.col("g"), lambda x: F.struct(_score(x["s"], weights, units).alias("s"), (-x["goal"]).alias("g")))
        return -F.array_max(places)["g"]

    hits = rows.select("fold", F.posexplode(F.transform(_grid(points), lambda w: (best(w) == F.col("t")).cast("long"))).alias("point", "hit"))
    return hits.groupBy("fold", "point").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))


def label_hits(facts: DataFrame, variants: list[str], y: str, threshold: Column, fold: str, units: int = 10) -> DataFrame:
    """(fold, point, goal, tp, fp, fn) of each goal's own threshold, from long facts with y of 0 and 1."""
    points = simplex(len(variants), units)
    says = F.transform(_grid(points), lambda w: _score(F.array(*variants), w, units) >= threshold)
    rows = facts.select(F.col(fold).alias("fold"), "goal", (F.col(y) == 1).alias("y"), F.posexplode(says).alias("point", "p"))
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("fold", "point", "goal").agg(n(F.col("y") & F.col("p")).alias("tp"), n(~F.col("y") & F.col("p")).alias("fp"), n(F.col("y") & ~F.col("p")).alias("fn"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def macro_f1(counts: DataFrame) -> DataFrame:
    """(fold, point, f1): mean over goals; a goal that is neither there nor said counts 0."""
    return counts.groupBy("fold", "point").agg(F.round(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))), 9).alias("f1"))


def others(counts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Each fold's counts replaced by those of all other folds together. Counts are few: folds times points times goals."""
    total = counts.groupBy(*by).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    return counts.join(total, by).select("fold", *by, *((F.col(f"_{v}") - F.col(v)).alias(v) for v in values))


def chosen(train: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """(fold, point, train, test): for each fold the point that is best on the others, of equal ones the first, and its value on the fold itself."""
    order = Window.partitionBy("fold").orderBy(F.desc(value), "point")
    best = train.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("fold", "point", F.round(value, 6).alias("train"))
    return best.join(test.select("fold", "point", F.round(value, 6).alias("test")), ["fold", "point"])


def searched_top(facts: DataFrame, key: str, variants: list[str], truth: str, fold: str, units: int = 10) -> DataFrame:
    """Weights chosen on four folds and tested on the fifth, by accuracy of the best goal; ``weights`` are tenths (or units) by variant."""
    counts = top_hits(facts, key, variants, truth, fold, units).checkpoint()
    rate = lambda c: c.withColumn("rate", F.round(F.col("hits") / F.col("n"), 9))
    return _named(chosen(rate(others(counts, ["point"], ["n", "hits"])), rate(counts), "rate"), variants, units)


def searched_labels(facts: DataFrame, variants: list[str], y: str, threshold: Column, fold: str, units: int = 10) -> DataFrame:
    """The same by macro F1 of labels."""
    counts = label_hits(facts, variants, y, threshold, fold, units).checkpoint()
    return _named(chosen(macro_f1(others(counts, ["point", "goal"], ["tp", "fp", "fn"])), macro_f1(counts), "f1"), variants, units)


def _named(rows: DataFrame, variants: list[str], units: int) -> DataFrame:
    point = F.get(_grid(simplex(len(variants), units)), F.col("point"))
    return rows.select("*", *(F.get(point, i).cast("int").alias(f"{v}_units") for i, v in enumerate(variants)))


def attributed(goals: DataFrame, targets: DataFrame, by: list[str], weights: dict[str, float], threshold: Column) -> DataFrame:
    """Boosts that changed a decision, and what they came from.

    ``goals`` are (by..., goal, score, y), ``targets`` (by..., goal, target, and a column of similarity for each variant in ``weights``). A target's score is the weighted mean of its variants; the
    best target of a goal, of equal ones the first by name, lifts the goal to its score. Rows are goals that only the lift brings to the threshold: the winning
    target, each variant's share of its score, the dominant variant (of equal ones the first in ``weights``), and whether the boost was wrong.
    """
    total = sum(weights.values())
    share = {v: F.round(F.col(v) * (w / total), 9) for v, w in weights.items()}
    rows = targets.select(*by, "goal", "target", *(c.alias(v) for v, c in share.items()))
    rows = rows.withColumn("_s", F.round(reduce(lambda a, b: a + b, (F.col(v) for v in weights)), 9))
    best = rows.groupBy(*by, "goal").agg(F.min_by(F.struct("target", F.col("_s").alias("s"), *weights), F.struct(-F.col("_s"), F.col("target"))).alias("b"))
    met = goals.join(best, [*by, "goal"]).where((F.col("score") < threshold) & (F.col("b.s") > F.col("score")) & (F.col("b.s") >= threshold))
    top = F.greatest(*(F.col(f"b.{v}") for v in weights))
    dominant = F.coalesce(*(F.when(F.col(f"b.{v}") == top, v) for v in weights))
    return met.select(*by, "goal", F.col("b.target").alias("target"), F.col("b.s").alias("target_score"), "score", *(F.col(f"b.{v}").alias(f"{v}_share") for v in weights), dominant.alias("dominant"), (F.col("y") != 1).alias("is_wrong"))


def attribution_counts(found: DataFrame) -> DataFrame:
    """Wrong and right boosts by goal, target and dominant variant, each by itself and all together, in one pass."""
    sets = found.cube("goal", "target", "dominant").agg(F.grouping_id().alias("g"), F.sum(F.col("is_wrong").cast("long")).alias("wrong"), F.sum((~F.col("is_wrong")).cast("long")).alias("right"))
    kind = F.when(F.col("g") == 3, "goal").when(F.col("g") == 5, "target").when(F.col("g") == 6, "variant").when(F.col("g") == 7, "all")
    name = F.coalesce(F.col("goal").cast("string"), F.col("target").cast("string"), "dominant", F.lit("all"))
    return sets.select(kind.alias("kind"), name.alias("name"), "wrong", "right", F.round(F.col("wrong") / (F.col("wrong") + F.col("right")), 6).alias("wrong_share")).where("kind is not null")
