"""Scores of activities against goals: similarity, thresholds, model combination, boosts, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def centroids(vectors: DataFrame, goal: str, embedding: str) -> DataFrame:
    """(goal, reference): the mean vector of each goal; added up by dimension, so that no task holds a goal's rows."""
    parts = vectors.where(F.col(goal).isNotNull()).select(F.col(goal).alias("goal"), F.posexplode(embedding).alias("i", "x"))
    means = parts.groupBy("goal", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("goal").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("reference"))


def scored(activities: DataFrame, goals: DataFrame, embedding: str, digits: int = 4) -> DataFrame:
    """Long facts: each activity with each goal, its similarity as it is and rounded as the score. Goals are a small dimension, one row each, sent to all tasks."""
    length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    own, other = activities.withColumn("_own", length(embedding)), goals.withColumn("_other", length("reference"))  # once a row, not once a pair
    size = F.col("_own") * F.col("_other")
    score = F.when(size > 0, dot(F.col(embedding), F.col("reference")) / size).otherwise(0.0)
    return own.join(F.broadcast(other), how="cross").withColumn("similarity", score).withColumn("score", F.round("similarity", digits)).drop(embedding, "reference", "_own", "_other")


def threshold(goal: Column, mode: str, custom: dict[int, float] | None = None) -> Column:
    """A custom value, else the goal's, else the mode's default."""
    default, own = L.THRESHOLDS[mode]
    chosen = dict(enumerate(own, 1)) | (custom or {})
    return reduce(lambda out, kv: F.when(goal == kv[0], kv[1]).otherwise(out), chosen.items(), F.lit(default))


def top_goal(facts: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """Each activity's n best goals; of equal scores the lower goal number is first."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "goal")
    return facts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def ensemble(facts: DataFrame, by: list[str], mode: str = "weighted", weights=L.MODEL_WEIGHTS, floor: float = 0.5) -> DataFrame:
    """score and primary_model from columns st and bert: weighted by goal, st unless its best is under ``floor``, or st alone."""
    if mode == "weighted":
        share = reduce(lambda out, kv: F.when(F.col("goal") == kv[0], kv[1]).otherwise(out), enumerate(weights, 1), F.lit(0.5))
        return facts.withColumns({"score": share * F.col("bert") + (1 - share) * F.col("st"), "primary_model": F.lit("ensemble")})
    if mode == "fallback":
        weak = F.max("st").over(Window.partitionBy(*by)) < floor
        return facts.withColumns({"score": F.when(weak, F.col("bert")).otherwise(F.col("st")), "primary_model": F.when(weak, "bert").otherwise("st")})
    if mode == "single":
        return facts.withColumns({"score": F.col("st"), "primary_model": F.lit("st")})
    raise ValueError(f"unknown mode {mode}")


def keyword_boost(facts: DataFrame, text: str, boosts=L.BOOSTS) -> DataFrame:
    """A goal with one of its keywords in the text gains its boost, up to 1."""
    low = F.lower(F.col(text))
    gain = reduce(lambda out, kv: F.when((F.col("goal") == kv[0]) & T.any_of(low, kv[1][0]), kv[1][1]).otherwise(out), boosts.items(), F.lit(0.0))
    return facts.withColumns({"boosted": gain > 0, "score": F.least(F.lit(1.0), F.col("score") + gain)})


def corrected(facts: DataFrame, text: str, program) -> DataFrame:
    """An ordered program of corrections; each rule sees the scores that the one before left.

    A rule is (goal, wanted, unwanted, penalty, gains): if the text has an unwanted and no wanted term, the
    goal loses the penalty, down to 0; if it has an unwanted one, the goals in gains gain theirs, up to 1.
    """
    low = F.lower(F.col(text))
    for goal, wanted, unwanted, penalty, gains in program:
        has = T.any_of(low, unwanted)
        score = F.when((F.col("goal") == goal) & has & ~T.any_of(low, wanted), F.greatest(F.lit(0.0), F.col("score") - penalty))
        for other, gain in gains.items():
            score = score.when((F.col("goal") == other) & has, F.least(F.lit(1.0), F.col("score") + gain))
        facts = facts.withColumn("score", score.otherwise(F.col("score")))
    return facts


def context_weighted(facts: DataFrame, section: str, strength: float = 0.3, weights=L.SECTION_WEIGHTS, digits: int = 4) -> DataFrame:
    pairs = [(s, g, w) for s, own in weights.items() for g, w in own.items()]
    weight = reduce(lambda out, p: F.when((F.col(section) == p[0]) & (F.col("goal") == p[1]), p[2]).otherwise(out), pairs, F.lit(1.0))
    return facts.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") * (1 + (weight - 1) * strength)), digits))


def nearest(vectors: DataFrame, query, k: int, embedding: str) -> DataFrame:
    """The k rows nearest to one vector; each task keeps k."""
    at = F.lit([float(x) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col(embedding), at), 6)).drop(embedding).orderBy(F.desc("score"), "vec_id").limit(k)


def target_boost(facts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """A goal scores at least as much as the best of its targets (by..., goal, target, score)."""
    best = targets.groupBy(*by, "goal").agg(F.max("score").alias("_best"))
    return facts.join(best, [*by, "goal"], "left").withColumns({"boosted": F.coalesce(F.col("_best") > F.col("score"), F.lit(False)), "score": F.greatest("score", "_best")}).drop("_best")


def model_weight(precision_first: Column, precision_second: Column) -> Column:
    """The first model's share of both precisions, a half if neither has any."""
    total = precision_first + precision_second
    return F.when(total > 0, F.round(precision_first / total, 3)).otherwise(0.5)


def combined(variants: DataFrame, weights: dict[str, float], missing: float = 0.2) -> DataFrame:
    """(goal, reference): each goal's variants (goal, variant, reference) added up by weight, renormalised over those there, and brought to length one.

    Added up by dimension, so that no task holds a goal's vectors; a variant without a weight has ``missing``.
    """
    weight = reduce(lambda out, kv: F.when(F.col("variant") == kv[0], kv[1]).otherwise(out), weights.items(), F.lit(missing))
    parts = variants.select("goal", weight.alias("w"), F.posexplode("reference").alias("i", "x"))
    sums = parts.groupBy("goal", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    rows = sums.groupBy("goal").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    size = F.sqrt(dot(F.col("v"), F.col("v")))
    return rows.select("goal", F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("reference"))


def goals_compared(goals: DataFrame) -> DataFrame:
    """Each goal with the others, the most similar first. A row for each goal is joined with as many."""
    a, b = goals.toDF("goal", "a"), goals.toDF("other", "b")
    rows = a.join(b, F.col("goal") != F.col("other")).select("goal", "other", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("score"), "other")))


def top_target(targets: DataFrame, by: list[str]) -> DataFrame:
    """The best target of each goal and activity; of equal ones the first by name."""
    return targets.groupBy(*by, "goal").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("x")).select(*by, "goal", F.col("x.target").alias("target"), (-F.col("x.s")).alias("score"))


def weighed_variants(facts: DataFrame, by: list[str], weights: dict[str, float]) -> DataFrame:
    """Scores of several variants (by..., goal, variant, score) as one: their mean by weight. Variants without a weight don't count."""
    weight = reduce(lambda out, kv: F.when(F.col("variant") == kv[0], kv[1]).otherwise(out), weights.items(), F.lit(0.0))
    rows = facts.withColumn("_w", weight).where("_w > 0")
    return rows.groupBy(*by, "goal").agg((F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("score"))


def logits(facts: DataFrame, logit: str = "logit") -> DataFrame:
    """A second model's logits as scores."""
    return facts.withColumn("score", 1 / (1 + F.exp(-F.col(logit))))


def keyword_match(text: Column, keywords: Column) -> Column:
    """Share of an array of keywords that a text has; 0 without any."""
    low = F.lower(text)
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / F.size(keywords)).otherwise(0.0)


def goal_variants(goals: DataFrame, most: int = 40) -> DataFrame:
    """(goal, variant, text) of definitions (goal, name, description, local_keywords, indicators, keywords): what of them is there."""
    join = lambda c, n=None: F.array_join(F.slice(c, 1, n) if n else F.col(c), " ")
    pairs = {"core": F.concat_ws(". ", "name", "description"), "local": join("local_keywords"), "indicators": join("indicators"), "keywords": join("keywords", most)}
    rows = goals.select("goal", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.trim(F.coalesce(v, F.lit(""))).alias("text")) for k, v in pairs.items()))).alias("x"))
    return rows.select("goal", "x.variant", "x.text").where("text <> ''")


def realigned(facts: DataFrame, by: list[str], mode: str, custom: dict[int, float] | None = None) -> DataFrame:
    """Facts whose scores have changed, with is_aligned of the new ones, each activity's num_aligned, and an explanation: its best goal, how strong it is, and how many others are aligned."""
    w = Window.partitionBy(*by)
    rows = facts.withColumn("is_aligned", F.col("score") >= threshold(F.col("goal"), mode, custom))
    best = F.max(F.struct("score", (-F.col("goal")).alias("g"), "is_aligned")).over(w)
    rows = rows.withColumns({"num_aligned": F.sum(F.col("is_aligned").cast("int")).over(w).cast("int"), "_b": best})
    strength = F.when(F.col("_b.score") >= 0.7, "strongly").when(F.col("_b.score") >= 0.5, "moderately").otherwise("weakly")
    told = F.concat(F.lit("goal "), -F.col("_b.g"), F.lit(" "), strength, F.lit(", "), F.col("num_aligned"), F.lit(" aligned"))
    return rows.withColumn("explanation", F.when(F.col("_b.score") > 0, told).otherwise("no goal")).drop("_b")
