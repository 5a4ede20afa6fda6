"""Reports, groups of reports and councils over the long facts (activity, goal, score, is_aligned)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rounded(part, whole, scale: int):
    """part / whole / scale to six digits, halves up, in whole numbers, so that every engine gives the same."""
    unit = 1_000_000 // scale
    return F.call_function("div", 2 * unit * part + whole, 2 * whole) / F.lit(1e6)


def mean(milli: str = "milli"):
    """Mean of thousandths, which are not negative."""
    return rounded(F.sum(milli), F.count("*"), 1000)


def spread(n, s, q):
    """n * q - s * s of whole numbers, as a double: made in decimals, as the products of millions of rows are beyond a long."""
    n, s, q = (x.cast("decimal(19,0)") for x in (n, s, q))
    return (n * q - s * s).cast("double")


def share(flag):
    return rounded(F.sum(flag.cast("long")), F.count("*"), 1)


def alignment(facts: DataFrame, by: list[str]) -> DataFrame:
    """Per group and goal: activities, mean score and coverage."""
    return facts.groupBy(*by, "goal").agg(F.count("*").alias("n"), mean().alias("mean_score"), share(F.col("is_aligned")).alias("coverage"))


def gaps(facts: DataFrame, by: list[str], kind: str, threshold: float = 0.5) -> DataFrame:
    """Goals that are gaps: without coverage ('zero'), with a mean under the threshold ('threshold'), or the former ranked by mean ('ranked')."""
    rows = alignment(facts, by)
    if kind == "threshold":
        return rows.where(F.col("mean_score") < threshold).select(*by, "goal", "mean_score")
    none = rows.where("coverage = 0").select(*by, "goal", "mean_score")
    return none if kind == "zero" else none.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_score"), "goal")))


def grouped(facts: DataFrame, sets: list[list[str]]) -> DataFrame:
    """One pass over several groupings; columns that a grouping lacks are 'all'."""
    names = sorted({c for s in sets for c in s})
    rows = facts.groupingSets([[*(F.col(c) for c in s), F.col("goal")] for s in sets], *names, "goal").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), mean().alias("mean_score"), share(F.col("is_aligned")).alias("coverage"))
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in names), "goal", "n", "mean_score", "coverage")


def mean_of_means(facts: DataFrame, report: list[str], by: list[str]) -> DataFrame:
    """Unweighted mean over reports of each report's mean, against the mean over all activities."""
    per = facts.groupBy(*report, "goal").agg(F.sum("milli").alias("s"), F.count("*").alias("n"))
    return per.groupBy(*by, "goal").agg(F.round(F.avg(F.col("s").cast("double") / F.col("n") / 1000), 12).alias("mean_of_means"), rounded(F.sum("s"), F.sum("n"), 1000).alias("pooled_mean"))


def council_coverage(facts: DataFrame, by: list[str], council: str) -> DataFrame:
    """Share (in percent) of councils with an aligned activity, and their names."""
    per = facts.groupBy(*by, "goal", council).agg(F.max(F.col("is_aligned").cast("int")).alias("hit"))
    return per.groupBy(*by, "goal").agg(F.round(100.0 * F.sum("hit") / F.count("*"), 2).alias("coverage_pct"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit") == 1, F.col(council)))), ",").alias("councils"))


def wide(facts: DataFrame, by: list[str], goals) -> DataFrame:
    """One row per group, one column per goal."""
    cells = {f"goal_{g}": rounded(F.coalesce(F.sum(F.when((F.col("goal") == g) & F.col("is_aligned"), 1).otherwise(0)), F.lit(0)), F.count("*"), 1) for g in goals}
    return facts.groupBy(*by).agg(F.count("*").alias("activities"), *(c.alias(k) for k, c in cells.items()))


def proportions(facts: DataFrame, by: list[str], goals: DataFrame) -> DataFrame:
    """Share of each goal among a group's activities, 0 where it has none."""
    counts = facts.groupBy(*by, "goal").agg(F.count("*").alias("n"))
    grid = facts.select(*by).distinct().join(F.broadcast(goals), how="cross")
    total = F.sum("n").over(Window.partitionBy(*by))
    return grid.join(counts, [*by, "goal"], "left").na.fill({"n": 0}).select(*by, "goal", rounded(F.col("n"), total, 1).alias("proportion"))


def deviation(facts: DataFrame, region: str) -> DataFrame:
    """Each region's mean per goal less the goal's overall mean."""
    per = facts.groupBy(region, "goal").agg(F.sum("milli").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("goal")
    return per.select(region, "goal", F.round(F.col("s").cast("double") / F.col("n") / 1000 - F.sum("s").over(w).cast("double") / F.sum("n").over(w) / 1000, 6).alias("deviation"))


def samples(facts: DataFrame, k: int = 3) -> DataFrame:
    """The k best activities of each goal."""
    order = Window.partitionBy("goal").orderBy(F.desc("milli"), "activity_id")
    return facts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("goal", "rank", "activity_id", "milli")


def ledger(facts: DataFrame, by: list[str]) -> DataFrame:
    """Aligned activities by goal in bands, the largest first."""
    rows = facts.groupBy(*by, "goal").agg(F.sum(F.col("is_aligned").cast("long")).alias("aligned"), mean().alias("mean_score"))
    band = F.when(F.col("aligned") == 0, "none").when(F.col("aligned") < 5, "few").when(F.col("aligned") < 15, "some").otherwise("many")
    return rows.withColumns({"band": band, "place": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("aligned"), F.desc("mean_score"), "goal"))})


def latest(facts: DataFrame, council: str, year: str) -> DataFrame:
    """Goals evidenced in each council's latest year, and how rich its extraction is."""
    per = facts.groupBy(council, year).agg(F.count_distinct(F.when(F.col("is_aligned"), F.col("goal"))).alias("goals"), F.count("*").alias("activities"))
    newest = F.row_number().over(Window.partitionBy(council).orderBy(F.desc(year)))
    grade = F.when(F.col("activities") >= 40, "rich").when(F.col("activities") >= 15, "moderate").otherwise("thin")
    return per.withColumn("r", newest).where("r = 1").select(council, year, "goals", "activities", grade.alias("extraction"))


def compared(facts: DataFrame, by: str) -> DataFrame:
    """Per goal: the widest difference between groups, who leads, and the smallest mean."""
    rows = facts.groupBy(by, "goal").agg(mean().alias("m"))
    return rows.groupBy("goal").agg(F.round(F.max("m") - F.min("m"), 6).alias("gap"), F.max(F.struct("m", by))[by].alias("leader"), F.min("m").alias("least"))


def distribution(facts: DataFrame, by: list[str], score: str = "milli") -> DataFrame:
    q = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return facts.groupBy(*by).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.round(q[0], 4).alias("q25"), F.round(q[1], 4).alias("median"), F.round(q[2], 4).alias("q75"))


def histogram(facts: DataFrame, bins: int = 10, score: str = "milli", top: int = 1000) -> DataFrame:
    return facts.groupBy(F.floor(F.col(score) * bins / top).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def changed(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """What is in both runs side by side, and what only one of them has."""
    both = new.select(key, F.col(value).alias("new_value")).join(old.select(key, F.col(value).alias("old_value")), key, "full")
    return both.withColumn("state", F.when(F.col("old_value").isNull(), "new").when(F.col("new_value").isNull(), "dropped").otherwise("both"))


def nearest_to_gaps(facts: DataFrame, by: list[str], activity: str) -> DataFrame:
    """Goals of a report with no aligned activity, ranked by their mean, and the activity that came nearest; null if none scored above 0. Of equal ones the smallest id."""
    best = F.max_by(F.struct(activity, "milli"), F.struct(F.col("milli"), -F.col(activity)))
    rows = facts.groupBy(*by, "goal").agg(F.max("is_aligned").alias("hit"), mean().alias("m"), best.alias("x")).where("not hit")
    near = F.col("x.milli") > 0
    return rows.select(*by, "goal", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("m"), "goal")).alias("rank"), F.when(near, F.col(f"x.{activity}")).alias(activity), F.when(near, F.col("x.milli")).alias("milli"))


def group_alignment(facts: DataFrame, group: str, report: list[str], activity: str, traits: list[str], k: int = 10, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """What a group's reports say together: (group, goal, mean_score, coverage, is_gap), and (group, activities, reports, mean_top_score, one sorted list for each of ``traits``, best).

    All activities of the group are pooled. mean_top_score is the mean of each activity's best score, best the k activities with the highest, as id:thousandths.
    """
    goals = alignment(facts, [group]).withColumn("is_gap", F.col("mean_score") < threshold).drop("n")
    tops = facts.groupBy(group, *report, *traits, activity).agg(F.max("milli").alias("top"))
    ranked = tops.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("top"), activity)))
    best = F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", F.concat_ws(":", F.col(activity).cast("string"), "top").alias("x")))))
    lists = (F.array_join(F.array_sort(F.collect_set(t)).cast("array<string>"), ",").alias(t) for t in traits)
    wide = ranked.groupBy(group).agg(F.count("*").alias("activities"), F.count_distinct(F.struct(*report)).alias("reports"), mean("top").alias("mean_top_score"), *lists, F.array_join(F.transform(best, lambda b: b["x"]), ",").alias("best"))
    return goals, wide


def headlines(facts: DataFrame, by: list[str], activity: str) -> DataFrame:
    """Per report: the leading goal (most aligned activities, then mean, then number), its share of the report's activities, and the strongest aligned activity of any goal. Null where nothing is aligned."""
    lead = ledger(facts, by).where("place = 1").select(*by, F.when(F.col("aligned") > 0, F.col("goal")).alias("leading_goal"), "aligned")
    strongest = F.max_by(F.when(F.col("is_aligned"), F.struct(activity, "goal", "milli")), F.when(F.col("is_aligned"), F.struct("milli", -F.col(activity), -F.col("goal"))))
    rest = facts.groupBy(*by).agg(F.count_distinct(activity).alias("activities"), strongest.alias("x"))
    return rest.join(lead, by).select(*by, "activities", "leading_goal", rounded(F.col("aligned"), F.col("activities"), 1).alias("leading_share"), F.col(f"x.{activity}").alias("strongest"), F.col("x.goal").alias("strongest_goal"), F.col("x.milli").alias("milli"))
