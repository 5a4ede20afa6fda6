"""Reads over reports and councils: comparisons, details, lists, pages and changes of a table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rollups import mean, rounded, share, spread

REPORT = ["council", "year"]

# The goals' names.
GOAL_NAMES = {
    1: "No Poverty", 2: "Zero Hunger", 3: "Good Health and Well-being", 4: "Quality Education", 5: "Gender Equality", 6: "Clean Water and Sanitation", 7: "Affordable and Clean Energy",
    8: "Decent Work and Economic Growth", 9: "Industry, Innovation and Infrastructure", 10: "Reduced Inequalities", 11: "Sustainable Cities and Communities",
    12: "Responsible Consumption and Production", 13: "Climate Action", 14: "Life Below Water", 15: "Life on Land", 16: "Peace, Justice and Strong Institutions", 17: "Partnerships for the Goals",
}


def reference_goals(spark) -> DataFrame:
    return spark.createDataFrame(list(GOAL_NAMES.items()), "goal int, name string")


def comparison(facts: DataFrame, by: list[str], top: int = 5) -> DataFrame:
    """Per report: activities, mean, and its best goals by mean and by coverage, joined."""
    per = facts.groupBy(*by, "goal").agg(F.count("*").alias("n"), F.sum("milli").alias("s"), mean().alias("m"), share(F.col("is_aligned")).alias("c"))
    best = lambda v: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(v)).alias("v"), "goal"))), 1, top), lambda x: x["goal"].cast("string")), ",")
    return per.groupBy(*by).agg(F.sum("n").alias("activities"), rounded(F.sum("s"), F.sum("n"), 1000).alias("mean_score"), best("m").alias("top_by_mean"), best("c").alias("top_by_coverage"))


def groups_of_reports(facts: DataFrame, report: list[str], by: str, least: int = 2) -> DataFrame:
    """Groups with at least ``least`` reports, 'Unknown' left out: reports, activities, mean and coverage."""
    rows = facts.where(F.col(by).isNotNull() & (F.col(by).cast("string") != "Unknown")).groupBy(by).agg(F.count_distinct(F.struct(*report)).alias("reports"), F.count("*").alias("activities"), mean().alias("mean_score"), share(F.col("is_aligned")).alias("coverage"))
    return rows.where(F.col("reports") >= least)


def covered_councils(facts: DataFrame, region: str, threshold: int) -> DataFrame:
    """Share of the councils of each region that have a score over the threshold, by goal."""
    per = facts.groupBy(region, "council", "goal").agg(F.max((F.col("milli") > threshold).cast("int")).alias("hit"))
    return per.groupBy(region, "goal").agg(share(F.col("hit")).alias("coverage"), F.count("*").alias("councils"))


def top_goals(facts: DataFrame, k: int = 5) -> DataFrame:
    """The k goals with the highest means. One row a goal reaches the window."""
    per = facts.groupBy("goal").agg(mean().alias("mean_score"), F.count("*").alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_score"), "goal"))).where(F.col("rank") <= k)


def evidence(facts: DataFrame, by: list[str], activity: str, k: int = 3) -> DataFrame:
    """Per report and goal: how many activities are aligned, and the k best of them with the other goals that they are aligned with."""
    own = facts.where("is_aligned")
    along = own.groupBy(*by, activity).agg(F.array_sort(F.collect_set("goal")).alias("goals"))
    counted = own.groupBy(*by, "goal").agg(F.count("*").alias("aligned"))
    order = Window.partitionBy(*by, "goal").orderBy(F.desc("milli"), activity)
    best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    others = F.array_join(F.transform(F.filter("goals", lambda g: g != F.col("goal")), lambda g: g.cast("string")), ",")
    return best.join(along, [*by, activity]).join(counted, [*by, "goal"]).select(*by, "goal", "aligned", "rank", activity, "milli", others.alias("also"))


def national(facts: DataFrame, report: list[str], activity: str) -> DataFrame:
    """Share of all activities that are aligned with each goal, whether or not they have a row for it: the reports' coverages, weighed by their activities. An activity belongs to one report."""
    per = facts.groupBy(*report, "goal").agg(F.sum(F.col("is_aligned").cast("long")).alias("a"))
    goals = per.groupBy("goal").agg(F.sum("a").alias("a"), F.sum((F.col("a") > 0).cast("long")).alias("reports_with"))
    total = facts.agg(F.count_distinct(activity).alias("n"))  # one row
    return goals.join(F.broadcast(total), how="cross").select("goal", rounded(F.col("a"), F.col("n"), 1).alias("share"), "reports_with")


def median_goals(facts: DataFrame, council: str, year: str) -> DataFrame:
    """Median over councils of the goals evidenced in their latest year."""
    per = facts.groupBy(council, year).agg(F.count_distinct(F.when(F.col("is_aligned"), F.col("goal"))).alias("goals"))
    newest = per.groupBy(council).agg(F.max_by("goals", year).alias("goals"))
    return newest.agg(F.count("*").alias("councils"), F.median("goals").alias("median_goals"))


def grade(activities, pages):
    """How rich an extraction is, by activities per hundred pages; unknown without pages."""
    per = activities * 100.0 / pages
    return F.when(F.coalesce(pages, F.lit(0)) <= 0, "unknown").when(per >= 40, "rich").when(per >= 15, "moderate").otherwise("thin")


def normalised(facts: DataFrame, pages: DataFrame, report: list[str]) -> DataFrame:
    """Per report: activities, pages, activities without an aligned goal, goals without an activity of theirs aligned, and activities per hundred pages."""
    per = facts.groupBy(*report, "goal").agg(F.count("*").alias("n"), F.sum(F.col("is_aligned").cast("long")).alias("a"))
    rows = per.groupBy(*report).agg(F.sum("n").alias("activities"), F.sum(F.col("n") - F.col("a")).alias("barren"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("a") == 0, F.col("goal")))), ",").alias("gaps"))
    joined = rows.join(pages, report, "left")
    return joined.select(*report, "activities", "pages", "barren", "gaps", F.when(F.col("pages") > 0, F.round(F.col("activities") * 100.0 / F.col("pages"), 1)).alias("per_100_pages"), grade(F.col("activities"), F.col("pages")).alias("extraction"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Of runs (status, published, activities, goals): totals and the mean of goals of those completed."""
    done = F.col("status") == "completed"
    return runs.agg(F.count("*").alias("total"), F.sum(done.cast("long")).alias("completed"), F.sum((done & F.col("published")).cast("long")).alias("published"), F.sum(F.when(done, F.col("activities"))).alias("activities"), F.round(F.avg(F.when(done, F.col("goals").cast("double"))), 6).alias("mean_goals"))


def depth(facts: DataFrame, by: str) -> DataFrame:
    """Each pair of groups in which one has more than twice the other's activities, so that comparing them needs a warning. One row a group."""
    n = facts.groupBy(by).agg(F.count("*").alias("n"))
    a, b = n.toDF("deep", "n_deep"), n.toDF("shallow", "n_shallow")
    return a.join(b, F.col("n_deep") > 2 * F.col("n_shallow")).select("deep", "shallow", F.round(F.col("n_deep") / F.col("n_shallow"), 4).alias("ratio"))


def peer_means(facts: DataFrame, group: str) -> DataFrame:
    """Mean number of goals evidenced a year by the councils of each peer group."""
    per = facts.where("is_aligned").groupBy(group, "council", "year").agg(F.count_distinct("goal").alias("goals"))
    return per.groupBy(group, "year").agg(rounded(F.sum("goals"), F.count("*"), 1).alias("mean_goals"))


def council_share(facts: DataFrame) -> DataFrame:
    """Share of all councils that have an aligned activity in any year, by goal."""
    per = facts.groupBy("council", "goal").agg(F.max(F.col("is_aligned").cast("int")).alias("hit"))
    n = facts.agg(F.count_distinct("council").alias("councils"))  # one row
    return per.groupBy("goal").agg(F.sum("hit").alias("hits")).join(F.broadcast(n), how="cross").select("goal", rounded(F.col("hits"), F.col("councils"), 1).alias("share"))


def two_reports(facts: DataFrame, first, second, above: int = 300) -> DataFrame:
    """Goal by goal the second report's mean less the first's, and whether each is over ``above`` thousandths."""
    side = lambda which, k: facts.where(which).groupBy("goal").agg(mean().alias(k))
    both = side(first, "first").join(side(second, "second"), "goal", "full").na.fill(0.0, ["first", "second"])
    return both.select("goal", "first", "second", F.round(F.col("second") - F.col("first"), 6).alias("difference"), (F.col("first") > above / 1000).alias("first_covers"), (F.col("second") > above / 1000).alias("second_covers"))


def diagnostics(facts: DataFrame, activity: str) -> DataFrame:
    """Of all scores, and of each activity's best: smallest, largest, mean, median, deviation."""
    best = facts.groupBy(activity).agg(F.max("milli").alias("milli"))
    rows = facts.select(F.lit("all").alias("of"), F.col("milli")).union(best.select(F.lit("best"), "milli"))
    n, s, q = F.count("*"), F.sum("milli"), F.sum(F.col("milli") * F.col("milli"))
    deviation = F.round(F.sqrt(spread(n, s, q)) / n, 4)
    return rows.groupBy("of").agg(n.alias("n"), F.min("milli").alias("low"), F.max("milli").alias("high"), mean().alias("mean_score"), F.median("milli").alias("median"), deviation.alias("deviation"))


def top_counts(facts: DataFrame, activity: str) -> DataFrame:
    """Per goal its largest score, and of how many activities it is the best (the lower of equal ones)."""
    best = facts.groupBy(activity).agg(F.max(F.struct("milli", (-F.col("goal")).alias("g"))).alias("x")).groupBy((-F.col("x.g")).alias("goal")).agg(F.count("*").alias("firsts"))
    return facts.groupBy("goal").agg(F.max("milli").alias("largest")).join(best, "goal", "left").na.fill({"firsts": 0})


def page(facts: DataFrame, order: str, goal: int | None = None, search: str | None = None, text: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """A page of activities, each row with how many there are in all; at most 200 a page. ``search`` is found whatever the case."""
    rows = facts
    if goal is not None:
        rows = rows.where((F.col("goal") == goal) & F.col("is_aligned"))
    if search:
        rows = rows.where(F.contains(F.lower(F.col(text)), F.lit(search.lower())))
    size = max(1, min(size, 200))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(order).offset((max(number, 1) - 1) * size).limit(size).join(F.broadcast(total), how="cross")


def by_ids(runs: DataFrame, key: str, wanted: list) -> tuple[DataFrame, DataFrame]:
    """The runs asked for, at least two, and the keys that aren't there."""
    if len(set(wanted)) < 2:
        raise ValueError("at least two runs are compared")
    asked = runs.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], f"{key} {dict(runs.dtypes)[key]}")
    return runs.join(F.broadcast(asked), key, "left_semi"), asked.join(runs.select(key), key, "left_anti")


def browse(councils: DataFrame, state: str | None = None, setting: str | None = None, name: str | None = None, year: int | None = None, extraction: str | None = None, order: str = "goals") -> DataFrame:
    """Councils (council, slug, state, setting, years, goals, extraction) that meet all filters given; sorted by goals or by name."""
    if order not in ("goals", "name"):
        raise ValueError(f"unknown order {order}")
    rows = councils
    for column, value in (("state", state), ("setting", setting), ("extraction", extraction)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if name:
        rows = rows.where(F.contains(F.lower("council"), F.lit(name.lower())))
    if year is not None:
        rows = rows.where(F.array_contains("years", year))
    return rows.orderBy(*([F.desc("goals")] if order == "goals" else []), "council")


def councils(facts: DataFrame) -> DataFrame:
    """A row for each council: slug, state, most frequent setting, years, goals evidenced, extraction by activities a year."""
    per = facts.groupBy("council", "state").agg(
        F.mode("setting", deterministic=True).alias("setting"), F.array_sort(F.collect_set("year")).alias("years"), F.count_distinct(F.when(F.col("is_aligned"), F.col("goal"))).alias("goals"), F.count("*").alias("n")
    )
    return per.select("council", T.slug(F.col("council")).alias("slug"), "state", "setting", "years", "goals", grade(F.col("n"), F.size("years") * 100).alias("extraction"))


def search_box(councils: DataFrame, typed: str, postcodes: str = "postcodes", k: int = 7) -> DataFrame:
    """The first k councils by name that have the text in their name or a postcode that starts with it."""
    hit = F.contains(F.lower("council"), F.lit(typed.lower().strip())) | F.exists(postcodes, lambda p: F.startswith(p, F.lit(typed.strip())))
    return councils.where(hit).orderBy("council").limit(k)


def peers(councils: DataFrame) -> DataFrame:
    """Pairs of councils of the same state or of the same setting."""
    a = councils.select("council", "state", "setting")
    b = a.toDF("peer", "peer_state", "peer_setting")
    same = a.join(b, F.col("state") == F.col("peer_state")).union(a.join(b, F.col("setting") == F.col("peer_setting")))
    return same.where("council <> peer").select("council", "peer").distinct()


def year_or_latest(councils: DataFrame, year: int) -> DataFrame:
    """The year asked for where a council has it, else its latest."""
    return councils.select("council", F.when(F.array_contains("years", year), year).otherwise(F.array_max("years")).alias("year"))


def published(runs: DataFrame, which, on: bool = True) -> DataFrame:
    """Runs with those that ``which`` picks published or withdrawn; only completed ones can be."""
    return runs.withColumn("published", F.when(which & (F.col("status") == "completed"), on).otherwise(F.col("published")))


def without(runs: DataFrame, which) -> DataFrame:
    """Runs without those that ``which`` picks."""
    return runs.where(~F.coalesce(which, F.lit(False)))


def swept(runs: DataFrame, older_than: str) -> DataFrame:
    """Runs left queued or processing since before a time become failed."""
    stale = F.col("status").isin("queued", "processing") & (F.col("updated") < F.lit(older_than).cast("timestamp"))
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
