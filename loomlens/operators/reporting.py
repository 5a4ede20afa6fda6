"""From texts to corrected reports in one plan: activities, their vectors, scores, corrections, boosts, and each report's goals.

Everything up to the report's sums is an expression over an activity's own row, with the goals' vectors, seventeen rows, as
constants; the only shuffle is that of the sums, which are combined before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import lines as LN
from ..functions import text as T
from . import alignment as A
from . import corrections as C
from . import extraction as EX
from .reads import GOAL_NAMES
from .rollups import rounded

DIMS = 64


def hashed_vector(text: Column, dims: int = DIMS) -> Column:
    """How often a text's words fall into each of ``dims`` buckets, by md5: a vector that any engine can make. Any other function from a text to a vector can take its place."""
    bucket = lambda w: F.pmod(F.conv(F.left(F.md5(w), F.lit(4)), 16, 10).cast("int"), F.lit(dims))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(own, lambda x: x == d)).cast("double"))
    return LN.let(F.transform(T.tokens(F.lower(text)), bucket), counts)


def goal_texts() -> dict[int, str]:
    """A goal's name and the words that boost it."""
    return {g: " ".join([name, *L.BOOSTS.get(g, ((), 0))[0]]) for g, name in GOAL_NAMES.items()}


def goal_vectors(spark, texts: dict[int, str], encode: Callable[[Column], Column]) -> dict[int, list[float]]:
    rows = spark.createDataFrame(list(texts.items()), "goal int, text string").select("goal", encode(F.coalesce("text", F.lit(""))).alias("v"))
    return {r["goal"]: list(r["v"]) for r in rows.collect()}  # one row for each goal


def scored(activities: DataFrame, goals: dict[int, list[float]], encode: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Activities with u1 to u17, their similarity to each goal, and s1 to s17, the same in four digits.

    The vector and the scores each come out of a generator of one row: the optimizer would else put their expressions in place wherever a rule reads a score.
    """
    rows = activities.select("*", F.stack(F.lit(1), encode(F.coalesce(F.col(text), F.lit("")))).alias("_v"))
    rows = rows.select("*", F.stack(F.lit(1), F.sqrt(A.dot(F.col("_v"), F.col("_v")))).alias("_own"))
    size = {g: math.sqrt(sum(x * x for x in v)) for g, v in goals.items()}
    of = [F.when((F.col("_own") > 0) & F.lit(size[g] > 0), A.dot(F.col("_v"), F.lit(v)) / (F.col("_own") * F.lit(size[g] or 1.0))).otherwise(0.0) for g, v in goals.items()]
    rows = rows.select("*", F.stack(F.lit(1), *of).alias(*(f"u{g}" for g in goals))).drop("_v", "_own")
    return rows.select("*", F.stack(F.lit(1), *(F.round(f"u{g}", 4) for g in goals)).alias(*(f"s{g}" for g in goals)))


def aligned(activities: DataFrame, goals: dict[int, list[float]], encode: Callable[[Column], Column] = hashed_vector, mode: str = "hybrid", boost: bool = True, **how) -> DataFrame:
    """Activities (text, ...) with corrected s1 to s17, a1 to a17, num_aligned, top_goal and top_score. Whether a goal is aligned is judged on the unrounded similarity; corrections and the boost work on scores in four digits."""
    rows = C.corrected(scored(activities, goals, encode), mode=mode, judged="u", **how)
    return C.summary(C.boosted(rows, mode=mode) if boost else rows).drop(*(f"u{g}" for g in goals))


def long(done: DataFrame, report: str, activity: str) -> DataFrame:
    """(report, activity, goal, score, is_aligned, is_first): is_first marks the activity's best goal."""
    cells = [c for g in C.GOALS for c in (F.lit(g), F.col(f"s{g}"), F.coalesce(f"a{g}", F.lit(False)), F.coalesce(F.col("top_goal") == g, F.lit(False)))]
    return done.select(report, activity, F.stack(F.lit(len(C.GOALS)), *cells).alias("goal", "score", "is_aligned", "is_first"))


def reported(done: DataFrame, report: str, activity: str) -> DataFrame:
    """(report, goal, activities, aligned, mean_score, coverage, is_gap, firsts): firsts are activities whose best goal it is."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    micro = F.sum(F.round(F.col("score") * 1e6).cast("long"))
    facts = long(done, report, activity).groupBy(report, "goal").agg(F.count("*").alias("activities"), n("is_aligned").alias("aligned"), rounded(micro, F.count("*"), 1_000_000).alias("mean_score"), n("is_first").alias("firsts"))
    return facts.select(report, "goal", "activities", "aligned", "mean_score", rounded(F.col("aligned"), F.col("activities"), 1).alias("coverage"), (F.col("aligned") == 0).alias("is_gap"), "firsts")


def from_texts(docs: DataFrame, report: str, encode: Callable[[Column], Column] = hashed_vector, mode: str = "hybrid", texts: dict[int, str] | None = None, **how) -> DataFrame:
    """The whole of it: a report's text to its goals. ``how`` goes to the extraction of activities."""
    goals = goal_vectors(docs.sparkSession, texts or goal_texts(), encode)
    return reported(aligned(EX.candidates(docs, report, **how), goals, encode, mode), report, "pos")
