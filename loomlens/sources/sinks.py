"""Results to files: by way of Spark's writers, so that they work on any file system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_csv(facts: DataFrame, path: str, by: list[str], goals, partition_by=()) -> None:
    """One line for each activity with a column for each goal's score."""
    table = facts.groupBy(*by).pivot("goal", list(goals)).agg(F.max("score")).na.fill(0.0)
    table.select(*by, *(F.round(str(g), 4).alias(f"goal_{g}_score") for g in goals)).write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def report_json(facts: DataFrame, path: str, report: str) -> None:
    """One JSON object for each report and goal, reports kept together by partition."""
    facts.write.mode("overwrite").partitionBy(report).json(path)


def summary_text(rollup: DataFrame, path: str, report: str) -> None:
    """A text for each report: a heading and a line for each goal."""
    line = F.concat_ws(" ", F.lit("goal"), F.col("goal").cast("string"), F.lit("mean"), F.col("mean_score").cast("string"), F.lit("coverage"), F.col("coverage").cast("string"))
    lines = rollup.groupBy(report).agg(F.array_sort(F.collect_list(F.struct("goal", line.alias("line")))).alias("x"))
    lines.select(F.concat_ws("\n", F.concat(F.lit("report "), F.col(report).cast("string")), F.transform("x", lambda p: p["line"])).alias("value")).write.mode("overwrite").text(path)
