"""Report files: what their names, pages and extractions tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: State codes that a file's name may hold.
STATES = ("NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT")

#: The order in which they are looked for in a file's name.
FOUND_IN_ORDER = ("VIC", "NSW", "QLD", "WA", "SA", "TAS", "ACT", "NT")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def file_metadata(name: Column) -> dict[str, Column]:
    """Year, state, council and setting that a file's name tells, or nulls.

    The first year 20xx, the first state code that the name has anywhere, urban before rural; a name that begins
    STATE_Council_Setting_YEAR is taken at its word instead.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    strict = lambda k: some(F.regexp_extract(name, r"(?i)^([A-Z]{2,3})_([^_]+)_(Urban|Rural|nan)_([0-9]{4})", k))
    upper, state = F.upper(name), F.lit(None).cast("string")
    for code in reversed(FOUND_IN_ORDER):
        state = F.when(upper.contains(code), code).otherwise(state)
    setting = F.when(upper.contains("URBAN"), "Urban").when(upper.contains("RURAL"), "Rural")
    return {"year": F.coalesce(strict(4), some(F.regexp_extract(name, r"20\d{2}", 0))), "state": F.coalesce(F.upper(strict(1)), state), "council": strict(2), "setting": F.coalesce(strict(3), setting)}


def better_extraction(first: Column, second: Column, pages: Column, thin: int = 200, gain: float = 1.5) -> Column:
    """The second text if the first is thin for its pages and the second is longer by the gain."""
    a, b = F.length(F.coalesce(first, F.lit(""))), F.length(F.coalesce(second, F.lit("")))
    return F.when((a < thin * pages) & (b > gain * a), second).otherwise(first)


def needs_ocr(pages: DataFrame, by: str, text: str = "text", images: str = "images", least: int = 30, share: float = 0.3) -> DataFrame:
    """Documents of whose pages at least a share have little text and an image."""
    poor = (F.length(F.coalesce(F.col(text), F.lit(""))) < least) & (F.col(images) >= 1)
    return pages.groupBy(by).agg((F.avg(poor.cast("double")) >= share).alias("needs_ocr"))


def financial_start(pages: DataFrame, by: str, pos: str, passes: list[Column]) -> DataFrame:
    """The first page that the first of several detectors, in order, finds; null if none does."""
    return pages.groupBy(by).agg(F.coalesce(*(F.min(F.when(p, F.col(pos))) for p in passes)).alias("start"))


def sections(lines: DataFrame, by: str, pos: str, line: str, heading: Column) -> DataFrame:
    """Lines between headings: each line has the number of headings up to it."""
    along = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.sum(heading.cast("int")).over(along))
    return rows.groupBy(by, "section").agg(F.min(pos).alias("start_line"), F.max(pos).alias("end_line"), F.min_by(line, pos).alias("title"))
