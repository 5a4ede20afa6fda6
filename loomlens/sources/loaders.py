"""Files of results and labels as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import STATES


def results(spark: SparkSession, path: str, council: str | None = None, years=None, states=None) -> DataFrame:
    """JSON results, one object a file or an array of them; filters as given, the council's name in part and whatever the case."""
    rows = spark.read.json(path, multiLine=True)
    if council:
        rows = rows.where(F.contains(F.lower("council"), F.lit(council.lower())))
    if years:
        rows = rows.where(F.col("year").cast("string").isin(*map(str, years)))
    return rows.where(F.col("state").isin(*states)) if states else rows


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The values that aren't empty, sorted."""
    return rows.select(column).where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct().orderBy(column)


def csv_files(spark: SparkSession, folder: str, pattern: str = "*_alignment.csv") -> DataFrame:
    """All rows of the files of a pattern below a folder, with the name of their file."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder)
    return rows.withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def agreed_labels(spark: SparkSession, path: str, agreement: float = 0.7, n: int | None = None, seed: str = "42") -> DataFrame:
    """(text_id, text, sdg) of a tab-separated corpus: texts that aren't empty, goals 1 to 17, raters agreed at least so far; n of them in a fixed pseudo-random order."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    kept = rows.select("text_id", "text", F.col("sdg").cast("int").alias("sdg"), F.col("agreement").cast("double").alias("agreement")).where((F.trim("text") != "") & F.col("sdg").between(1, 17) & (F.col("agreement") >= agreement))
    return kept if n is None else kept.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "text_id")), "text_id").limit(n)


def wide_labels(rows: DataFrame, text: str = "Description", goals=range(1, 18)) -> DataFrame:
    """Rows with a text and any label, labels as 0 or 1 and words counted."""
    names = [f"SDG{g}" for g in goals]
    kept = rows.where(F.col(text).isNotNull() & (F.trim(text) != "")).dropna("all", subset=names)
    return kept.select(F.col(text).alias("text"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in names), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"))


def binary_labels(rows: DataFrame, goals=range(1, 18)) -> DataFrame:
    """(text, labels): the labels of wide rows as one array."""
    return rows.select("text", F.array(*(F.col(f"SDG{g}") for g in goals)).alias("labels"))


def pivoted_labels(rows: DataFrame, goals=range(1, 18)) -> DataFrame:
    """Long (text, sdg) to one row for each text with a 0 or 1 for each goal."""
    return rows.groupBy("text").agg(*(F.max((F.col("sdg") == g).cast("int")).alias(f"sdg_{g}") for g in goals))


def path_metadata(path: Column) -> dict[str, Column]:
    """Year and state from a path's directories (YYYY/STATE/), else from the file's name; setting and council from the name's parts."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")
    some = lambda c: F.nullif(c, F.lit(""))
    codes = "|".join(STATES)
    year = F.coalesce(some(F.regexp_extract(path, r"/(20\d{2})/", 1)), some(F.regexp_extract(name, r"20\d{2}", 0)))
    state = F.coalesce(some(F.regexp_extract(F.upper(path), rf"/({codes})/", 1)), some(F.regexp_extract(F.upper(name), rf"(?:^|_)({codes})(?:_|$)", 1)))
    setting = F.when(F.lower(name).contains("urban"), "Urban").when(F.lower(name).contains("rural"), "Rural")
    rest = F.filter(F.split(name, "_"), lambda p: ~F.upper(p).isin(*STATES, "URBAN", "RURAL") & ~p.rlike(r"^20\d{2}$") & (p != ""))
    return {"year": year, "state": state, "setting": setting, "council": some(F.array_join(rest, " "))}


def discovered(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below YYYY/STATE directories: path, year, state. Only names are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    found = path_metadata(F.col("path"))
    return rows.select("path", found["year"].alias("year"), found["state"].alias("state"))


def annual_report(text: Column, title: Column, keywords, least: float = 0.3) -> Column:
    """Whether enough of the keywords are there; one in the title counts a fifth, a range of years a tenth."""
    low = F.lower(text)
    hits = sum((low.contains(k).cast("int") for k in keywords), F.lit(0)) / len(keywords)
    in_title = sum((F.lower(title).contains(k).cast("int") for k in keywords), F.lit(0)) > 0
    return hits + F.when(in_title, 0.2).otherwise(0.0) + F.when(low.rlike(r"20\d{2}\s*[-–/]\s*\d{2,4}"), 0.1).otherwise(0.0) > least
