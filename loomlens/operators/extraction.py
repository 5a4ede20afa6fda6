"""Activities out of whole texts: candidates, filters, confidence, relevance, and cuts over what was found.

Every step is an expression or an explode of a row's own array, so that nothing is shuffled before a text's activities are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

OPENERS = L.LEANING + L.DEPENDENT_STARTERS


def candidates(docs: DataFrame, key: str, text: str = "text", least: int = 20, most: int = 500, clean: bool = True) -> DataFrame:
    """(key, pos, text, word_count) of groups of sentences that hang together, of ``least`` to ``most`` words; pos counts from 1.

    Paragraphs with enough words are split at bullets and sentences, and leaning sentences joined to the one before; a group that is too long goes by its sentences.
    """
    source = T.clean_text(F.col(text)) if clean else F.col(text)
    words = lambda t: F.size(T.tokens(t))
    parts = docs.select(key, F.posexplode(T.paragraphs(source)).alias("_p", "_paragraph")).where(words(F.col("_paragraph")) >= least)
    split = parts.select(key, "_p", F.flatten(F.transform(T.bullets(F.col("_paragraph")), lambda s: T.sentences(s))).alias("_s"))
    groups = split.select(key, "_p", F.posexplode(T.joined_sentences(F.col("_s"), OPENERS, most)).alias("_g", "_group"))
    fits = groups.where(words(F.col("_group")) >= least)
    within = F.filter(T.sentences(F.col("_group")), lambda s: words(s).between(least, most))
    out = fits.select(key, "_p", "_g", F.posexplode(F.when(words(F.col("_group")) > most, within).otherwise(F.array("_group"))).alias("_i", "text"))
    order = Window.partitionBy(key).orderBy("_p", "_g", "_i")
    return out.select(key, F.row_number().over(order).alias("pos"), "text", words(F.col("text")).alias("word_count"))


def cleaned_candidates(docs: DataFrame, key: str, **how) -> DataFrame:
    """Candidates that pass all filters."""
    return candidates(docs, key, **how).where(T.passes(F.col("text")))


_STRICT = {k: f for k, f in T.FILTERS.items() if k != "is_generic"}


def extracted(docs: DataFrame, key: str, least_score: float = 0.5, **how) -> DataFrame:
    """Activities (key, pos, text, word_count, confidence, has_action_verb, relevance, section) with a relevance of at least ``least_score``, ranked in each text."""
    rows = candidates(docs, key, **how).where(T.passes(F.col("text"), _STRICT))
    return scored(rows.select("*", F.stack(F.lit(1), T.simple_confidence(F.col("text"))).alias("confidence")), key, least_score)


def gated(found: DataFrame, key: str, least: float = 0.7, least_score: float = 0.5, verb: bool = True) -> DataFrame:
    """The same from candidates that a classifier has judged (is_activity, confidence): those it is sure of, with an action verb."""
    rows = found.where(F.col("is_activity") & (F.col("confidence") >= least))
    return scored(rows.where(T.has_action_verb(F.col("text"))) if verb else rows, key, least_score)


def scored(rows: DataFrame, key: str, least_score: float) -> DataFrame:
    score = F.round(0.6 * F.col("confidence") + 0.4 * T.relevance(F.col("text"), L.GOAL_TERMS), 4)
    # Out of a generator of one row, as the condition would else be put before the column and work the score out a second time.
    kept = rows.select("*", F.stack(F.lit(1), score).alias("relevance")).where(F.col("relevance") >= least_score)
    order = Window.partitionBy(key).orderBy(F.desc("relevance"), "pos")
    return kept.select(key, "pos", "text", "word_count", "confidence", (F.col("confidence") >= 0.7).alias("has_action_verb"), "relevance", T.section_type(F.col("text")).alias("section"), F.row_number().over(order).alias("rank"))


def filtered(activities: DataFrame, least_words: int | None = None, most_words: int | None = None, least_score: float | None = None, sections=None) -> DataFrame:
    """Activities that meet all limits given."""
    rows = activities
    for limit, keep in ((least_words, lambda x: F.col("word_count") >= x), (most_words, lambda x: F.col("word_count") <= x), (least_score, lambda x: F.col("relevance") >= x), (sections, lambda x: F.col("section").isin(*x))):
        rows = rows if limit is None else rows.where(keep(limit))
    return rows


def top(activities: DataFrame, n: int = 50, least_score: float = 0.5) -> DataFrame:
    """Each text's n best."""
    return activities.where((F.col("relevance") >= least_score) & (F.col("rank") <= n))


def by_section(activities: DataFrame, key: str) -> DataFrame:
    return activities.groupBy(key, "section").agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 2).alias("mean_words"), F.round(F.avg("relevance"), 4).alias("mean_relevance"))


def summary(activities: DataFrame, key: str) -> DataFrame:
    """Per text: activities, mean words, mean relevance, and how many have an action verb."""
    return activities.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 2).alias("mean_words"), F.round(F.avg("relevance"), 4).alias("mean_relevance"), F.sum(F.col("has_action_verb").cast("long")).alias("with_verb"))


def first_failure(text: Column, filters=T.FILTERS) -> Column:
    """The name of the first filter that rejects a text, or null."""
    out = F.lit(None).cast("string")
    for name, f in reversed(list(filters.items())):
        out = F.when(f(text), name).otherwise(out)
    return out


def failures(rows: DataFrame, text: str = "text") -> DataFrame:
    """How many texts each filter is the first to reject; 'passed' for the others."""
    return rows.groupBy(F.coalesce(first_failure(F.col(text)), F.lit("passed")).alias("outcome")).agg(F.count("*").alias("n"))


def tiers(rows: DataFrame, by: str) -> DataFrame:
    """Counts and shares of each tier within a group, from columns is_activity and is_council."""
    counts = rows.groupBy(by, T.rating(F.col("is_activity"), F.col("is_council")).alias("tier")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 4))
