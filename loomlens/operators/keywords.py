"""Words that tell groups of texts apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(docs: DataFrame, by: list[str], text: str = "text", least: int = 4, stop=()) -> DataFrame:
    """(by..., word): lower-cased runs of letters of at least ``least``, without stop words."""
    rows = docs.select(*by, F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word"))
    return rows.where((F.length("word") >= least) & ~F.col("word").isin(*stop))


def frequent(docs: DataFrame, by: list[str], k: int, **how) -> DataFrame:
    counts = words(docs, by, **how).groupBy(*by, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


def tf_idf(docs: DataFrame, doc: str, k: int, **how) -> DataFrame:
    """The k words with the largest sum of tf * (ln((1 + N) / (1 + df)) + 1)."""
    tf = words(docs, [doc], **how).groupBy(doc, "word").agg(F.count("*").alias("tf"))
    per = tf.groupBy("word").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("docs"))  # one row
    return per.join(F.broadcast(n), how="cross").select("word", "df", F.round(F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1), 4).alias("weight")).orderBy(F.desc("weight"), "word").limit(k)


def log_odds(docs: DataFrame, flag, k: int, least: int = 3, **how) -> DataFrame:
    """Words by log((t + .5) / (T + .5)) - log((c + .5) / (C + .5)) of flagged against other texts."""
    counts = words(docs.withColumn("flag", flag), ["flag"], **how).groupBy("word").agg(F.sum(F.col("flag").cast("long")).alias("t"), F.sum((~F.col("flag")).cast("long")).alias("c"))
    totals = counts.agg(F.sum("t").alias("tt"), F.sum("c").alias("cc"))  # one row
    odds = F.log((F.col("t") + 0.5) / (F.col("tt") + 0.5)) - F.log((F.col("c") + 0.5) / (F.col("cc") + 0.5))
    return counts.join(F.broadcast(totals), how="cross").where(F.col("t") >= least).select("word", "t", "c", F.round(odds, 6).alias("log_odds")).orderBy(F.desc("log_odds"), "word").limit(k)


def pairs(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """The k most frequent pairs of neighbouring words of more than three letters."""
    w = F.split(F.lower(F.col(text)), "[^a-z]+")
    both = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.when((F.length(a) > 3) & (F.length(b) > 3), F.concat_ws(" ", a, b)))
    return docs.select(F.explode(both).alias("pair")).where("pair is not null").groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(k)


def overlap(top: DataFrame, by: str) -> DataFrame:
    """How many of their top words two groups share."""
    a, b = top.select(F.col(by).alias("a"), "word"), top.select(F.col(by).alias("b"), "word")
    return a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))

# Words that say nothing of a goal.
STOP_WORDS = (
    "and", "the", "for", "with", "from", "that", "this", "were", "been", "have", "has", "had", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "need", "also", "each", "other", "which", "their", "there", "where", "when", "than", "more", "most",
    "some", "many", "such", "only", "over", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again",
    "further", "then", "once", "here", "how", "what", "who", "why", "all", "any", "both", "but", "nor", "not", "same", "so", "very",
    "just", "now", "year", "council", "annual", "report", "including", "new", "one", "two", "first", "last", "part", "based", "within",
    "per", "cent", "total", "number", "area", "table", "figure", "page", "section", "appendix", "reference", "note",
)


def aligned_words(facts: DataFrame, text: str, k: int = 50, least_score: float = 0.5, stop=STOP_WORDS) -> DataFrame:
    """(goal, word, n, activities, rank): the k most frequent words of four letters and more in the activities aligned with each goal, with a score of ``least_score`` at least; of equal ones the first by name.

    Words are whole ones of A to Z: a run of letters beside a digit, an underscore or a letter beyond ASCII is none. activities is how many such activities the goal has.
    """
    own = facts.where(F.col("is_aligned") & (F.col("score") >= least_score))
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(?<!\w)[a-z]{4,}(?!\w)"), F.lit(0))
    counts = own.select("goal", F.explode(found).alias("word")).where(~F.col("word").isin(*stop)).groupBy("goal", "word").agg(F.count("*").alias("n"))
    per = own.groupBy("goal").agg(F.count("*").alias("activities"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(per), "goal")  # one row a goal


#: So many rows at most are sent to all tasks; more are joined by shuffling.
MOST_SENT = 500_000


def _sent(rows: DataFrame) -> DataFrame:
    """Written once; sent to all tasks if there are few."""
    rows = rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) or rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def own_words(text, least: int, stop):
    """Array of a text's words that have ``least`` letters and aren't stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def runs(words, n: int):
    """Array of the runs of ``n`` neighbouring words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def weighed_terms(docs: DataFrame, group: str, doc: str, k: int = 10, text: str = "text", vocabulary: int = 1000, most_df: float = 0.95, longest: int = 3, least: int = 4, stop=STOP_WORDS) -> DataFrame:
    """(group, term, df, weight, rank): a group's k terms with the largest sums of TF-IDF, each document's vector brought to length one.

    Terms are runs of up to ``longest`` words. Those in more than ``most_df`` of the group's documents are left out, and of the others the ``vocabulary`` most frequent make the vectors, of equal ones the first
    by name; both limits are the feature's. idf is ln((1 + N) / (1 + df)) + 1.

    Most runs stand in a text or two, so that they are not all counted. The ``vocabulary`` most frequent words that are in few enough rows set a floor: a term under it can't be among the most frequent, nor can a run
    that holds a run under it. Runs of n words are counted only where both of their runs of n - 1 words reach the floor, and what reaches it goes with its document.
    """
    words = docs.select(F.col(group).alias("g"), F.col(doc).alias("d"), own_words(F.col(text), least, stop).alias("w"))
    sizes = docs.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("docs"))
    each = lambda of, new: F.transform(of, lambda w: F.struct(w.alias("term"), F.lit(1 - new).alias("tf"), F.lit(new).alias("row")))
    single = words.select("g", F.explode(F.concat(each(F.col("w"), 0), each(F.array_distinct("w"), 1))).alias("x")).groupBy("g", "x.term").agg(F.sum("x.tf").alias("total"), F.sum("x.row").alias("rows"))
    sure = single.join(F.broadcast(sizes), "g").where(F.col("rows") <= most_df * F.col("docs"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("total"), "term"))
    floor = F.broadcast(sure.withColumn("_r", place).where(F.col("_r") == vocabulary).select("g", F.col("total").alias("floor")))  # a row a group
    high = lambda counts: counts.join(floor, "g", "left").where(F.col("total") >= F.coalesce("floor", F.lit(0))).select("g", "term")
    levels = [_sent(high(single))]
    for n in range(2, longest + 1):
        run = words.select("g", F.explode(runs(F.col("w"), n)).alias("term"))
        head, tail = F.regexp_replace("term", " [a-z]+$", ""), F.substring_index("term", " ", 1 - n)
        known = levels[-1].withColumnRenamed("term", "part")
        both = run.withColumn("part", head).join(known, ["g", "part"], "left_semi").withColumn("part", tail).join(known, ["g", "part"], "left_semi")
        levels.append(_sent(high(both.groupBy("g", "term").agg(F.count("*").alias("total")))))
    # From here on a number stands for a group's term.
    terms = _sent(reduce(DataFrame.union, (level.select("g", "term") for level in levels)).withColumn("id", F.monotonically_increasing_id()))
    found = words.select("g", "d", F.explode(F.concat(*(runs(F.col("w"), n) for n in range(1, longest + 1)))).alias("term")).join(terms, ["g", "term"]).select("d", "id")
    tf = found.groupBy("d", "id").agg(F.count("*").alias("tf"))
    per = tf.groupBy("id").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).join(terms, "id").join(F.broadcast(sizes), "g").where(F.col("df") <= most_df * F.col("docs"))
    known = _sent(per.withColumn("_r", place).where(F.col("_r") <= vocabulary).withColumn("idf", F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).select("id", "g", "term", "df", "idf"))
    vectors = tf.where("d is not null").join(known.select("id", "g", "idf"), "id").select("g", "d", "id", (F.col("tf") * F.col("idf")).alias("w"))
    scaled = vectors.withColumn("length", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("g", "d"))))
    sums = scaled.groupBy("id").agg(F.round(F.sum(F.col("w") / F.col("length")), 4).alias("weight")).join(known, "id")
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= k)
    return ranked.select(F.col("g").alias(group), "term", "df", "weight", "rank")
