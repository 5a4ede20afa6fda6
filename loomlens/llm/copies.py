"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are identical after deleting every space, tab, line feed, vertical tab, form feed and carriage
return. The first pass counts texts by the length of what is left, and within a length by the hash of its first PREFIX
characters; both counts come from one aggregation that is combined before it is shuffled. Only texts of a length and beginning
that stand more than once go on: the second pass reads their full content and hashes it with SHA-256, and classes of equal
hashes are the groups. Where at most MOST_SENT beginnings survive, a number that is counted beforehand, they are sent to the
tasks; beyond, texts are joined with them by shuffling, beginnings of very many texts excepted. The result is the same.
No step puts a group into one task: groups are counted by partial aggregation, and the rows of large ones stay where they are.

Nulls and edges: a null text is empty; empty texts, and texts of spaces only, are equal to each other and to nothing else. Of a
group the row with the most code points in its original text stays, then that with the smallest doc_id; a null doc_id comes
last. Rows repeated with doc_id and text are members each, and one of them stays; in ``groups`` they can't be told apart, and as many are marked kept as
stay: one. Very long texts are taken whole. Columns other than doc_id and text, whatever their names, are left out by ``groups`` and kept by
``deduplicated``. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIX = 64
MOST_SENT = 200_000

_LEVELS = ["_m", "_p"]


def bare(text: Column) -> Column:
    """What of a text counts."""
    return C.without(text, C.SPACES)


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, the text's code points, its bare text, and the first two keys of refinement."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.length(text).cast("long").alias("_n"), bare(text).alias("_t"))
    return rows.select("doc_id", "_n", "_t", F.octet_length("_t").alias("_m"), F.xxhash64(F.left("_t", F.lit(PREFIX))).alias("_p"))


def _survivors(docs: DataFrame) -> DataFrame:
    """(_m, _p, _c): lengths and beginnings of more than one text, and of how many."""
    return _read(docs).groupBy(*_LEVELS).agg(F.count("*").alias("_c")).where("_c > 1").checkpoint()


def hashed(docs: DataFrame, all_hashes: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, _n (code points), _h (SHA-256 of the bare text, as bytes) and _open (whether its length and beginning stand more than once).

    Texts that aren't open have no equals, and their full hash is null unless ``all_hashes`` is set.
    """
    live = _survivors(docs)
    rows = _read(docs)
    met = rows.join(F.broadcast(live), _LEVELS, "left") if live.count() <= most_sent else C.by_key(rows, live, _LEVELS, "_c")
    full = F.unhex(F.sha2(F.col("_t").cast("binary"), 256))
    is_open = F.col("_c").isNotNull()
    return met.select("doc_id", "_n", (full if all_hashes else F.when(is_open, full)).alias("_h"), is_open.alias("_open"))


def groups(docs: DataFrame, all_hashes: bool = True, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, and n_chars, the code points of its text.

    text_sha256 is null for texts that were told from all others before their full content was read, unless ``all_hashes`` is set.
    """
    C.prepare(docs.sparkSession)
    # The row number is fixed by the checkpoint; it tells repeated rows apart.
    rows = hashed(docs, all_hashes, most_sent).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    order = F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    found = rows.where("_open").groupBy("_h").agg(F.count("*").alias("_size"), F.min(order).alias("_best")).where("_size > 1")
    found = found.select("_h", "_size", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_stays")).checkpoint()
    grouped, single = F.col("_size").isNotNull(), rows.where("not _open").withColumns({"_size": F.lit(None).cast("long"), "_keep": F.lit(None).cast("long"), "_stays": F.lit(None).cast("long")})
    both = C.by_key(rows.where("_open"), found, ["_h"], "_size").unionByName(single)
    return both.select(
        "doc_id", F.when(grouped, F.col("_keep")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("_row") == F.col("_stays"))).alias("kept"), F.lower(F.hex("_h")).alias("text_sha256"), F.col("_n").alias("n_chars"),
    )


def _key(doc_id: Column, n: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), n.cast("string"), sha)


def deduplicated(docs: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which ``groups`` says that they stay."""
    C.prepare(docs.sparkSession)
    of = groups(docs, True, most_sent).select(_key(F.col("doc_id"), F.col("n_chars"), F.col("text_sha256")).alias("k"), "kept")
    # Rows of one key are equal but for their other columns: all of them stay, or one, or none.
    changed = of.groupBy("k").agg(F.count("*").alias("c"), F.sum(F.col("kept").cast("int")).alias("s")).where("s < c").checkpoint()
    key, held, left = (C.spare(docs.columns, x) for x in ("_key", "_count", "_left"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.withColumn(key, _key(docs["doc_id"].cast("long"), F.length(text).cast("long"), F.sha2(bare(text).cast("binary"), 256)))
    met = C.by_key(rows, changed.toDF(key, held, left), [key], held)
    return met.where(F.col(left).isNull()).unionByName(met.where(F.col(left) > 0).dropDuplicates([key])).select(*docs.columns)


#: DuckDB: groups by the SHA-256 of all bare texts.
SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256, n AS n_chars
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""
