"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A window of an item is a set of shingles of up to three words. A document holds a window only if it holds
all of its shingles, so that joining one of them finds every occurrence; shingles are ordered by how
rare they are in all documents, and the rarest is the window's necessary prefix. A shingle's place in the
window and the window's length bound where the occurrence may start and end. The words there are
then compared with the window's, which makes the result exact.

While there are at most MOST_SENT windows, a measured and bounded number, their prefixes are sent to the tasks
and the words compared where they are read; beyond, all joins are shuffled, and the documents with
candidates are read again for the comparison.

Nulls and edges: a null text has no words; an item without words has no window; a window of an item whose id
is null hits words but counts for no item. Equal items, and items given twice, each count by id once.
Repeated documents come back as often as they stand there; very long texts are taken whole. Only A to Z are lowered: the Kelvin
sign is no k. Without items or documents nothing is hit. Of equally rare shingles a window's
first is its prefix. ``contaminated`` leaves other columns out, whatever their names; ``clean`` keeps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native as N
from .common import prepare

WINDOW, SHINGLE = 10, 3
MOST_SENT = 200_000


def windows(items: DataFrame) -> DataFrame:
    """(item_id, window, n): distinct windows, their words joined by spaces, and how many words they have."""
    w = items.select(items["item_id"].alias("item_id"), N.exact_words(items["text"].cast("string")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    slices = F.transform(starts, lambda i: F.slice("w", i, WINDOW))
    return w.select("item_id", F.explode(slices).alias("x")).select("item_id", F.array_join("x", " ").alias("window"), F.size("x").alias("n")).distinct()


def _hashes(w: Column, n: int) -> Column:
    """Hash of each run of n words."""
    runs = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1)))
    return F.transform(runs, lambda i: F.xxhash64(*(F.get(w, i - 1 + k) for k in range(n))))


def _met(rows: DataFrame, shingles: DataFrame, lengths: list[int], carry: list[str], send: bool) -> DataFrame:
    """Places in the documents' words (pos, from 0) of the given shingles (k, h, ...)."""
    parts = []
    for k in lengths:
        wanted = shingles.where(F.col("k") == k).drop("k")
        places = rows.select(*carry, F.posexplode(_hashes(F.col("w"), k)).alias("pos", "h"))
        parts.append(places.join(F.broadcast(wanted) if send else wanted, "h"))
    return reduce(DataFrame.union, parts)


def hits(docs: DataFrame, items: DataFrame, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """(windows, hits): hits are (k1, k2, window, n, start), all occurrences of windows in documents, exactly."""
    found = windows(items).checkpoint()
    distinct = found.select("window", "n").distinct()
    lengths = [r["k"] for r in distinct.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # 1 to 3
    send = distinct.count() <= most_sent
    none = N.keyed(docs).limit(0).select(*N.KEYS, F.lit("").alias("window"), F.lit(0).alias("n"), F.lit(0).alias("start"))
    if not lengths:
        return found, none
    rows = N.keyed(docs).select(*N.KEYS, N.words(F.col("text")).alias("w"))
    of_windows = reduce(
        DataFrame.union,
        (distinct.where(F.least("n", F.lit(SHINGLE)) == k).select("window", "n", F.lit(k).alias("k"), F.posexplode(_hashes(N.words(F.col("window")), k)).alias("at", "h")) for k in lengths),
    ).checkpoint()
    wanted = of_windows.select("k", "h").distinct()
    seen = _met(rows, wanted.withColumn("own", F.col("k")), lengths, [], send).groupBy(F.col("own").alias("k"), "h").agg(F.count("*").alias("often"))
    rarest = of_windows.join(seen, ["k", "h"], "left").groupBy("window", "n", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "at", "h")).alias("x"))
    prefix = rarest.where("x.often > 0").select("k", F.col("x.h").alias("h"), F.col("x.at").alias("at"), "window", "n").checkpoint()
    start, end = F.col("pos") - F.col("at"), F.col("pos") - F.col("at") + F.col("n")
    own = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ")
    if send:
        # words() and exact_words() cut alike. For a window of ASCII this comparison is exact; others are compared again below.
        met = _met(rows, prefix, lengths, [*N.KEYS, "w"], True).withColumn("start", start).where((start >= 0) & (end <= F.size("w")))
        near = met.where(own == N.lowered(F.col("window"))).select(*N.KEYS, "window", "n", "start").distinct()
    else:
        near = _met(rows, prefix, lengths, N.KEYS, False).where(start >= 0).select(*N.KEYS, "window", "n", start.alias("start")).distinct()
    near = near.checkpoint()
    odd = F.col("window").rlike(r"[^\x00-\x7F]") if send else F.lit(True)
    sure, unsure = near.where(~odd), near.where(odd)
    texts = N.keyed(docs).join(unsure.select(*N.KEYS).distinct(), N.KEYS, "left_semi").dropDuplicates(N.KEYS).select(*N.KEYS, N.exact_words(F.col("text")).alias("w"))
    exact = unsure.join(texts, N.KEYS).where(own == F.col("window")).select(*N.KEYS, "window", "n", "start")
    return found, sure.union(exact)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans (from, to in words) of every document."""
    prepare(docs.sparkSession)
    found, got = hits(docs, items)
    got = got.checkpoint()
    spans = got.groupBy(*N.KEYS).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    names = got.select(*N.KEYS, "window").distinct().join(found.select("window", F.col("item_id").cast("string").alias("item")), "window").groupBy(*N.KEYS).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = N.keyed(docs).select(*N.KEYS, "doc_id", F.size(N.words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(spans.join(names, N.KEYS, "left"), N.KEYS, "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(covered, F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items_of.alias("items"), "spans"
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    prepare(docs.sparkSession)
    _, got = hits(docs, items)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    k1, k2 = F.xxhash64(docs["doc_id"].cast("long"), text), F.hash(text, docs["doc_id"].cast("long"))
    hit = got.select(*N.KEYS).distinct()
    return docs.join(hit, (k1 == hit["k1"]) & (k2 == hit["k2"]), "left_anti")


#: DuckDB: each run of words of a window's length against all windows.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), own AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT DISTINCT doc_id, i, own.n, item_id FROM own JOIN win USING (s, n)
), places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), names AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
"""
