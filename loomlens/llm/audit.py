"""Filter interaction audit: what each of five filters removes, in each of their 120 orders, from signed parity sums.

A row's failures are a mask of five bits. For each part and label 32 sums are aggregated: over the rows, the sign of the parity of
the bits that the mask shares with s, for each s from 0 to 31 (the mask counts' Walsh-Hadamard transform). Sums are combined before they
are shuffled, so that the size of a part doesn't matter. Inverting the transform, with whole numbers, gives the exact number of rows
with each mask; all orders are evaluated on these 32 numbers of a part. A row that fails k filters is removed by each of them in 120 / k
orders, so that a filter's Shapley value is the sum of 120 / k over the rows that fail it.

Filters: A fewer than 200 words; B fewer than half of the words distinct; C more than two in a hundred code points are A to Z; D one of
``#$%&*|``; E the whole text is that of a row with a smaller doc_id, removed or not. Words are runs without spaces, tabs, line feeds, vertical tabs, form
feeds and carriage returns.

Nulls and edges: a null text is empty, and empty texts are equal; a null source is the part ''. A row with a null doc_id is
never smaller and has no smaller one, so that it doesn't fail E; nor do rows that repeat the smallest doc_id itself. Rows count as often as they stand there. A doc_id
given several times in ``labels`` counts as good, or toxic, if any of its rows says so; null labels say nothing. Very long texts are taken whole; other
columns are left out, whatever their names. An empty table has no parts and gives no row.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS = 200

_SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row; bit 0 is filter A."""
    spark = docs.sparkSession
    C.prepare(spark)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("t"), words(text).alias("w"))
    few = F.size("w") < LEAST_WORDS
    same = 100 * F.size(F.array_distinct("w")).cast("long") < 50 * F.size("w").cast("long")
    loud = 100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > 2 * F.length("t").cast("long")
    marks = F.col("t").rlike("[#$%&*|]")
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate((few, same, loud, marks))]
    # Texts are told apart by their SHA-256 and length; what follows works on some sixty bytes a row.
    slim = read.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("h")).checkpoint()
    first = slim.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").checkpoint()
    is_copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return C.by_key(slim, first, ["h"], "n").select("doc_id", "part", (F.col("mask") + F.when(is_copy, F.lit(1 << 4)).otherwise(F.lit(0))).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id's rows by part, mask, good and toxic, with their number n. Repeated ids, null ones too, are counted before the join."""
    some = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    known = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    no = F.lit(False)
    named = some.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    return named.union(some.where("doc_id is null").select("part", "mask", no, no, "n"))


def _sign(mask: Column, s: int | Column) -> Column:
    """1 if mask and s share an even number of bits, else -1."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(s)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, w0 to w31) of (part, mask, good, toxic, n)."""
    return rows.groupBy("part", "good", "toxic").agg(*(F.sum(F.col("n") * _sign(F.col("mask"), F.lit(s))).alias(f"w{s}") for s in range(MASKS)))


def _inverted(sums: Column) -> Column:
    """The number of rows with each mask, from the sums of all s; division by 32 leaves no rest."""
    all_ = F.sequence(F.lit(0), F.lit(MASKS - 1))
    total = lambda m: F.aggregate(all_, F.lit(0).cast("long"), lambda a, s: a + F.get(sums, s) * _sign(m, s))
    return F.transform(all_, lambda m: F.shiftright(total(m), len(FILTERS)))


def cells(sums: DataFrame) -> DataFrame:
    """part, and for all rows, good ones and toxic ones an array with the number of rows of each mask."""
    # The transform is linear, so that sums of labels add up to those of the part.
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = sums.groupBy("part").agg(*(F.array(*(F.sum(F.when(keep, F.col(f"w{s}")).otherwise(0)) for s in range(MASKS))).alias(f"_{k}") for k, keep in kinds.items()))
    return wide.select("part", *(_inverted(F.col(f"_{k}")).alias(k) for k in kinds))


def _steps() -> str:
    """Each order's steps: its letters, the step, the bit of the step's filter and the bits of those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": i + 1, "own": 1 << f, "before": sum(1 << k for k in order[:i])})
    return json.dumps(out)


def orders(found: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each."""
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = found.select("*", F.inline(steps))
    own, before = F.col("own"), F.col("before")
    all_ = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def over(column: str, wanted, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.filter(all_, wanted), F.lit(0).cast("long"), lambda a, m: a + F.get(F.col(column), m) * weight(m))

    fails, early = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~early(m)
    per_row = lambda m: (F.lit(120) / F.bit_count(m)).cast("long")
    return rows.select(
        "part", "filter_order", "step", over("n", lambda m: ~fails(m) & ~early(m)).alias("kept"), over("n", here).alias("removed"), over("n", lambda m: fails(m) & early(m)).alias("redundant"),
        F.get("n", own).alias("unique_fails"), over("good", here).alias("good_lost"), over("toxic", here).alias("toxic_lost"), over("n", fails, per_row).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return orders(cells(parity_sums(labelled(failures(docs), labels))))


#: DuckDB: each order's steps from the rows' masks, and each filter's removals added up over all orders.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), x AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), d AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM x
), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good::INT), 0) AS good, coalesce(sum(toxic::INT), 0) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a, b b, b c, b d, b e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS own, coalesce(list_sum(bits[:k - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest(range(1, 6)) AS k)
), p AS (SELECT DISTINCT part FROM m
), r AS (SELECT p.part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM p CROSS JOIN s JOIN m ON m.part = p.part GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
