"""A corpus from raw documents to packed sequences, in stages that read what the one before wrote.

Toxic documents go; of each group of near-duplicates one stays; passages that stand elsewhere too are cut
out of the texts; documents that hold passages of the benchmark go; what is left is packed. All but the
last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlens.llm import common as C
from loomlens.llm import decontaminate, idfiles, neardup, packing, substrings, toxicity


#: So many doc_ids at most are sent to all tasks; more are joined by shuffling.
MOST_SENT = 100_000


def toxicity_stage(spark, docs, sf_dir):
    """Learns from the labels of the documents given; those that score a half or more go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels"), held_out=None))


def near_duplicate_stage(spark, docs, sf_dir):
    """One row of each group stays: that with the smallest doc_id (null comes last), then the smallest hash; of rows with equal doc_id and text any one.

    Rows go by their doc_id where it is theirs alone. Where it is null or stands more than once, they go by a negative
    hash of doc_id and text, so that just the rows that lost go. Rows without words are linked with nothing and stay.
    """
    own, odd_name = C.spare(docs.columns, "_row"), C.spare(docs.columns, "_odd")
    number, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    odd = docs.select(number.alias("o")).groupBy("o").agg(F.count("*").alias("n")).where("n > 1 or o < 0").select("o").checkpoint()
    if n_odd := odd.count():
        few = F.broadcast(odd) if n_odd <= MOST_SENT else odd
        rows = docs.join(few, number == few["o"], "left").select(*(docs[c] for c in docs.columns), (few["o"].isNotNull() | number.isNull()).alias(odd_name))
    else:
        rows = docs.withColumn(odd_name, number.isNull())
    number, text = rows["doc_id"].cast("long"), F.coalesce(rows["text"].cast("string"), F.lit(""))
    hashed = F.xxhash64(number, text).bitwiseOR(F.lit(-(1 << 63)))
    rows = rows.withColumn(own, F.when(F.col(odd_name), hashed).otherwise(number))
    found = neardup.classes(rows.select(F.col(own).alias("doc_id"), text.alias("text"))).select("doc_id", "component_id").distinct()
    named = rows.where(odd_name).select(F.col(own).alias("doc_id"), number.alias("real")).distinct()
    order = F.struct(F.col("real").isNull().alias("last"), "real", "doc_id")
    ranked = found.join(named.withColumn("odd", F.lit(True)), "doc_id", "left").withColumn("real", F.when(F.col("odd"), F.col("real")).otherwise(F.col("doc_id")))
    best = ranked.groupBy("component_id").agg(F.min(order)["doc_id"].alias("best"))
    gone = ranked.join(best, "component_id").where("doc_id <> best").select(F.col("doc_id").alias("_gone"))
    left = rows.join(gone, rows[own] == gone["_gone"], "left_anti")
    return left.where(~F.col(odd_name)).select(*docs.columns).union(left.where(odd_name).dropDuplicates([own]).select(*docs.columns))


def repeated_passage_stage(spark, docs, sf_dir):
    """Every document stays, with its repeated passages cut out."""
    return substrings.cleaned(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.clean(docs, C.table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of sequences of 2048 tokens; the last stage, so that it doesn't return documents."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers can't be put as SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := idfiles.shared_path(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
