"""Quality: importance resampling with hashed n-gram models.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. A generative model
(one probability for each bucket) is counted over the target texts, those labelled good, and over all
raw texts. A document's log weight is the log ratio of its probability under the two; adding Gumbel
noise, drawn from a hash of doc_id, and taking the k largest samples k documents without replacement
in proportion to their weights. k is a share of all documents; by default the share of good labels.

Nulls: a null text is empty (log weight 0); null labels and doc_ids aren't learned from. Rows with equal
keys rank by doc_id, then by text length. Repeated rows are candidates each. An empty table gives no row; without
good labels every log weight is 0. Very long texts are taken whole. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import sql_schema

#: Target rows read at most, chosen by a hash of doc_id. The raw model counts all documents.
MOST_TARGET = 20_000
BUCKETS = 1 << 15
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+").findall


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from zlib import crc32

        if len(self) >= 400_000:
            self.clear()
        self[word] = got = crc32(word)
        return got


def grams(text: bytes, held: Hashes) -> np.ndarray:
    """Buckets of the words as written (case counts: shouting tells), and of pairs of neighbours."""
    ones = np.array(list(map(held.__getitem__, _WORDS(text))), dtype=np.uint64)
    twos = ones[:-1] * np.uint64(0x9E3779B1) + ones[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    return (np.concatenate([ones, (twos >> np.uint64(7))]) % np.uint64(BUCKETS)).astype(np.int64)


def models(docs: DataFrame, labels: DataFrame, most: int = MOST_TARGET) -> tuple[np.ndarray, float]:
    """log(p_target / p_raw) of each bucket, and the share of good labels."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    n, good = known.agg(F.count("*"), F.sum("y")).first()
    good = good or 0
    target = known.where("y = 1").select("doc_id").distinct()
    if good > most:
        target = target.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / good)))
    target = target.limit(most).withColumn("good", F.lit(True))  # a bounded number of rows

    def count(batches):
        held, raw, own = Hashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, is_target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.bincount(grams(text, held), minlength=BUCKETS)
                raw += c
                if is_target:
                    own += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(own[at])], names=["bucket", "raw", "own"])

    rows = C.text_bytes(docs).join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(count, "bucket long, raw long, own long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).collect()
    raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:  # one row for each bucket
        raw[r["bucket"]], own[r["bucket"]] = r["raw"], r["own"]
    if not own.sum():
        return np.zeros(BUCKETS), 1.0
    smooth = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS))
    return smooth(own) - smooth(raw), good / n


def weighted(docs: DataFrame, ratio: np.ndarray, seed: int = 17) -> DataFrame:
    """doc_id, n_grams, log_weight and key of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()), ("key", pa.float64())])

    def run(batches):
        from hashlib import blake2b

        held = Hashes()
        for b in batches:
            names = b.column(0).to_pylist()
            got = [grams(t, held) for t in b.column(1).to_pylist()]
            weight = [float(ratio[g].sum()) for g in got]
            noise = [(int.from_bytes(blake2b(f"{seed} {i}".encode(), digest_size=7).digest()) + 0.5) / 2**56 for i in names]
            keys = [w - math.log(-math.log(u)) for w, u in zip(weight, noise, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(g) for g in got], pa.int64()), pa.array(weight, pa.float64()), pa.array(keys, pa.float64())], schema=schema)

    return C.text_bytes(docs).mapInArrow(run, sql_schema(schema))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, rank (from 1, by descending key) and kept (rank within the sample)."""
    C.prepare(docs.sparkSession)
    ratio, good = models(docs, labels)
    rows = weighted(docs, ratio).checkpoint()
    k = math.ceil((good if share is None else share) * rows.count())
    ranked = rows.orderBy(F.desc("key"), "doc_id", "n_grams")

    def number(batches):
        part, at = C.part_id(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=["doc_id", "n_grams", "log_weight", "key", "part", "at"])
            at += n

    placed = ranked.mapInArrow(number, "doc_id long, n_grams long, log_weight double, key double, part long, at long").checkpoint()
    base = C.bases(placed.withColumn("one", F.lit(1)), ["part"], "one")
    rank = F.col("base") + F.col("at") + 1
    return placed.join(F.broadcast(base), "part").select("doc_id", "n_grams", "log_weight", "key", rank.alias("rank"), (rank <= k).alias("kept"))
