"""Toxicity: a second-order factorization machine over hashed terms.

A text's terms are its words and their beginnings of four to six bytes, hashed. Of the terms seen in
labelled rows two kinds are kept: those that tell most about the label on their own, so that a long text isn't drowned by
chance words, and the most frequent others, so that a term which tells something only beside another, such as the mention of a
group, has its vector too. The machine has a weight for each kept term and a vector whose inner products weigh
pairs of terms; a term counts once a text. Terms are counted in Spark; the machine is fitted by Adam on the driver, on the kept
terms of a bounded sample of labelled rows, in the order of their ids, so that partitions don't change it. It scores every whole text.

Nulls and edges: a null or empty text has the score of no terms; very long texts are taken whole; a null label or doc_id is not
learned from; a null doc_id is scored as it is. Labels given twice count twice, and so do repeated rows in learning; they are scored as
often as they stand there. An empty table gives no row. Without any labelled row, or with
labels of one kind only, every text scores that kind's share (0 without rows).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import batches_of, sql_schema

#: Labels learned from at most: those with the smallest hashes of doc_id.
MOST_LABELLED = 20_000
BUCKETS, FACTORS, ROUNDS, LEAST_STEPS = 1 << 22, 8, 8, 400
#: Terms kept at most for what they tell on their own, and for being frequent.
KEPT_TERMS, KEPT_FREQUENT = 8192, 4096
#: Likelihood ratio statistic at least of a term that tells on its own: what chance gives one term in ten thousand.
LEAST_TELLING = 15.0

_WORDS = re.compile(rb"[^" + C.NOT_WORD + rb"]+").findall


def terms(word: bytes) -> list[int]:
    from zlib import crc32

    return [crc32(b"w" + word) % BUCKETS, *(crc32(b"p" + word[:k]) % BUCKETS for k in (4, 5, 6) if len(word) > k)]


class Terms(dict):
    """Word to its terms, or to the places of those that are kept; emptied when full."""

    def __init__(self, places: dict[int, int] | None = None):
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 150_000:
            self.clear()
        got = terms(word)
        self[word] = got = tuple(got if self.places is None else (self.places[t] for t in got if t in self.places))
        return got

    def of(self, text: bytes) -> np.ndarray:
        found: set[int] = set()
        for got in map(self.__getitem__, set(_WORDS(text.lower()))):
            found.update(got)
        return np.fromiter(found, dtype=np.int32, count=len(found))


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the inner products of their vectors)."""

    def __init__(self, places: dict[int, int], bias: float):
        self.places, self.bias = places, bias
        self.weights = np.zeros(len(places))
        self.vectors = np.random.default_rng(7).normal(0, 0.02, (len(places), FACTORS))

    def raw(self, starts: np.ndarray, items: np.ndarray):
        """Of the rows whose terms are items[starts[i]:starts[i + 1]]; also the sums of their vectors."""
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(starts) - 1
        linear = np.bincount(rows, self.weights[items], n)
        v = self.vectors[items]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(FACTORS)], axis=1) if n else np.zeros((0, FACTORS))
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, rows, v

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        items = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, items)[0], -30, 30)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        kinds = [np.zeros(1), np.zeros_like(self.weights), np.zeros_like(self.vectors)]
        first, second = [k.copy() for k in kinds], [k.copy() for k in kinds]
        step = 0
        for _ in range(max(rounds, -(-LEAST_STEPS * batch // max(len(rows), 1)))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                starts = np.concatenate([[0], np.cumsum([len(rows[i]) for i in own])]).astype(np.int64)
                items = np.concatenate([*(rows[i] for i in own), np.empty(0, np.int32)]).astype(np.int64)
                raw, sums, at, v = self.raw(starts, items)
                off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) / len(own)
                slopes = [np.array([off.sum()]), np.bincount(items, off[at], len(self.weights)) + decay * self.weights, decay * self.vectors]
                each = off[at][:, None] * (sums[at] - v)
                for f in range(FACTORS):
                    slopes[2][:, f] += np.bincount(items, each[:, f], len(self.weights))
                step += 1
                for k, g in enumerate(slopes):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    kinds[k] = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                self.bias -= float(kinds[0][0])
                self.weights -= kinds[1]
                self.vectors -= kinds[2]


def labelled(docs: DataFrame, labels: DataFrame, most: int, held_out: int | None) -> DataFrame:
    """(y, doc_id, text) of the labels with the smallest hashes, whose crc32(doc_id) modulo ``held_out`` isn't 0."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("long").alias("y")).where("doc_id is not null and y in (0, 1)")
    if held_out:
        known = known.where(C.crc_bucket(F.col("doc_id"), held_out) != 0)
    n, at = known.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # No more rows than needed reach the sort: six deviations over the expected number.
    few = known if n <= most else known.where(at < int((1 << 40) * min(1.0, (most + 6 * most**0.5) / n))).orderBy(at, "doc_id", "y").limit(most)
    return C.text_bytes(docs).join(F.broadcast(few), "doc_id").select("y", "doc_id", "text")  # at most ``most`` rows of 16 bytes are sent


def kept_terms(rows: DataFrame, telling: int = KEPT_TERMS, frequent: int = KEPT_FREQUENT, least: float = LEAST_TELLING) -> tuple[list[int], list[float]]:
    """The kept terms, and how many rows of each label there are. Counts are added up in the tasks, then by term."""

    def count(batches):
        held, n = Terms(), np.zeros((2, BUCKETS), np.int32)
        rows = np.zeros(2, np.int64)
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                n[y, held.of(text)] += 1  # a text has each of its terms once
                rows[y] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0, at], rows[0]).astype(np.int64)), pa.array(np.append(n[1, at], rows[1]).astype(np.int64))], names=["term", "a", "b"])

    counts = rows.mapInArrow(count, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).checkpoint()
    total = counts.where("term < 0").first()
    n0, n1 = (float(total["a"]), float(total["b"])) if total else (0.0, 0.0)
    if not n0 or not n1:
        return [], [n0, n1]
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    part = lambda seen, wanted: F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g = F.round(2 * (part(a, n0 * share) + part(b, n1 * share) + part(n0 - a, n0 * (1 - share)) + part(n1 - b, n1 * (1 - share))), 9)
    able = counts.where("term >= 0 and greatest(a, b) >= 2").select("term", (F.col("a") + F.col("b")).alias("n"), F.coalesce(g, F.lit(0.0)).alias("g"))
    own = [r["term"] for r in able.where(F.col("g") >= least).orderBy(F.desc("g"), "term").limit(telling).select("term").collect()]
    # Terms of nearly every row say nothing beside another either.
    other = [r["term"] for r in able.where(~F.col("term").isin(own) & (F.col("n") < 0.9 * (n0 + n1))).orderBy(F.desc("n"), "term").limit(frequent).select("term").collect()] if frequent else []
    return own + other, [n0, n1]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, held_out: int | None = 5, **kept) -> Machine:
    """Learn from at most ``most`` labels whose crc32(doc_id) modulo ``held_out`` isn't 0 (None: from all)."""
    C.prepare(docs.sparkSession)
    rows = labelled(docs, labels, most, held_out)
    names, (n0, n1) = kept_terms(rows, **kept)
    edge = min(max(n1 / (n0 + n1) if n0 + n1 else 0.0, 1e-9), 1 - 1e-9)
    places = {int(t): i for i, t in enumerate(names)}
    machine = Machine(places, float(np.log(edge / (1 - edge))))
    if not places:
        return machine

    def read(batches):
        held = Terms(places)
        schema = pa.schema([("y", pa.int64()), ("doc_id", pa.int64()), ("terms", pa.binary())])
        yield from batches_of(((y, doc_id, np.sort(held.of(text)).astype("<u2").tobytes()) for b in batches for y, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True)), schema, lambda r: len(r[2]))

    # Kept terms only, two bytes each: however long the texts are, a row holds no more than the kept terms.
    seen = sorted((r["doc_id"], r["y"], bytes(r["terms"])) for r in rows.mapInArrow(read, "y long, doc_id long, terms binary").collect())
    machine.fit([np.frombuffer(t, "<u2").astype(np.int32) for _, _, t in seen], np.array([y for _, y, _ in seen], dtype=float))
    return machine


def _scorer(machine: Machine):
    held = Terms(machine.places)

    def score(texts: list[bytes]) -> np.ndarray:
        return np.concatenate([machine.score([held.of(t) for t in texts[a : a + 500]]) for a in range(0, len(texts), 500)]) if texts else np.empty(0)

    return score


def scored(docs: DataFrame, machine: Machine, held_out: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    C.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        score = _scorer(machine)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(score(b.column(1).to_pylist()), pa.float64())], schema=schema)

    got = C.text_bytes(docs).mapInArrow(run, sql_schema(schema))
    return got.select("doc_id", (C.crc_bucket(F.col("doc_id"), held_out) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows that score under a half, with all their columns."""
    C.prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        score = _scorer(machine)
        for b in batches:
            yield b.filter(pa.array(score([(t or "").encode() for t in b.column(at).to_pylist()]) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
