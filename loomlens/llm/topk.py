"""Exact top-k by inner product: vectors in order of descending length, rotated, with residual bounds.

Components are floor(1024 * x). A rotation found from the vectors' second moments (their singular
vectors) moves most of a product into the first coordinates; rotating both sides changes no product. A
candidate's bound is its partial product over those coordinates plus, by Cauchy and Schwarz, the product of the two
residual lengths. Candidates stand in ranges of descending length, of RANGE vectors at most. Each query's k-th best product among
the longest vectors starts as its threshold, and it is sent only to those ranges whose longest vector can
reach that. A task holds one range and reads its queries through; within a range, a block whose longest vector can't reach
any threshold ends the work, and vectors whose bound can't reach a query's threshold are passed over. What is left is multiplied
exactly in integers. Each range sends its k best of each query on.

Nulls and edges: vectors that are null, hold a null or a number that isn't finite, or have a null vec_id take no part; an
empty vector is one of zeros, and a shorter one is filled up with zeros. Products beyond 64 bits are cut
off at their bounds. Rows that share a vec_id are candidates each, but never for a query of that id; each of their different
vectors is a query, and the k best of all of them are returned. Ties go to the smaller vec_id. Empty tables give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .packing import sql_schema

SCALE = 1024
#: Vectors in a range, longest vectors that start the thresholds, and candidates in a block.
RANGE, HEAD, BLOCK = 1 << 17, 2048, 2048
LEAD = 16

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v: array of double with whole values, norm) of the rows that take part."""
    x = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    # Multiplying by a power of two is exact; of numbers too large to have a fraction nothing is floored.
    v = F.transform("x", lambda e: F.when(F.abs(e) < 2.0**50, F.floor(e * SCALE).cast("double")).otherwise(e * SCALE))
    return x.where(~bad).select("vec_id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def _matrix(column, width: int) -> np.ndarray:
    rows = [r[:width] for r in column.to_pylist()]
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of v v^T, added up in each partition; width x width numbers from each."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.where(np.isfinite(length) & (length > 0), m / np.where(length > 0, length, 1), 0)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    sums = rows.select("v").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((width, width))
    for r in sums.collect():  # width * width numbers
        out[r["i"], r["j"]] = r["x"]
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of whole-valued rows of a with those of b, as 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(e) for e in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b))
    return np.clip(x @ y.T, -(2**63), 2**63 - 1).astype(np.int64)


class Ranged:
    """One range of candidates, longest first, and the k best of the queries read through it."""

    def __init__(self, names: np.ndarray, rows: np.ndarray, norms: np.ndarray, turn: np.ndarray, lead: int, k: int):
        self.names, self.rows, self.norms, self.turn, self.lead, self.k = names, rows, norms, turn, lead, k
        turned = rows @ turn
        self.leads, self.rest = turned[:, :lead].copy(), np.linalg.norm(turned[:, lead:], axis=1)

    def best(self, asked: np.ndarray, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the k best candidates of each query that reach its threshold."""
        norms = np.linalg.norm(queries, axis=1)
        turned = queries @ self.turn
        rest, least = np.linalg.norm(turned[:, self.lead :], axis=1), least.copy()
        found = tuple(np.empty(0, np.int64) for _ in range(3))
        for at in range(0, len(self.names), BLOCK):
            own = slice(at, at + BLOCK)
            slack = 1e-9 * (1 + norms * self.norms[at])
            open_ = np.flatnonzero(~(norms * self.norms[at] + slack < least))
            if not len(open_):
                break
            bound = turned[open_, : self.lead] @ self.leads[own].T + rest[open_, None] * self.rest[own]
            could = ~(bound + slack[open_, None] < least[open_, None]) & (self.names[own] != asked[open_, None])
            some, near = np.flatnonzero(could.any(axis=1)), np.flatnonzero(could.any(axis=0))
            if not len(some):
                continue
            got = exact(queries[open_[some]], self.rows[own][near])
            q, c = np.nonzero(could[np.ix_(some, near)] & ~(got < least[open_[some], None]))
            found = tuple(np.concatenate(x) for x in zip(found, (open_[some][q], self.names[own][near][c], got[q, c]), strict=True))
            order = np.lexsort((found[1], ~found[2], found[0]))
            found = tuple(x[order] for x in found)
            rank = np.arange(len(order)) - np.searchsorted(found[0], found[0], "left")
            last = rank == self.k - 1
            least[found[0][last]] = np.maximum(least[found[0][last]], found[2][last].astype(float))
            found = tuple(x[rank < self.k] for x in found)
        return asked[found[0]], found[1], found[2]


_ROW = "range long, query boolean, vec_id long, v array<double>, norm double, least double"


def ranged(rows: DataFrame, size: int) -> DataFrame:
    """Rows in order, with the number of their range; those of a partition are of consecutive ranges."""

    def run(batches):
        at = 0
        for b in batches:
            number = (C.part_id() << 32) + (at + np.arange(b.num_rows)) // size
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(number), *b.columns], names=["range", "vec_id", "v", "norm"])

    return rows.mapInArrow(run, "range long, vec_id long, v array<double>, norm double")


def search(vectors: DataFrame, every: int = 100, k: int = 10, size: int = RANGE, head: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    C.prepare(spark)
    rows = ranged(scaled(vectors).orderBy(F.desc("norm"), "vec_id"), size).checkpoint()
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    _, turn = np.linalg.eigh(_moments(rows, width))
    turn = turn[:, ::-1].copy()
    lead = min(LEAD, width)
    tops = sorted((r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max("norm").alias("top")).collect())  # one row for each range
    ranges, longest = np.array([r for r, _ in tops]), np.array([t for _, t in tops])
    first = rows.where(F.col("range") == int(ranges[0])).orderBy(F.desc("norm"), "vec_id").limit(head).select("vec_id", "v").toPandas()
    head_names, head_rows = first["vec_id"].to_numpy(np.int64), _matrix(pa.array(first["v"].tolist(), pa.list_(pa.float64())), width)

    def ask(batches):
        """Each query, with its first threshold, to each range that can reach it."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                names, m = own.column(0).to_numpy(), _matrix(own.column(1), width)
                scores = exact(m, head_rows).astype(float)
                scores[names[:, None] == head_names] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(head_names) >= k else np.full(len(names), -np.inf)
                norms = np.linalg.norm(m, axis=1)
                reach = norms[:, None] * longest
                q, r = np.nonzero(~(reach + 1e-9 * (1 + reach) < least[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ranges[r]), pa.array(np.ones(len(q), bool)), pa.array(names[q]), own.column(1).take(pa.array(q)), pa.array(norms[q]), pa.array(least[q])], names=["range", "query", "vec_id", "v", "norm", "least"])

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").distinct().mapInArrow(ask, _ROW)

    def run(batches):
        here, held, ready = None, [], None
        for b in batches:
            number, is_query, names = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            turns = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (is_query[1:] != is_query[:-1])])) if b.num_rows else np.empty(0, int)
            for begin, end in zip(turns, np.append(turns[1:], b.num_rows), strict=True):
                part = b.slice(begin, end - begin)
                if number[begin] != here:
                    here, held, ready = number[begin], [], None
                m = _matrix(part.column(3), width)
                if not is_query[begin]:
                    held.append((names[begin:end], m, part.column(4).to_numpy()))
                    continue
                if ready is None:
                    ready, held = Ranged(*(np.concatenate(x) for x in zip(*held, strict=True)), turn, lead, k), []
                for at in range(0, len(m), BLOCK):
                    own = slice(at, at + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ready.best(names[begin:end][own], m[own], part.column(5).to_numpy()[own])], schema=_FOUND)

    both = rows.select("range", F.lit(False).alias("query"), "vec_id", "v", "norm", F.lit(0.0).alias("least")).union(asked)
    found = both.repartition("range").sortWithinPartitions("range", "query", F.desc("norm"), "vec_id").mapInArrow(run, sql_schema(_FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", "vec_id", "score", rank.alias("rank")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB: all products of the queries with all other rows.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
