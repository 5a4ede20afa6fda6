"""Vector code compression: product codes learned by Lloyd's rounds with Yinyang's bounds, in whole numbers.

Components are floor(1024 * x). A vector is cut into PARTS equal consecutive parts, each with a codebook of ENTRIES entries that
starts as that part of the first vectors by vec_id. In each round every part goes to its nearest entry and each entry becomes the floor of
its parts' mean; unused entries stay. Afterwards parts are assigned once more, which gives codes and errors.

A codebook's entries are clustered into groups once, from its first state. Each part carries an upper bound of the distance to its own
entry and one lower bound for each group, of the distance to any entry of the group but its own. When entries move, the upper bound grows by its entry's drift and each lower
bound shrinks by the largest drift in its group; only groups whose bound doesn't stay above the upper bound are scanned. Scanned
distances are whole numbers, so that ties are decided exactly, for the lower index; bounds are widened where they are rounded, and a group that might hold a
tie is scanned. A round reads the rows that the one before wrote, with their bounds; each task adds its parts up by entry, and the sums, one row a task and entry,
are added up by Spark. The driver holds codebooks only: PARTS * ENTRIES rows.

Numbers too large for exact sums of squares in 53 bits are computed in whole numbers of any size and without bounds. An error beyond 63 bits is given as 2^63 - 1.

Nulls and edges: vectors that are null or hold a null or a number that isn't finite are dropped. A null vec_id or label is kept; null
vec_ids come last among the first vectors, and labels that are null form one class. Rows that share a vec_id are taken in the order of their vectors, and each is a row of its own. Shorter vectors, and lengths that PARTS doesn't
divide, are filled up with zeros; an empty vector is one of zeros. With fewer than ENTRIES vectors there are as many entries as vectors. Other columns
are left out, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE = 1024
PARTS, ENTRIES, GROUPS, ROUNDS = 4, 256, 16, 4
#: Rows that a task computes on at a time.
BLOCK = 4096
MOST_LABELS = 100_000
_LONGEST = 2**63 - 1
#: Distances are looked up by distance * _PLACES + index, so that ties go to the lower index.
_PLACES = 256
_FAR = np.int64(_LONGEST)

_ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("state", pa.binary())])
_SUM = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_BIG = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.string())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>"}


def sql_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


class Shape:
    """How rows are packed: the width of a part, and whether its numbers are small enough for the fast way."""

    def __init__(self, longest: int, top: float):
        self.width = max(1, -(-longest // PARTS))
        # |x|^2 - 2xy + |y|^2 and a place beside it must fit: 4 * width * top^2 * _PLACES < 2^63, and without the place 2^53.
        self.small = 4 * self.width * max(top, 1.0) * max(top, 1.0) < 2.0**53
        self.kind = "<i2" if top < 2**15 else "<i4"

    def pack(self, rows: list[list[float]]) -> list[bytes]:
        full = self.width * PARTS
        if self.small:
            out = np.zeros((len(rows), full))
            for i, r in enumerate(rows):
                out[i, : len(r)] = r
            whole = np.floor(out * SCALE).astype(self.kind)
            return [r.tobytes() for r in whole]
        return [",".join(str(_floor(x)) for x in [*r, *[0.0] * (full - len(r))]).encode() for r in rows]

    def unpack(self, rows: list[bytes]) -> np.ndarray:
        """(row, part, position), as whole float64 or as Python's integers."""
        if self.small:
            return np.frombuffer(b"".join(rows), self.kind).astype(float).reshape(len(rows), PARTS, self.width)
        out = np.empty((len(rows), PARTS * self.width), object)
        for i, r in enumerate(rows):
            out[i] = [int(x) for x in r.split(b",")]
        return out.reshape(len(rows), PARTS, self.width)


def _floor(x: float) -> int:
    """floor(1024 x) without overflow."""
    return math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: int64, or Python's integers if these are given."""
    if x.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in x], object).reshape(len(x), len(entries))
    got = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    return got.astype(np.int64)


def grouped(entries: np.ndarray, n: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry, by a few rounds of Lloyd's method on the entries themselves."""
    e = entries.astype(float)
    n = min(n, len(e))
    centres = e[np.linspace(0, len(e) - 1, n).astype(int)]
    for _ in range(rounds):
        near = ((e[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([e[near == g].mean(0) if (near == g).any() else centres[g] for g in range(n)])
    return near


class Codebook:
    """One part's entries, those of the round before, and the groups."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.members = entries, [np.flatnonzero(groups == g) for g in range(GROUPS)]
        self.group = groups
        if before is not None and entries.dtype != object:
            self.drift = np.sqrt(((entries - before) ** 2).sum(1))
            self.most = np.array([self.drift[m].max(initial=0) for m in self.members])

    def assign(self, x: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """(entry, squared distance, upper, lower, scanned): the nearest entries, and how many distances were computed.

        Squared distances are given where they were computed, else -1.
        """
        n = len(x)
        if own is None:
            best = np.full(n, _FAR)
            upper, lower = np.full(n, np.inf), np.zeros((n, GROUPS))
            lower[:, [not len(m) for m in self.members]] = np.inf
            open_ = np.arange(n)
            own = np.zeros(n, np.int64)
            scanned = 0
        else:
            upper = upper + self.drift[own]
            lower = np.maximum(lower - self.most, 0)
            best = np.full(n, -1, np.int64)
            open_ = np.flatnonzero(~(lower.min(1) > upper))
            diff = x[open_] - self.entries[own[open_]]
            exact = (diff * diff).sum(1).astype(np.int64)
            best[open_] = exact * _PLACES + own[open_]
            upper[open_] = _up(np.sqrt(exact.astype(float)))
            open_ = open_[~(lower[open_].min(1) > upper[open_])]
            scanned = len(exact)
        first, second = np.full((len(open_), GROUPS), _FAR), np.full((len(open_), GROUPS), _FAR)
        seen = np.zeros((len(open_), GROUPS), bool)
        for g, members in enumerate(self.members):
            at = np.flatnonzero(~(lower[open_, g] > upper[open_])) if len(members) else []
            if not len(at):
                continue
            key = distances(x[open_[at]], self.entries[members]) * _PLACES + members
            scanned += key.size
            seen[at, g] = True
            if len(members) > 1:
                key = np.partition(key, 1, axis=1)
                second[at, g] = key[:, 1]
            first[at, g] = key[:, 0]
        if len(open_):
            old = best[open_]
            won = np.minimum(old, first.min(1))
            rest = np.where(first == won[:, None], second, first)
            bound = np.where(rest == _FAR, np.inf, np.sqrt((rest // _PLACES).astype(float)))
            lower[open_] = np.where(seen, _down(bound), lower[open_])
            # An entry that was left counts again in its group, if that wasn't scanned.
            left = np.flatnonzero((won != old) & (old != _FAR))
            g = self.group[own[open_[left]]]
            unseen = ~seen[left, g]
            left, g = left[unseen], g[unseen]
            at = open_[left]
            lower[at, g] = np.minimum(lower[at, g], _down(np.sqrt((old[left] // _PLACES).astype(float))))
            best[open_] = won
            own = own.copy()
            own[open_] = won % _PLACES
            upper[open_] = _up(np.sqrt((won // _PLACES).astype(float)))
        return own, np.where(best >= 0, best // _PLACES, -1), upper, lower, scanned


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 2.0**-20)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 2.0**-20)


_STATE = np.dtype([("own", "u1"), ("upper", "<f4"), ("lower", "<f4", (GROUPS,))])


def _pack_state(own, upper, lower) -> np.ndarray:
    """Bounds are widened before they are cut to 32 bits."""
    out = np.empty(len(own), _STATE)
    out["own"], out["upper"], out["lower"] = own, _up(upper), _down(lower)
    return out


def assigned(x: np.ndarray, state: list[bytes], books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, int]:
    """(states, one for each row and part; entries' squared distances where they were computed; distances computed)."""
    out, dist, total = np.empty((len(x), PARTS), _STATE), np.full((len(x), PARTS), -1, np.int64), 0
    held = np.frombuffer(b"".join(state), _STATE).reshape(len(x), PARTS) if state and state[0] else None
    for p, book in enumerate(books):
        s = None if held is None else held[:, p]
        given = (None, None, None) if s is None else (s["own"].astype(np.int64), s["upper"].astype(float), s["lower"].astype(float))
        own, dist[:, p], upper, lower, scanned = book.assign(x[:, p], *given)
        out[:, p] = _pack_state(own, upper, lower)
        total += scanned
    return out, dist, total


def _nearest(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances by whole numbers of any size."""
    got = [[min((d, i) for i, d in enumerate(row)) for row in distances(x[:, p], b.entries)] for p, b in enumerate(books)]
    own = np.array([[i for _, i in part] for part in got], np.int64).T.reshape(len(x), PARTS)
    return own, np.array([[d for d, _ in part] for part in got], object).T.reshape(len(x), PARTS)


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x: array of double) of the rows that are kept."""
    x = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[embedding].cast("array<double>").alias("x")).where("x is not null")
    return x.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))))


def _blocks(batches):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def _packed(rows: DataFrame, shape: Shape) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shape.pack(b.column(2).to_pylist()), pa.binary()), pa.array([b""] * b.num_rows, pa.binary())], schema=_ROW)

    return rows.mapInArrow(run, sql_schema(_ROW))


def _round(rows: DataFrame, shape: Shape, books: list[Codebook]) -> DataFrame:
    """The rows with their new entries and bounds."""

    def run(batches):
        for b in _blocks(batches):
            x = shape.unpack(b.column(2).to_pylist())
            if shape.small:
                state, _, _ = assigned(x, b.column(3).to_pylist(), books)
                packed = [r.tobytes() for r in state]
            else:
                packed = [r.tobytes() for r in _nearest(x, books)[0].astype("u1")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())], schema=_ROW)

    return rows.mapInArrow(run, sql_schema(_ROW))


def _own(state: list[bytes], shape: Shape) -> np.ndarray:
    if shape.small:
        return np.frombuffer(b"".join(state), _STATE).reshape(len(state), PARTS)["own"].astype(np.int64)
    return np.frombuffer(b"".join(state), "u1").reshape(len(state), PARTS).astype(np.int64)


def _moved(rows: DataFrame, shape: Shape, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floor of the mean of its parts; added up in the tasks, then by Spark."""
    schema = _SUM if shape.small else _BIG

    def run(batches):
        n = np.zeros((PARTS, ENTRIES), np.int64)
        sums = np.full((PARTS, ENTRIES, shape.width), 0, np.int64 if shape.small else object)
        for b in _blocks(batches):
            x, own = shape.unpack(b.column(2).to_pylist()), _own(b.column(3).to_pylist(), shape)
            for p in range(PARTS):
                n[p] += np.bincount(own[:, p], minlength=ENTRIES)
                if shape.small:
                    for i in range(shape.width):
                        # Whole numbers below 2^24 in blocks of 4096: exact in a double.
                        sums[p, :, i] += np.bincount(own[:, p], weights=x[:, p, i], minlength=ENTRIES).astype(np.int64)
                else:
                    np.add.at(sums[p], own[:, p], x[:, p])
        part, entry = np.nonzero(n)
        found = sums[part, entry]
        told = pa.array(found.tolist(), pa.list_(pa.int64())) if shape.small else pa.array([",".join(map(str, s)) for s in found], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), told], schema=schema)

    told = rows.mapInArrow(run, sql_schema(schema))
    if shape.small:
        got = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(shape.width))).alias("sums"))
    else:

        def add(t: pa.Table) -> pa.Table:
            total = [sum(x) for x in zip(*([int(v) for v in s.split(",")] for s in t["sums"].to_pylist()), strict=True)]
            return pa.table([t["part"][:1], t["entry"][:1], pa.array([sum(t["n"].to_pylist())], pa.int64()), pa.array([",".join(map(str, total))])], schema=_BIG)

        got = told.groupBy("part", "entry").applyInArrow(add, sql_schema(_BIG))
    out = [b.copy() for b in books]
    for r in got.collect():  # a row for each part and entry
        s = r["sums"] if shape.small else [int(v) for v in r["sums"].split(",")]
        out[r["part"]][r["entry"]] = [v // r["n"] for v in s]
    return out


def learned(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Shape, list[Codebook]]:
    """(packed rows with the state of the last round, how they are packed, codebooks for the last assignment)."""
    C.prepare(vectors.sparkSession)
    kept = scaled(vectors)
    top = F.array_max(F.transform("x", lambda e: F.abs(e)))
    longest, most = kept.agg(F.max(F.size("x")), F.max(top)).first()
    shape = Shape(longest or 0, (most or 0.0) * SCALE + 1)
    first = [r["x"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()]  # so many rows at most
    entries = list(np.swapaxes(shape.unpack(shape.pack(first)), 0, 1)) if first else [np.zeros((0, shape.width))] * PARTS
    rows = _packed(kept, shape).checkpoint()
    groups = [grouped(e) for e in entries] if first and shape.small else [np.zeros(len(e), int) for e in entries]
    books = [Codebook(e, g) for e, g in zip(entries, groups, strict=True)]
    for _ in range(rounds if first else 0):
        rows = _round(rows, shape, books).checkpoint()
        entries = _moved(rows, shape, before := entries)
        books = [Codebook(e, g, b) for e, g, b in zip(entries, groups, before, strict=True)]
    return rows, shape, books


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.binary()), ("error", pa.int64())])


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code: one byte a part, error) of every kept row, and the codebooks."""
    rows, shape, books = learned(vectors, rounds)

    def run(batches):
        for b in _blocks(batches):
            x, state = shape.unpack(b.column(2).to_pylist()), b.column(3).to_pylist()
            if shape.small:
                got, dist, _ = assigned(x, state, books)
                own = got["own"].astype(np.int64)
                for p in range(PARTS):
                    unknown = np.flatnonzero(dist[:, p] < 0)
                    diff = x[unknown, p] - books[p].entries[own[unknown, p]]
                    dist[unknown, p] = (diff * diff).sum(1).astype(np.int64)
                error = dist.sum(1)
            else:
                own, dist = _nearest(x, books)
                error = np.array([min(_LONGEST, sum(d)) for d in dist], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in own.astype("u1")], pa.binary()), pa.array(error)], schema=_CODED)

    return rows.mapInArrow(run, sql_schema(_CODED)), [b.entries for b in books]


def decoded(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, v): the whole-numbered vectors that the codes stand for."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            own = np.frombuffer(b"".join(b.column(1).to_pylist()), "u1").reshape(b.num_rows, PARTS)
            v = np.concatenate([books[p][own[:, p]] for p in range(PARTS)], axis=1) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(x) for x in r] for r in v], pa.list_(pa.float64()))], schema=schema)

    return coded.select("vec_id", "code").mapInArrow(run, sql_schema(schema))


def codebooks_hash(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def digest(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code in hex, error, label_error and codebooks_sha256 of every kept row."""
    rows, books = compressed(vectors, rounds)
    rows = rows.select("vec_id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("l"), F.lower(F.hex("code")).alias("code"), "error").checkpoint()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    totals = rows.groupBy("l").agg(total.alias("label_error"), F.count("*").alias("n")).checkpoint()
    met = rows.join(F.broadcast(totals), "l") if totals.count() <= MOST_LABELS else C.by_key(rows, totals, ["l"], "n")
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """DuckDB: every part against every entry, in each round."""
    parts = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS (SELECT (max(len(e)) + 3) // 4 AS w FROM v)",
        "p AS (SELECT r, k AS part, list_transform(range(k * w + 1, k * w + w + 1), lambda i: coalesce(e[i], 0)) AS x FROM v, w, (SELECT unnest(range(0, 4)) AS k))",
        "c0 AS (SELECT part, r - 1 AS i, x FROM p WHERE r <= 256)",
    ]
    for k in range(rounds + 1):
        parts.append(f"d{k} AS (SELECT p.r, p.part, c.i, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c ON p.part = c.part)")
        parts.append(f"a{k} AS (SELECT r, part, arg_min(i, (d, i)) AS i, min(d) AS d FROM d{k} GROUP BY 1, 2)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT a.part, a.i, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS y FROM a{k} a JOIN p USING (r, part), w, (SELECT unnest(range(1, 1025)) AS j) WHERE j <= w GROUP BY 1, 2, 3)")
            parts.append(f"m{k} AS (SELECT part, i, list(y ORDER BY j) AS y FROM s{k} GROUP BY 1, 2)")
            parts.append(f"c{k + 1} AS (SELECT part, i, coalesce(y, x) AS x FROM c{k} LEFT JOIN m{k} USING (part, i))")
    end = f"""h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, i)) AS codebooks_sha256 FROM c{rounds}),
t AS (SELECT r, string_agg(format('{{:02x}}', i), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN t USING (r), h"""
    return "WITH " + ",\n".join(parts) + ",\n" + end


SQL = sql()
