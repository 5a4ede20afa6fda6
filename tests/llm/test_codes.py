import math
import random
from collections import defaultdict
from fractions import Fraction
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from loomlens.llm import codes
from loomlens.llm import common as C

SCHEMA = "vec_id long, embedding array<double>, label int, v string, state int, n long"


def brute(rows, entries=256, rounds=4):
    """Plain Lloyd in Python's integers: every part against every entry in each round."""
    ok = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in ok) // 4))
    whole = [[math.floor(Fraction(x) * 1024) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in ok]
    parts = [[w[p * width : (p + 1) * width] for w in whole] for p in range(4)]
    books = [part[:entries] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            of = defaultdict(list)
            for x in parts[p]:
                of[near(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    got = [[near(parts[p][r], books[p]) for p in range(4)] for r in range(len(ok))]
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [min(2**63 - 1, sum(d for d, _ in g)) for g in got]
    total = defaultdict(int)
    for (_, _, y), e in zip(ok, errors, strict=True):
        total[y] += e
    return [(i, "".join(f"{k:02x}" for _, k in g), e, min(2**63 - 1, total[y]), digest) for (i, _, y), g, e in zip(ok, got, errors, strict=True)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def some_rows(scale=1.0):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 7 - 3, 0.4) * scale for _ in range(10)], i % 4 if i % 9 else None) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(200)] + [(5, rows[9][1], 2), (5, rows[8][1], 2), (5, rows[8][1], 2)]
    rows += [(-3, [0.25, -0.25], 1), (2, [], None), (3001, None, 1), (3002, [1.0, None], 1), (3003, [math.nan] * 10, 1), (3004, [math.inf], 1), (None, rows[4][1], 3), (None, rows[5][1], 3)]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("entries", [256, 40])
def test_against_plain_lloyd(spark, monkeypatch, entries):
    monkeypatch.setattr(codes, "ENTRIES", entries)
    monkeypatch.setattr(codes, "BLOCK", 37)
    rows = some_rows()
    assert ordered(codes.digest(frame(spark, rows)).collect()) == ordered(brute(rows, entries))


def test_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(codes, "ENTRIES", 12)
    rows = some_rows(1e30)[::6] + [(9000, [1e300, -1e300], 1)]
    assert ordered(codes.digest(frame(spark, rows)).collect()) == ordered(brute(rows, 12))


def test_few_rows_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "MOST_LABELS", 0)
    monkeypatch.setattr(C, "SHARE", 2)
    rows = [(1, [0.1, 0.2, 0.3, 0.4], 1), (2, [0.5] * 4, 1), (3, [0.1] * 4, None)]
    assert ordered(codes.digest(frame(spark, rows)).collect()) == ordered(brute(rows))
    assert codes.digest(frame(spark, rows).limit(0)).count() == 0
    assert codes.digest(frame(spark, [(1, None, 1)])).count() == 0


def test_bounds_pass_groups_over_and_lose_nothing():
    """Ten rounds of one part beside plain Lloyd: equal entries each time, with far fewer distances."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 8)) * 30 + rng.integers(0, 12, (3000, 1)) * 400)
    x[1000:1400] = x[7]
    entries = x[:: 3000 // 256][:256].copy()
    groups = codes.grouped(entries)
    book, state, counts = codes.Codebook(entries, groups), (None, None, None), []
    for _ in range(10):
        own, dist, upper, lower, scanned = book.assign(x, *state)
        d = ((x[:, None] - book.entries) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        known = dist >= 0
        assert (dist[known] == d.min(1)[known]).all()
        packed = codes._pack_state(own, upper, lower)
        state = packed["own"].astype(np.int64), packed["upper"].astype(float), packed["lower"].astype(float)
        counts.append(scanned)
        entries = np.array([x[own == k].sum(0) // (own == k).sum() if (own == k).any() else e for k, e in enumerate(book.entries)])
        book = codes.Codebook(entries, groups, book.entries)
    assert counts[0] == x.shape[0] * 256 and counts[-1] < counts[0] / 4


def test_decoded_vectors_lie_at_the_error(spark):
    rows = [(i, [random.Random(i).uniform(-1, 1) for _ in range(8)], 0) for i in range(600)]
    coded, books = codes.compressed(frame(spark, rows))
    at = {r.vec_id: r.v for r in codes.decoded(coded, books).collect()}
    for r in coded.collect():
        want = [math.floor(x * 1024) for x in rows[r.vec_id][1]]
        assert r.error == sum((a - b) ** 2 for a, b in zip(want, at[r.vec_id], strict=True))


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    got = codes.digest(C.table(spark, "/root/testdata/sf0.001", "embeddings"))
    want = con.execute(codes.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
