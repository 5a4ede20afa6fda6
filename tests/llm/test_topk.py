import math
import random

import duckdb
import numpy as np
import pytest

from loomlens.llm import common as C
from loomlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, v string, norm int"


def brute(rows, every, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("size", "head"), [(4096, 2048), (9, 5), (40, 100)])
def test_against_brute_force(spark, monkeypatch, size, head):
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 + (i % 5 == 0) * 3) * (2 if d < 3 else 0.3) for d in range(20)]) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 3), (2003, [float("inf")]), (None, [9.0] * 20), (2010, []), (2011, [0.0] * 20), (2012, [3.0] * 4), (-10, [2.0] * 20)]
    rows = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, topk.search(frame, 10, 6, size=size, head=head).collect()))
    assert got == brute(rows, 10, 6)


def test_best_of_a_range_in_small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 5)
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = np.floor(rng.normal(0, 3, (60, 6)))
        m = m[np.argsort(-np.linalg.norm(m, axis=1))]
        names, q = rng.permutation(60), np.floor(rng.normal(0, 3, (8, 6)))
        asked, least = rng.permutation(60)[:8], rng.choice([-np.inf, 0.0, 20.0], 8)
        got = topk.Ranged(names, m, np.linalg.norm(m, axis=1), np.linalg.qr(rng.normal(size=(6, 6)))[0], 3, 4).best(asked, q, least)
        want = []
        for a, x, t in zip(asked, q, least, strict=True):
            want += [(a, i, -s) for s, i in sorted((-int(x @ y), i) for y, i in zip(m, names, strict=True) if i != a and x @ y >= t)[:4]]
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_few_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, -1.0], "x", 1), (3, [0.5, 0.5], "y", 2), (4, [1e30, 1e30], "y", 2)], SCHEMA)
    got = topk.search(frame).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 3), (2, 4)]
    assert topk.search(frame.limit(0)).count() == 0 and topk.search(frame.where("vec_id = 3")).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    got = topk.search(C.table(spark, "/root/testdata/sf0.001", "embeddings"))
    want = con.execute(topk.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
