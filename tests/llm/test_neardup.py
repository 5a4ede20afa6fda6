import random

import duckdb
import numpy as np
import pytest

from loomlens.llm import common as C
from loomlens.llm import neardup

SCHEMA = "doc_id long, text string, n long, rep string"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def classes(spark, rows, **sizes):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs, **sizes).collect()}


def corpus(seed, n, groups):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(n // groups):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(999)}"
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = [*corpus(1, 160, 20), (1000, None), (1001, ""), (1002, "a b"), (1003, "A B"), (1004, "É b"), (1005, "é b"), (1006, " \t\n")]
    assert classes(spark, rows) == brute(rows)


def test_large_buckets_lose_no_link(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [*corpus(2, 60, 2), *((500 + i, shared + " " + " ".join(f"q{i // 2}x{k}" for k in range(12 + i % 3))) for i in range(30))]
    want = brute(rows)
    for sizes in ({"most_all": 2, "block": 3, "others": 2}, {"most_all": 2}, {}):
        assert classes(spark, rows, **sizes) == want


def test_many_near_copies_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randrange(2, 7)):
            copy[rng.randrange(150)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    want = brute(rows)
    assert 10 < sum(kept for _, _, kept in want.values()) < 200  # some hang together, some don't
    assert classes(spark, rows, block=50, others=20) == want == classes(spark, rows)


def test_lowest_pick_and_keys():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, (300, neardup.SYMBOLS)).astype("<u2")
    ka, kb = neardup.keys_of(a[:150]), neardup.keys_of(a[150:])
    want = [next((j for j in range(64) if x[j] == y[j]), 64) for x, y in zip(ka, kb, strict=True)]
    assert neardup.lowest_pick(a[:150] == a[150:]).tolist() == want
    same = np.ones((200, 64), bool)
    for row in same:
        row[rng.permutation(64)[: neardup.MOST_APART]] = False
    assert (neardup.lowest_pick(same) < 64).all()  # the guarantee


def test_very_long_texts(spark):
    long = [f"w{i % 5000}x{i // 5000}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[:30_000])), (4, "x" * 300_000)]
    assert classes(spark, rows) == brute(rows)


def test_sql(spark):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents")
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert sorted(map(tuple, neardup.classes(docs).collect())) == sorted(con.execute(neardup.SQL).fetchall())


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (3, 2, False), (3, 2, False), (2, 2, True)], key=str)
    assert neardup.classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (5, 9)], [(i, i + 1) for i in range(40)] + [(100, 101)], []])
def test_components(spark, edges):
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_labels_after_further_links(spark):
    first, more = [(1, 2), (2, 3), (7, 8), (20, 21), (30, 31)], [(3, 8), (40, 21), (50, 51), (31, 8)]
    labels = neardup.components(spark.createDataFrame(first, "a long, b long"))
    got = {r.node: r.label for r in neardup.joined(labels, spark.createDataFrame(more, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 30: 1, 31: 1, 20: 20, 21: 20, 40: 20, 50: 50, 51: 50}
    assert {r.node: r.label for r in neardup.joined(labels, spark.createDataFrame([], "a long, b long")).collect()} == {r.node: r.label for r in labels.collect()}


def test_small_scratch_data_is_in_few_files(spark):
    """Whatever the number of partitions in which it is dealt out; large scratch data stays as it is dealt."""
    names = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    cores = spark.sparkContext.defaultParallelism
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = neardup.components(spark.createDataFrame([(i + 1, i) for i in range(9)], "a long, b long"))
        assert got.rdd.getNumPartitions() <= cores < 30
        assert {(r.node, r.label) for r in got.collect()} == {(i, 0) for i in range(10)}
        rows = spark.range(0, 100, 1, 20)
        assert neardup.C.in_few_files(rows, 20 * neardup.C.ROWS_A_FILE).rdd.getNumPartitions() == 20
        assert neardup.C.in_few_files(rows, 7 * neardup.C.ROWS_A_FILE).rdd.getNumPartitions() == max(cores, 7)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
