import random
from collections import Counter
from hashlib import sha256

import pytest

from loomlens.llm import common as C
from loomlens.llm import substrings

SCHEMA = "doc_id long, text string, a long, spans string, n_chars int"


def brute(rows):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[k : k + 200] for k in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(gone), spans, sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "x", 9) for i, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removed(docs).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    passages = [text(rng.choice([150, 199, 200, 201, 260, 500, 900])) for _ in range(10)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(300))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(60)
            parts += [p[a : len(p) - rng.randrange(60)], text(rng.randrange(200))]
        rows.append((i, "".join(parts)))
    return [*rows, (200, None), (201, ""), (202, "z" * 700), (203, "xy" * 400), (204, rows[0][1]), (None, "null id " * 5), (205, "s" * 199)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    rows = corpus(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if hot > 2 else 7)
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = text(150), text(260)
    rows = [(i, text(rng.randrange(250)) + (short if i % 2 else long[i % 40 :]) + text(rng.randrange(250))) for i in range(90)] + [(100 + i, text(190) + short + "same tail " * 9) for i in range(6)]
    docs = spark.createDataFrame([(i, t, 5, "x", 9) for i, t in rows], SCHEMA)
    assert len(substrings.frequent_grams(substrings.keyed(docs).select("k1", "k2", "text"))) > 0
    assert run(spark, rows) == brute(rows)


def test_driver_s_documents(spark):
    rows = [(r.doc_id, r.text) for r in C.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert run(spark, rows) == brute(rows)


def test_long_texts_and_equal_rows(spark, monkeypatch):
    from loomlens.llm import spans

    monkeypatch.setattr(spans, "BLOCK", 700)
    rng = random.Random(9)
    long = "".join(rng.choice("abc") for _ in range(5000))
    rows = [(1, long), (2, "q" + long[900:2400]), (3, "same " * 60), (3, "same " * 60), (4, long[2000:2199]), (5, long[4800:])]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_cleaned_documents(spark):
    docs = spark.createDataFrame([(i, t, 5, "x", 9) for i, t in corpus(6)], SCHEMA)
    assert substrings.removed(docs.limit(0)).count() == 0
    got = substrings.cleaned(docs).collect()
    want = {r.doc_id: r for r in substrings.removed(docs).collect()}
    assert len(got) == docs.count() and set(got[0].asDict()) == {"doc_id", "text", "a", "spans", "n_chars"}
    for r in got:
        if r.doc_id != 200:
            assert len(r.text.encode()) <= want[r.doc_id].n_bytes - want[r.doc_id].n_removed and r.n_chars == len(r.text)
