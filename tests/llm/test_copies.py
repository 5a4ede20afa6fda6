import random
import re
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from loomlens.llm import common as C
from loomlens.llm import copies

SCHEMA = "doc_id long, text string, _m string, kept int, _key string, n_chars long"
SF = "/root/testdata/sf0.001"


def brute(rows):
    of = defaultdict(list)
    bare = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    for i, b in enumerate(bare):
        of[b].append(i)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        best = min(of[bare[i]], key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        out.append((doc_id, rows[best][0], len(of[bare[i]]), best == i, sha256(bare[i].encode()).hexdigest(), len(text or "")))
    return out


def some_rows():
    rng = random.Random(3)
    words = ["ab", "a b", "été", "\U0001f600 x", "long " * 40, "c"]
    rows = [(i, "".join(rng.choice([" ", "\t", "\n", "\x0b", "\r", ""]) + rng.choice(words) for _ in range(rng.randint(0, 3)))) for i in range(150)]
    rows += [(1000 + i, " one text " + " " * (i % 7)) for i in range(120)]
    rows += [(None, "null id"), (None, "null id"), (5, "null id "), (None, None), (2000, None), (2001, ""), (2002, " \n"), (7, "twice"), (7, "twice"), (7, "twice"), (3000, "x " * 30_000), (3001, "x" * 30_000)]
    rows += [(4000, "p" * 64 + "q"), (4001, "p" * 64 + "r"), (4002, "p" * 65), (4003, " p"), (4004, "p"), (4005, "a\x1cb"), (4006, "ab")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", 9) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("most_sent", "share"), [(10_000, 1000), (0, 1000), (0, 3)])
def test_groups_against_brute_force(spark, monkeypatch, most_sent, share):
    monkeypatch.setattr(C, "SHARE", share)
    rows = some_rows()
    got = copies.groups(frame(spark, rows), most_sent=most_sent)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_full_content_is_read_for_survivors_alone(spark):
    rows = some_rows()
    got = copies.groups(frame(spark, rows), all_hashes=False).collect()
    alone = [r for r in got if r.text_sha256 is None]
    assert len(alone) > 10 and all(r.group_size == 1 and r.kept and r.keep_id == r.doc_id for r in alone)
    # Equal in length and beginning, told apart by the whole text only.
    assert {r.doc_id for r in got if r.text_sha256 and r.group_size == 1} >= {4000, 4001, 4002}


@pytest.mark.parametrize("most_sent", [10_000, 0])
def test_rows_that_stay(spark, most_sent):
    rows = some_rows()
    left = copies.deduplicated(frame(spark, rows), most_sent)
    assert left.columns == ["doc_id", "text", "_m", "kept", "_key", "n_chars"]
    want = [(r[0], rows[i][1]) for i, r in enumerate(brute(rows)) if r[3]]
    # Where null and empty texts are equal, which of them stays under one id doesn't matter.
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(key, left.select("doc_id", "text").collect())) == sorted(map(key, want))


def test_empty_table(spark):
    none = frame(spark, [(1, "x")]).where("doc_id = 2")
    assert copies.groups(none).count() == 0 and copies.deduplicated(none).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got, want = copies.groups(C.table(spark, SF, "documents")), con.execute(copies.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
