import hashlib
import random
import re

import duckdb
import pytest

from loomlens.llm import common as C
from loomlens.llm import decontaminate, licenses

SCHEMA = "doc_id long, text string, w string, item_id int"
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], SCHEMA).repartition(3)


def brute(rows, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    own |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_windows_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    some = lambda n: [rng.choice("alpha Beta gAmma δέλτα Σ ΑΣ ÉCOLE école x1 2 aa bb cc dd".split()) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([1, 2, 3, 7, 10, 11, 25])))) for k in range(14)] + [(50, None), (51, ""), (52, "..."), (None, "nobody owns this item of ten words or so you"), (3, "given twice")]
    rows = []
    for i in range(60):
        w = some(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w) + 1) : 0] = (rng.choice(items)[1] or "").split()[rng.randrange(2) :]
        rows.append((i, rng.choice([" ", "\n", ", ", " - "]).join(w)))
    items += [(60, "one two three four five six seven eight nine kite"), (61, "\u212aelvin \u212a k \u0138")]
    rows += [(80, "One two three four five six seven eight nine \u212aite"), (81, "one two three four five six seven eight nine KITE"), (82, "\u212aelvin \u212a K \u0138"), (83, "kelvin k k \u0138"), (84, "\u0138elvin \u0138 k \u0138")]
    rows += [(90, None), (91, ""), (None, items[3][1]), (92, "école"), (92, "école"), (93, "nobody owns this item of ten words or so you")]
    benchmark = spark.createDataFrame([(k, t, "y") for k, t in items], "item_id long, text string, doc_id string")
    for most in (200_000, 0):
        monkeypatch.setattr(decontaminate, "MOST_SENT", most)
        monkeypatch.setattr(decontaminate.hits, "__defaults__", (most,))
        got = decontaminate.contaminated(frame(spark, rows), benchmark).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == brute(rows, items)
    left = {r.doc_id for r in decontaminate.clean(frame(spark, rows), benchmark).collect()}
    assert left == {r[0] for r in brute(rows, items) if not r[5]}


def test_nothing_to_find(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, [(1, "a b")]), benchmark).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert decontaminate.contaminated(frame(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    read = lambda t: C.table(spark, f"/root/testdata/{sf}", t)
    got = decontaminate.contaminated(read("documents"), read("benchmark")).drop("items", "spans")
    want = con.execute(decontaminate.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert any(r.contaminated for r in got.collect())


def test_base_phrases_against_brute_force(spark):
    rng = random.Random(5)
    pool = "all rights reserved cc by general public license Rights, BY-nc x All the".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(80)] + [(100, None), (101, ""), (102, "cc"), (103, "CC-BY"), (103, "CC-BY"), (None, "all rights reserved " * 3000)]
    want = []
    for i, t in rows:
        w = [x.decode() for x in words(t)]
        at, own = [], set()
        for p, label in licenses.PHRASES.items():
            k = p.split()
            places = [s for s in range(len(w)) if w[s : s + len(k)] == k]
            at += places
            own |= {label} if places else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own))))
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan(frame(spark, [])).count() == 0


def test_notices(spark):
    mit = next(t for label, t in licenses.NOTICES if label == "mit" and len(t) > 200).split()
    edited = [*mit[:15], "really", *mit[15:30], *mit[31:]]
    rows = [(1, "x " * 9 + " ".join(mit)), (2, "Foo. " + " ".join(edited).upper() + " bar"), (3, " ".join(mit[:12])), (4, "This work is licensed under the GNU General Public License, version 3."), (5, " ".join(reversed(mit))), (6, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1 and got[2].score > 0.85
    assert got[3].labels == got[5].labels == "" and got[4].labels.startswith("gpl,gpl-3.0") and got[4].base_labels == "gpl"
    assert [(s.first, s.last) for s in got[1].spans] == [(9, 8 + len(mit))] and "cc-by-nc-4.0" in got[6].labels.split(",")


def test_versions_and_clauses_are_told_apart(spark):
    later = next(t for label, t in licenses.NOTICES if label == "gpl-2.0-or-later")
    work = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    want = {
        "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
        "licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1",
        "Licensed under the Apache License, Version 2.0 (the": "apache-2.0",
        "Licensed under the Apache License, Version 1.1": "",
        "Released under the BSD license": "",
        later: "gpl,gpl-2.0-or-later",
        later.replace("version 2", "version 3"): "gpl",
        later.replace("this program", "that useful program"): "gpl,gpl-2.0-or-later",
        work.format(""): "cc-by-4.0",
        work.format("-ShareAlike"): "",
        work.format("").replace("4", "3"): "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, list(enumerate(want)))).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_short_templates_match_just_where_their_words_stand(spark):
    rng = random.Random(9)
    short = [(label, t.split()) for label, t in licenses.NOTICES if len(t.split()) <= licenses.SHORT] + [(label, p.split()) for p, label in licenses.PHRASES.items()]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 4)):
            own = list(rng.choice(short)[1])
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice(["x", "2", "by", "the"])
            w += [*own, *(["and"] * rng.randrange(2))]
        rows.append((i, " ".join(w)))
    for r in licenses.scan(frame(spark, rows)).collect():
        w = rows[r.doc_id][1].split()
        want = {(k, k + len(t) - 1, label) for label, t in short for k in range(len(w)) if w[k : k + len(t)] == t}
        assert {(s.first, s.last, s.label) for s in r.spans or ()} == want
