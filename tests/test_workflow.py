"""Stored tables, the cache, answers of models, weights: by hand and against plain loops."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlens.operators import answers as AN
from loomlens.operators import search as SE
from loomlens.plans import stored as ST

RUNS = "run_id int, status string, published boolean, updated timestamp"


def runs(spark, tmp_path, rows=None):
    t = ST.Runs(spark, str(tmp_path / "runs"))
    rows = rows or [(1, "completed", False), (2, "queued", False), (3, "processing", False), (4, "failed", False), (5, "completed", True)]
    frame = spark.createDataFrame([(*r, f"2024-01-0{r[0]}") for r in rows], "run_id int, status string, published boolean, u string").select("run_id", "status", "published", F.col("u").cast("timestamp").alias("updated"))
    assert t.write(frame, 1)
    return t


def state(frame):
    return {r.run_id: (r.status, r.published) for r in frame.collect()}


def test_changes_of_runs(spark, tmp_path):
    t = runs(spark, tmp_path)
    assert state(t.publish(1))[1] == ("completed", True) and state(t.publish(2))[2] == ("queued", False)
    assert state(t.publish(5, False))[5] == ("completed", False)
    assert {k for k, v in state(t.publish_all()).items() if v[1]} == {1, 5}
    assert state(t.cancel(2))[2][0] == "failed" and state(t.cancel(1))[1][0] == "completed"
    assert state(t.sweep("2024-01-03"))[3][0] == "processing" and state(t.sweep("2024-01-04"))[3][0] == "failed"
    assert set(state(t.delete(4))) == {1, 2, 3, 5}
    assert t.version() == 10 and state(t.read(1))[1] == ("completed", False)
    fresh = spark.createDataFrame([(1, "queued", False, "2025-01-01"), (9, "queued", False, "2025-01-01"), (9, "completed", False, "2025-02-01")], "run_id int, status string, published boolean, u string").select("run_id", "status", "published", F.col("u").cast("timestamp").alias("updated"))
    assert state(t.merge(fresh))[1][0] == "completed" and state(t.read())[9][0] == "completed"
    assert state(t.merge(fresh, replace=True))[1][0] == "queued"
    t.drop_before(99)
    assert t.version() == 12 and len(t._marks()) == 1 and set(state(t.read())) == {1, 2, 3, 5, 9}


def test_two_writers_lose_nothing(spark, tmp_path):
    t, other = runs(spark, tmp_path), ST.Runs(spark, str(tmp_path / "runs"))
    seen = []

    def slow(rows):
        if not seen:  # another writer is faster, once
            seen.append(other.cancel(2).count())
        return rows.where("run_id <> 4")

    assert state(t.change(slow)) == {1: ("completed", False), 2: ("failed", False), 3: ("processing", False), 5: ("completed", True)}
    assert t.version() == 3 and not [f for f in (tmp_path / "runs").iterdir() if f.name.startswith("_draft")]
    (tmp_path / "runs" / "_marks" / "4").touch()  # a writer died between mark and place
    assert t.version() == 3
    with pytest.raises(ST.Conflict):
        t.change(lambda r: r, tries=2)


def test_a_writer_that_fails_changes_nothing(spark, tmp_path):
    t = runs(spark, tmp_path)
    with pytest.raises(Exception, match="boom"):
        t.change(lambda r: r.withColumn("x", F.raise_error(F.lit("boom"))))
    assert t.version() == 1 and len(state(t.read())) == 5


def test_cache(spark, tmp_path):
    cache = ST.Cache(spark, str(tmp_path / "cache"), "array<double>")
    model, at = F.lit("m1"), lambda d: F.lit(d).cast("timestamp")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "k int, text string")
    value = F.array(F.length(F.coalesce("text", F.lit(""))).cast("double"))
    missing = cache.misses(docs, "text", model)
    assert missing.count() == 3 and cache.get(docs, "text", model).where("value is not null").count() == 0
    for _ in range(2):  # a put that is tried again
        cache.put(missing.where("text = 'a'").select("key", value.alias("value")), "one", model, at("2024-01-01"))
    assert cache.rows().count() == 1
    got = {r.k: r.value for r in cache.get(docs, "text", model).collect()}
    assert got == {1: [1.0], 2: None, 3: [1.0], 4: None, 5: None}
    assert cache.get(docs, "text", F.lit("m2")).where("value is not null").count() == 0
    cache.put(docs.select(ST.cache_key(F.col("text"), model).alias("key"), F.array(F.lit(9.0)).alias("value")), "two", model, at("2024-03-01"))
    got = {r.k: r.value for r in cache.get(docs, "text", model).collect()}
    assert got == {1: [1.0], 2: [9.0], 3: [1.0], 4: [9.0], 5: [9.0]} and cache.misses(docs, "text", model).count() == 0
    s = cache.stats().first()
    assert (s.entries, s.oldest.month, s.newest.month) == (3, 1, 3)
    left = cache.clear(at("2024-02-01"), str(tmp_path / "left"))
    assert left.rows().count() == 2 and cache.rows().count() == 3
    with pytest.raises(ValueError, match="named"):
        cache.put(missing, "../x", model, at("2024-01-01"))


def test_keys_are_those_of_the_text_and_model(spark):
    from hashlib import sha256

    row = spark.createDataFrame([("é text",)], "t string").select(ST.cache_key(F.col("t"), F.lit("m/x")).alias("k")).first()
    assert row.k == sha256("é text:m/x".encode()).hexdigest()[:32]


def test_pages_of_two_extractions(spark):
    rows = [(1, 1, "x" * 30, "no"), (1, 2, " short " + " " * 40, "seen"), (1, 3, None, None), (2, 1, "tiny", None), (3, 1, "a", "p1"), (3, 2, "b", "p2"), (3, 3, "c", "p3")]
    got = {r.d: tuple(r)[1:] for r in ST.merged_pages(spark.createDataFrame(rows, "d int, page_number int, embedded string, recognized string"), "d", most_pages=2).collect()}
    assert got == {1: ("x" * 30 + "\nseen", 3, 1, True), 2: ("tiny", 1, 0, False), 3: ("p1\np2", 3, 2, True)}


def parse(answer, n):
    """Numbers of an answer by a plain loop."""
    found = {}
    for m in re.finditer(r"Sentence\s+(\d+)\s*:\s*Reasoning:\s*(.+?)\s*\|\s*Category:\s*\[(ACTION|POLICY|NEUTRAL)\]", answer, re.I):
        if 1 <= int(m[1]) <= n:
            found[int(m[1])] = (m[3].upper(), m[2].strip())
    for line in map(str.strip, answer.split("\n")):
        head, tag = re.match(r"(?:Sentence\s+)?(\d+)\s*[:.)]\s*", line, re.I), re.search(r"\[(ACTION|POLICY|NEUTRAL)\]", line, re.I)
        if head and tag and 1 <= int(head[1]) <= n and int(head[1]) not in found:
            rest = re.sub(r"\s*\|\s*Category:\s*\[" + tag[1].upper() + r"\]\s*$", "", line[head.end() :]).strip()
            found[int(head[1])] = (tag[1].upper(), re.sub(r"^Reasoning:\s*", "", rest, flags=re.I).strip())
    return [(i, *found.get(i, ("PARSE_ERROR", ""))) for i in range(1, n + 1)]


def test_numbered_answers(spark):
    rng = random.Random(2)
    lines = ["Sentence {n}: Reasoning: built a road. | Category: [ACTION]", "sentence {n} :reasoning:  it \n said | category: [policy]", "{n}. aims to do. | Category: [POLICY]", "{n}) Reasoning: x [neutral] y", "Sentence {n}: nothing", "noise [ACTION]", "{n}: [ACTION]", "", "99999999999999999999: [ACTION]", "Sentence {n}: Reasoning: a | Category: [ACTION] Sentence {n}: Reasoning: b | Category: [NEUTRAL]"]
    answers = ["\n".join(rng.choice(lines).format(n=rng.randint(0, 6)) for _ in range(rng.randint(0, 8))) for _ in range(150)]
    frame = spark.createDataFrame([(i, a, 5) for i, a in enumerate(answers)] + [(900, None, 2), (901, "x", 0)], "k int, a string, n int")
    got = {}
    for r in AN.numbered(frame, "k", "a", "n").collect():
        got.setdefault(r.k, []).append((r.number, r.label, r.reasoning))
    for i, a in enumerate(answers):
        assert sorted(got[i]) == parse(a, 5), a
    assert sorted(got[900]) == [(1, "PARSE_ERROR", ""), (2, "PARSE_ERROR", "")] and 901 not in got


@pytest.mark.parametrize(("answer", "want"), [
    ('{"label": "Road", "entities": ["a", "b"], "summary": "s"}', ("Road", "General", ["a", "b"], "s", False)),
    ('Sure:\n```json\n{"label": "Road", "category": "Roads"}\n```\nmore ```x```', ("Road", "Roads", [], "", False)),
    ('```\n {"category": "C"} ```', ("", "C", [], "", False)),
    ('{"label": "Road", ', None), ("[1, 2]", None), ("", None), (None, None), ("plain words", None), ("```json\nnot json```", None),
])
def test_labelled_answers(spark, answer, want):
    text = "the council BUILT a bridge over the river " + "x" * 100
    row = AN.labelled(spark.createDataFrame([(answer, text, "kept")], "a string, t string, other string"), "a", "t").first()
    got = (row.label, row.category, row.entities, row.summary, row.llm_error)
    assert got == (want or ("The council built a", "General", [], text[:100] + "...", True)) and row.other == "kept"


def test_labels_of_short_texts(spark):
    rows = AN.labelled(spark.createDataFrame([("x", "Three WORDS only"), ("x", None)], "a string, t string"), "a", "t").collect()
    assert [(r.label, r.summary) for r in rows] == [("Three WORDS only", "Three WORDS only"), (None, None)]
    assert json.dumps(rows[0].entities) == "[]"


def test_simplex_of_weights():
    assert len(SE.simplex(3, 10)) == 66 and SE.simplex(2, 2) == [(0, 2), (1, 1), (2, 0)] and all(sum(p) == 4 for p in SE.simplex(4, 4))


def scores(seed=1, n=60, goals=5):
    rng = random.Random(seed)
    return [(i, g, rng.randint(1, goals) if g == 1 else 0, round(rng.random(), 2), round(rng.random(), 2), round(rng.random(), 2)) for i in range(n) for g in range(1, goals + 1)]


def test_weights_chosen_on_four_folds(spark):
    rows = scores()
    truth = {r[0]: r[2] for r in rows if r[1] == 1}
    facts = spark.createDataFrame([(i, g, truth[i], i % 5, a, b, c) for i, g, _, a, b, c in rows], "id int, goal int, truth int, fold int, a double, b double, c double").repartition(3)
    points = SE.simplex(3, 4)
    hits = {}
    for p, w in enumerate(points):
        for i in truth:
            best = min((-round(sum(x * y for x, y in zip(r[3:], w, strict=True)) / 4, 9), r[1]) for r in rows if r[0] == i)[1]
            hits[p, i] = best == truth[i]
    want = set()
    for f in range(5):
        train = {p: round(sum(h for (q, i), h in hits.items() if q == p and i % 5 != f) / sum(i % 5 != f for i in truth), 9) for p in range(len(points))}
        best = max(train, key=lambda p: (train[p], -p))
        own = [h for (q, i), h in hits.items() if q == best and i % 5 == f]
        want.add((f, best, round(train[best], 6), round(sum(own) / len(own), 6), *points[best]))
    assert {tuple(r) for r in SE.searched_top(facts, "id", ["a", "b", "c"], "truth", "fold", 4).collect()} == want


def test_attribution(spark):
    goals = spark.createDataFrame([(1, 1, 0.2, 1), (1, 2, 0.3, 0), (2, 1, 0.2, 0), (3, 1, 0.6, 0), (4, 1, 0.2, 1)], "id int, goal int, score double, y int")
    targets = spark.createDataFrame([(1, 1, "b", 0.9, 0.5), (1, 1, "a", 0.5, 0.9), (1, 2, "c", 0.9, 0.9), (2, 1, "a", 0.0, 1.0), (3, 1, "a", 0.9, 0.9), (4, 1, "a", 0.1, 0.1)], "id int, goal int, target string, core double, context double")
    got = SE.attributed(goals, targets, ["id"], {"core": 1.0, "context": 1.0}, F.lit(0.5))
    rows = {(r.id, r.goal): (r.target, r.target_score, r.core_share, r.context_share, r.dominant, r.is_wrong) for r in got.collect()}
    # Targets a and b of the first goal tie at .7: the first by name wins; shares that tie go to the first variant.
    assert rows == {(1, 1): ("a", 0.7, 0.25, 0.45, "context", False), (1, 2): ("c", 0.9, 0.45, 0.45, "core", True), (2, 1): ("a", 0.5, 0.0, 0.5, "context", True)}
    counts = {(r.kind, r.name): (r.wrong, r.right) for r in SE.attribution_counts(got).collect()}
    assert counts == {("all", "all"): (2, 1), ("goal", "1"): (1, 1), ("goal", "2"): (1, 0), ("target", "a"): (1, 1), ("target", "c"): (1, 0), ("variant", "core"): (1, 0), ("variant", "context"): (1, 1)}
    assert SE.attribution_counts(got.limit(0)).where("wrong > 0").count() == 0 and len(list(itertools.chain(rows))) == 3
