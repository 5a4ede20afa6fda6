"""From texts to reports: each step against plain Python."""

import math
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from loomlens.functions import lexicons as L
from loomlens.operators import alignment as A
from loomlens.operators import evaluation as E
from loomlens.operators import keywords as K
from loomlens.operators import reporting as R
from loomlens.operators import rollups as RU


def vector(text, dims=R.DIMS):
    out = [0.0] * dims
    for w in text.lower().split():
        out[int(md5(w.encode()).hexdigest()[:4], 16) % dims] += 1
    return out


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


TEXTS = ["Health and wellbeing for the community", "Affordable and clean energy from solar and wind power", "", "climate action Climate ACTION life on land", "roads " * 500, "gender equality and quality education"]


@pytest.fixture(scope="module")
def goals(spark):
    return R.goal_vectors(spark, R.goal_texts(), R.hashed_vector)


def test_vectors_and_scores(spark, goals):
    assert goals == {g: vector(t) for g, t in R.goal_texts().items()}
    rows = R.scored(spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k int, text string"), goals, R.hashed_vector).collect()
    for r in rows:
        for g, v in goals.items():
            want = cosine(vector(r.text or ""), v)
            assert abs(r[f"u{g}"] - want) < 1e-12 and abs(r[f"s{g}"] - round(want, 4)) < 1.1e-4


def test_alignment_is_judged_unrounded(spark):
    """A similarity just under the threshold of goal 1 stays under it, though its score in four digits doesn't."""
    least = L.THRESHOLDS["hybrid"][1][0]
    u = least - 0.00002
    encode = lambda t: F.array(F.lit(u), F.lit(math.sqrt(1 - u * u)))
    done = R.aligned(spark.createDataFrame([(1, "plain words")], "k int, text string"), {g: [1.0, 0.0] for g in R.GOAL_NAMES}, encode, boost=False, modules=()).first()
    assert done.s1 == round(u, 4) >= least and done.a1 is False


def test_report_of_activities(spark, goals):
    rows = [(i % 2, i, t) for i, t in enumerate(TEXTS * 3)]
    done = R.aligned(spark.createDataFrame(rows, "report int, pos int, text string"), goals)
    held, want = done.collect(), defaultdict(lambda: [0, 0, 0, 0])
    for r in held:
        for g in R.GOAL_NAMES:
            w = want[r.report, g]
            w[0] += 1
            w[1] += bool(r[f"a{g}"])
            w[2] += round(r[f"s{g}"] * 1e6)
            w[3] += r.top_goal == g
        assert r.num_aligned == sum(bool(r[f"a{g}"]) for g in R.GOAL_NAMES)
    got = {(r.report, r.goal): r for r in R.reported(done, "report", "pos").collect()}
    assert set(got) == set(want) and len(got) == 34
    for k, (n, a, micro, firsts) in want.items():
        r = got[k]
        assert (r.activities, r.aligned, r.firsts, r.is_gap) == (n, a, firsts, a == 0) and abs(r.mean_score - micro / n / 1e6) < 1e-6 and abs(r.coverage - a / n) < 1e-6
    # Boosts and corrections take part: health words lift goal 3.
    plain = R.aligned(spark.createDataFrame(rows[:1], "report int, pos int, text string"), goals, boost=False, modules=()).first()
    assert next(r for r in held if r.pos == 0).s3 >= plain.s3 + 0.2


def test_whole_texts(spark):
    text = ". ".join(["The council delivered a new community health centre and it supported the wellbeing of all residents in the region over the year"] * 3) + "."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "short", "x")], "doc_id int, text string, source string")
    rows = R.from_texts(docs, "doc_id").collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) == 17 and next(r for r in rows if r.goal == 3).activities >= 1
    assert R.from_texts(docs.limit(0), "doc_id").count() == 0


def test_context_renews_alignment(spark):
    facts = spark.createDataFrame([(1, 1, 0.45), (1, 2, 0.75), (2, 1, 0.0), (2, 2, 0.0), (3, 1, 0.5), (3, 2, 0.5)], "k int, goal int, score double")
    got = {(r.k, r.goal): (r.is_aligned, r.num_aligned, r.explanation) for r in A.realigned(facts, ["k"], "hybrid", {1: 0.5, 2: 0.5}).collect()}
    assert got[1, 1] == (False, 1, "goal 2 strongly, 1 aligned") and got[2, 1] == (False, 0, "no goal") and got[3, 2] == (True, 2, "goal 1 moderately, 2 aligned")


FACTS = "g int, report int, a int, goal int, milli long, is_aligned boolean, state string"


def test_groups_and_headlines(spark):
    rows = [(1, 1, 10, 1, 900, True, "VIC"), (1, 1, 10, 2, 100, False, "VIC"), (1, 1, 11, 1, 300, False, "VIC"), (1, 2, 12, 2, 900, True, "NSW"), (2, 3, 13, 1, 0, False, "WA")]
    facts = spark.createDataFrame(rows, FACTS)
    goals, wide = RU.group_alignment(facts, "g", ["report"], "a", ["state"], k=2, threshold=0.55)
    assert {(r.g, r.goal): (r.mean_score, r.coverage, r.is_gap) for r in goals.collect()} == {(1, 1): (0.6, 0.5, False), (1, 2): (0.5, 0.5, True), (2, 1): (0.0, 0.0, True)}
    assert {r.g: (r.activities, r.reports, r.mean_top_score, r.state, r.best) for r in wide.collect()} == {1: (3, 2, 0.7, "NSW,VIC", "10:900,12:900"), 2: (1, 1, 0.0, "WA", "13:0")}
    heads = {r.report: tuple(r)[1:] for r in RU.headlines(facts, ["report"], "a").collect()}
    assert heads == {1: (2, 1, 0.5, 10, 1, 900), 2: (1, 2, 1.0, 12, 2, 900), 3: (1, None, 0.0, None, None, None)}
    gaps = RU.nearest_to_gaps(facts, ["report"], "a").collect()
    assert {(r.report, r.goal): (r.rank, r.a, r.milli) for r in gaps} == {(1, 2): (1, 10, 100), (3, 1): (1, None, None)}


def test_words_of_aligned_activities(spark):
    rows = [(1, "Roads, ROADS and x_roads parks9 école", 0.6, True), (1, "roads within parks", 0.5, True), (1, "bridges bridges", 0.4, True), (2, "bridges", 0.9, False)]
    got = K.aligned_words(spark.createDataFrame(rows, "goal int, text string, score double, is_aligned boolean"), "text").collect()
    assert sorted((r.goal, r.word, r.n, r.activities, r.rank) for r in got) == [(1, "parks", 1, 2, 2), (1, "roads", 3, 2, 1)]


def test_terms_weighed_by_group(spark):
    docs = spark.createDataFrame([("a", 1, "river bank river"), ("a", 2, "river road"), ("a", 3, "bank"), ("b", 4, "road")], "source string, doc int, text string")
    got = {(r.source, r.term): (r.df, r.weight) for r in K.weighed_terms(docs, "source", "doc", k=50, most_df=0.5, longest=2).collect()}
    idf = math.log(4 / 2) + 1
    # 'river' and 'bank' stand in two of three documents and are left out; so is 'road' of the other group.
    assert set(got) == {("a", "river bank"), ("a", "bank river"), ("a", "river road"), ("a", "road")}
    assert got["a", "river road"] == (1, round(idf / math.sqrt(2 * idf * idf), 4))
    assert len(K.weighed_terms(docs, "source", "doc", k=50, vocabulary=1, most_df=1.0, longest=1).collect()) == 2


def test_what_was_missed(spark):
    facts = spark.createDataFrame([(i, 1, 0.1 * i, 1) for i in range(5)] + [(9, 1, 0.0, 0), (3, 2, 0.9, 1)], "k int, goal int, score double, y int")
    targets = spark.createDataFrame([(0, 1, "a", 0.9), (0, 1, "b", 0.2), (1, 1, "a", 0.1)], "k int, goal int, target string, score double")
    row = E.missed(facts, targets, "k", F.lit(0.35)).collect()
    assert len(row) == 1 and (row[0].misses, row[0].looked_at, row[0].target_rate, row[0].mean_score, row[0].mean_target) == (4, 4, 0.25, 0.15, 0.5)
    assert E.missed(facts, targets, "k", F.lit(0.35), most=2).first().looked_at == 2


def test_weighed_terms_count_frequent_runs_only(spark):
    # Of 400 runs of two words one reaches the floor that the words set; the others aren't counted, and the result is that of all.
    rows = [("s", i, f"road works w{chr(97 + i % 20)}word x{chr(97 + i // 20)}word") for i in range(60)] + [("s", 100 + i, "other things") for i in range(30)] + [("s", None, "road works road works")]
    docs = spark.createDataFrame(rows, "source string, doc long, text string")
    few, lots = ({(r.term, r.df, r.weight) for r in K.weighed_terms(docs, "source", "doc", k=3, vocabulary=v, most_df=0.9, longest=2, stop=()).collect()} for v in (3, 4))
    assert {(t, df) for t, df, _ in few} == {("road", 61), ("works", 61), ("road works", 61)}
    assert {t for t, *_ in lots} <= {"road", "works", "road works", "other", "things", "other things"}
    assert len(K.weighed_terms(docs, "source", "doc", k=50, vocabulary=1000, most_df=1.0, longest=1).collect()) == 20 + 3 + 3
