"""Extraction of activities against small cases."""

import pytest
from pyspark.sql import functions as F

from loomlens.functions import text as T
from loomlens.operators import extraction as EX

TEXT = (
    "The council opened a new library in June. It serves 500 residents of the town. Staff planted trees along the river bank\n"
    "with help of Dr. Smith and others. Although late, works went well for all concerned in the end. "
    "Volunteers cleaned four parks • Residents recycled waste paper at the new depot near Main Street every week"
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "short one here"), (5, " ".join(["word"] * 30) + ". " + " ".join(["other"] * 12) + ". " + " ".join(["more"] * 4))], "doc_id long, text string")


def test_candidates(docs):
    got = [(r.doc_id, r.pos, r.text) for r in EX.candidates(docs, "doc_id", least=5, most=25).orderBy("doc_id", "pos").collect()]
    assert got == [
        (1, 1, "The council opened a new library in June It serves 500 residents of the town"),
        (1, 2, "Staff planted trees along the river bank with help of dr. Smith and others Although late, works went well for all concerned in the end"),
        (1, 3, "Residents recycled waste paper at the new depot near Main Street every week"),
        (5, 1, " ".join(["other"] * 12)),
    ]


def test_activities(docs):
    got = {r.pos: r for r in EX.extracted(docs, "doc_id", least=5, most=40).collect()}
    # "planted" has "plan", which is an ordinary verb and a word of governance.
    assert {p: (r.confidence, r.has_action_verb, r.relevance, r.section) for p, r in got.items()} == {1: (0.9, True, 0.716, "governance"), 2: (0.7, True, 0.572, "governance")}
    best = got[1]
    # .3, no goal term, an outcome ("500 residents"), four markers at least; .6 of .9 and .4 of that.
    assert best.relevance == round(0.6 * 0.9 + 0.4 * 0.44, 4) and best["rank"] == 1
    assert EX.top(EX.extracted(docs, "doc_id", least=5, most=40), 1).count() == 1
    assert EX.filtered(EX.extracted(docs, "doc_id", least=5, most=40), least_words=16, sections=["social"]).count() == 0
    assert {r.doc_id: r.n for r in EX.summary(EX.extracted(docs, "doc_id", least=5, most=40), "doc_id").collect()}[1] == len(got)


def test_gate(spark):
    rows = spark.createDataFrame([(1, 1, "We opened a hall for the community in 2023", 9, True, 0.9), (1, 2, "We opened a hall for the community", 7, True, 0.6), (1, 3, "Nothing happens here for people at all", 7, True, 0.9), (1, 4, "We opened it", 3, False, 0.9)], "doc_id int, pos int, text string, word_count int, is_activity boolean, confidence double")
    assert [r.pos for r in EX.gated(rows, "doc_id").collect()] == [1]
    assert sorted(r.pos for r in EX.gated(rows, "doc_id", verb=False).collect()) == [1, 3]


def test_pieces_and_counts(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(T.paragraphs, " a\n b \n\n \n c\n\t\nd ") == ["a\n b", "c", "d"]
    assert one(T.bullets, "one • two - three-four * five") == ["one", "two", "three-four", "five"]
    assert one(T.normalized, "Élan, vital-ity!  x_1") == "élan vital-ity x_1"
    assert one(T.page_text, "a  b\tc\f\n \n\n\nd") == "a b c\n\nd"
    stats = spark.createDataFrame([("We went to town today. Then we came back home again.\n\nAll was well with us.",), ("",)], "t string").select(*(c.alias(k) for k, c in T.summary_stats(F.col("t")).items())).collect()
    assert tuple(stats[0]) == (16, 3, 2, 3.69, 5.33) and tuple(stats[1]) == (0, 0, 0, 0.0, 0.0)
    assert one(T.has_action_verb, "We Opened it") is True and one(T.has_action_verb, "reopenedx") is False
    assert [one(T.simple_confidence, t) for t in ("reopened", "a planner", "it was", "zzz")] == [0.9, 0.7, 0.3, 0.5]
    assert one(T.section_category, "Urban design and Council") == "planning" and one(T.section_category, "zzz") is None
    assert one(EX.first_failure, "a | b | c") == "looks_like_table"
    # Digits at the ends of sentences stay, whatever the sentence's place.
    assert one(lambda t: T.sentences(t, 2, ()), "0abc0. 1abc1. 2abc2") == ["0abc0", "1abc1", "2abc2"]


def test_scores_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    plan = EX.extracted(docs, "doc_id", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:increased|decreased|reduced|improved)") == 1


def test_words_present_in_a_text(spark):
    terms = ("road", "road works", "roads", "works", "a.c", "ad", "pool", "car pool")
    for text in ("the road works here", "broads", "abc a.c", "a car poo", "carpool", "", "car  pool road work"):
        own = spark.createDataFrame([(text,)], "t string").select(T.present(F.col("t"), terms)).first()[0]
        assert [x in own for x in terms] == [x in text for x in terms], text
    assert T.tree(("road", "roads", "rope", "a.")) == "(?:a\\.|ro(?:ad(?:s)?|pe))"
    got = spark.createDataFrame([("we implemented it",), ("it was REVIEWED",), ("it was",), ("none",), (None,)], "t string").select(T.simple_confidence(F.col("t"))).collect()
    assert [r[0] for r in got] == [0.9, 0.7, 0.3, 0.5, 0.5]
