"""Corrections, reads and p-values against small cases."""

import pytest
from pyspark.sql import functions as F

from loomlens.operators import corrections as C
from loomlens.operators import evaluation as E
from loomlens.operators import reads as Q
from loomlens.operators import trends as TR


def corrected(spark, text, scores, **how):
    row = spark.createDataFrame([(text, *(scores.get(g) for g in C.GOALS))], "text string, " + ", ".join(f"s{g} double" for g in C.GOALS))
    got = C.corrected(row, **how).first()
    return {g: round(got[f"s{g}"], 6) for g in C.GOALS if got[f"s{g}"] is not None}, got


CASES = [
    (17, "A global partnership with the world bank", {17: 0.5, 11: 0.5}, {17: 0.6, 11: 0.5}),
    (17, "Our mayor spoke", {17: 0.9}, {17: 0.09}),
    (17, "Council mayor", {17: 1.0}, {17: 0.0}),
    (17, "road works", {17: 0.9, 11: 0.9, 9: 0.1}, {17: 0.0, 11: 1.0, 9: 0.25}),
    (17, "road works", {11: 0.9}, {11: 0.9}),
    (11, "waste collection", {11: 0.95}, {11: 1.0}),
    (11, "health at the gym, sport", {11: 0.5, 3: 0.5}, {11: 0.1, 3: 0.7}),
    (11, "nothing of it", {11: 0.5}, {11: 0.15}),
    (14, "South Beach Road", {14: 0.9, 9: 0.1, 11: 0.1}, {14: 0.0, 9: 0.25, 11: 0.2}),
    (14, "South Beach Road", {14: 0.19, 9: 0.1}, {14: 0.19, 9: 0.1}),
    (14, "oyster and seagrass on Beach Road", {14: 0.9, 9: 0.1}, {14: 0.9, 9: 0.1}),
    (14, "oyster leases", {14: 0.9}, {14: 1.0}),
    (14, "met near yamba", {14: 0.9}, {14: 0.65}),
    (4, "arts and sports", {4: 0.5, 11: 0.5, 3: 0.95}, {4: 0.15, 11: 0.65, 3: 1.0}),
    (4, "arts at school", {4: 0.5}, {4: 0.5}),
    (6, "culvert", {6: 0.5, 11: 0.5}, {6: 0.05, 11: 0.6}),
    (8, "council", {8: 0.5, 16: 0.5}, {8: 0.1, 16: 0.65}),
    (10, "heritage", {10: 0.5, 16: 0.5}, {10: 0.1, 16: 0.65}),
    (12, "audit of waste", {12: 0.5, 16: 0.5}, {12: 0.5, 16: 0.65}),
    (16, "ethics", {16: 0.9}, {16: 1.0}),
    (16, "purchasing for a building", {16: 0.5, 11: 0.5, 12: 0.5}, {16: 0.1, 11: 0.6, 12: 0.6}),
]


@pytest.mark.parametrize("module", list(C.MODULES))
def test_modules(spark, module):
    own = [c for c in CASES if c[0] == module]
    rows = spark.createDataFrame([(k, text, *(scores.get(g) for g in C.GOALS)) for k, (_, text, scores, _) in enumerate(own)], "k int, text string, " + ", ".join(f"s{g} double" for g in C.GOALS))
    for r in C.corrected(rows, modules=(module,)).collect():
        assert {g: round(r[f"s{g}"], 6) for g in C.GOALS if r[f"s{g}"] is not None} == own[r.k][3], own[r.k]


def test_chain_methods_and_stale_flags(spark):
    scores, row = corrected(spark, None, {17: 0.9, 16: 0.9})
    assert scores[17] == 0.24 and row.a17 is False and row.a16 is True and row.c17 is True
    assert corrected(spark, "road works", {17: 0.9, 11: 0.5}, modules=(17,), methods={17: "reassign"})[0] == {17: 0.9, 11: 0.65}
    with pytest.raises(ValueError):
        corrected(spark, "x", {17: 0.9}, methods={17: "other"})
    # Alignment isn't renewed by corrections.
    assert corrected(spark, "culvert", {6: 0.95}, modules=(6,))[1].a6 is True
    # Each module sees what the one before left: goal 17 lifts 11, which 11 then lowers.
    assert corrected(spark, "a hall", {17: 0.9, 11: 0.5}, modules=(17, 11))[0][11] == 0.3


def test_boost_spares_a_corrected_goal(spark):
    row = spark.createDataFrame([("marine debris", *(0.5 if g in (13, 14) else None for g in C.GOALS)), ("solar by the sea", *(0.5 if g in (13, 14) else None for g in C.GOALS))], "text string, " + ", ".join(f"s{g} double" for g in C.GOALS))
    a, b = C.summary(C.boosted(C.corrected(row))).orderBy("text").collect()
    assert (round(a.s14, 6), a.s13, a.top_goal) == (0.65, 0.5, 14) and (round(b.s13, 6), round(b.s14, 6), b.top_goal) == (0.7, 0.7, 13)


def test_p_values(spark):
    # Student's t: 5.196152 with 3 degrees of freedom, 2.776445 with 4, 12.706205 with 1, 2.228139 with 10.
    rows = [(t * t / (t * t + f), f + 2) for t, f in ((5.196152, 3), (2.776445, 4), (12.706205, 1), (2.228139, 10))] + [(0.0, 5), (1.0, 5), (1.0, 2)]
    frame = spark.createDataFrame(rows, "r double, n long")
    got = [r.p for r in frame.withColumn("p", TR.p_value(F.col("r"), F.col("n"))).collect()]
    assert got == pytest.approx([0.013847, 0.05, 0.05, 0.05, 1.0, 0.0, 0.0], abs=1e-6)


def test_flat_series_are_no_trend(spark):
    flat = spark.createDataFrame([(1, y, 0.5) for y in range(2000, 2005)], "g int, year int, score double")
    got = TR.trends(flat, ["g"]).first()
    assert (got.r2, got.is_significant, got.direction) == (0.0, False, "stable")


def test_changes_of_runs(spark):
    runs = spark.createDataFrame([(1, "completed", False, "2024-01-01 00:00:00"), (2, "queued", False, "2024-01-01 00:00:00"), (3, "processing", False, "2024-03-01 00:00:00")], "id int, status string, published boolean, updated string").withColumn("updated", F.col("updated").cast("timestamp"))
    assert [r.published for r in Q.published(runs, F.col("id") < 3).orderBy("id").collect()] == [True, False, False]
    assert [r.status for r in Q.swept(runs, "2024-02-01 00:00:00").orderBy("id").collect()] == ["completed", "failed", "processing"]
    assert [r.id for r in Q.without(runs, F.col("id") == 2).orderBy("id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        Q.by_ids(runs, "id", [1, 1])
    found, missing = Q.by_ids(runs, "id", [1, 9])
    assert [r.id for r in found.collect()] == [1] and [r.id for r in missing.collect()] == [9]


def test_grades_and_pages(spark):
    rows = spark.createDataFrame([(40, 100), (15, 100), (14, 100), (5, 0), (5, None)], "a long, p long")
    assert [r.g for r in rows.withColumn("g", Q.grade(F.col("a"), F.col("p"))).collect()] == ["rich", "moderate", "thin", "unknown", "unknown"]
    facts = spark.createDataFrame([(i, 1 + i % 2, True, f"Text {i}") for i in range(500)], "i int, goal int, is_aligned boolean, t string")
    assert Q.page(facts, "i", size=1000).count() == 200 and Q.page(facts, "i", 1, "TEXT 49", "t").first().total == 5
    with pytest.raises(ValueError):
        Q.browse(facts, order="other")


def test_deviations_of_sums_beyond_a_long(spark):
    # Two scores whose squares times the rows exceed a long, as the products of nine million rows of thousandths do.
    facts = spark.createDataFrame([("a", 1_000_000_000), ("b", 2_000_000_000)], "council string, milli long")
    assert {(r.of, r.n, r.deviation) for r in Q.diagnostics(facts, "council").collect()} == {("all", 2, 5e8), ("best", 2, 5e8)}
    assert [r.deviation for r in E.score_statistics(facts.withColumn("of", F.lit(1)), ["of"]).collect()] == [5e8]


def test_words_of_corrections_are_found_in_one_pass(spark):
    rows = spark.createDataFrame([("A road upgrade by Byron Road in partnership with the shire",)], "text string").withColumns({f"s{g}": F.lit(0.5) for g in C.GOALS})
    plan = C.corrected(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
