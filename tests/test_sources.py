"""Report files, sinks and measures on small cases."""

import json

from pyspark.sql import functions as F

from loomlens.operators import evaluation as E
from loomlens.operators import rollups as R
from loomlens.sources import reports as P
from loomlens.sources import sinks


def test_file_metadata(spark):
    rows = spark.createDataFrame([("NSW_Some_Shire_2023.pdf",), ("report.pdf",), ("answer_2021-vic.pdf",), ("tas_Hobart_urban_1999_x.pdf",), ("rural wagga.pdf",)], "n string")
    got = [tuple(r) for r in rows.select(*(c.alias(k) for k, c in P.file_metadata(F.col("n")).items())).collect()]
    assert got == [("2023", "NSW", None, None), (None, None, None, None), ("2021", "VIC", None, None), ("1999", "TAS", "Hobart", "urban"), (None, "WA", None, "Rural")]


def test_extraction_and_ocr(spark):
    rows = spark.createDataFrame([("short", "x" * 400, 1), ("x" * 300, "y" * 900, 1), (None, None, 2)], "a string, b string, n int")
    assert [r[0] and r[0][0] for r in rows.select(P.better_extraction(F.col("a"), F.col("b"), F.col("n"))).collect()] == ["x", "x", None]
    pages = spark.createDataFrame([(1, "", 1), (1, "t" * 50, 0), (2, "t" * 50, 3), (2, None, 0)], "d int, text string, images int")
    assert {r.d: r.needs_ocr for r in P.needs_ocr(pages, "d").collect()} == {1: True, 2: False}


def test_sections_and_financial_start(spark):
    lines = spark.createDataFrame([(1, 0, "INTRO"), (1, 1, "a"), (1, 2, "PLANS"), (1, 3, "b"), (1, 4, "c")], "d int, i int, line string")
    got = P.sections(lines, "d", "i", "line", F.col("line") == F.upper("line")).orderBy("section").collect()
    assert [(r.title, r.start_line, r.end_line) for r in got] == [("INTRO", 0, 1), ("PLANS", 2, 4)]
    start = P.financial_start(lines, "d", "i", [F.col("line") == "none", F.col("line") == "PLANS"]).first()["start"]
    assert start == 2


def test_sinks(spark, tmp_path):
    facts = spark.createDataFrame([(1, 7, 1, 0.25), (1, 7, 2, 0.5), (1, 8, 1, 0.75)], "report int, activity int, goal int, score double")
    sinks.wide_csv(facts, str(tmp_path / "csv"), ["report", "activity"], [1, 2])
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("activity").collect()
    assert [tuple(r) for r in got] == [("1", "7", "0.25", "0.5"), ("1", "8", "0.75", "0.0")]
    sinks.report_json(facts, str(tmp_path / "json"), "report")
    line = next((tmp_path / "json" / "report=1").glob("*.json")).read_text().splitlines()[0]
    assert set(json.loads(line)) == {"activity", "goal", "score"}
    rollup = R.alignment(facts.withColumns({"milli": (F.col("score") * 1000).cast("long"), "is_aligned": F.col("score") > 0.4}), ["report"])
    sinks.summary_text(rollup, str(tmp_path / "text"), "report")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "text")).collect())
    assert text.startswith("report 1\ngoal 1 mean 0.5 coverage 0.5")


def test_sweep_and_multi_label(spark):
    rows = spark.createDataFrame([(1, 1, 900), (1, 0, 850), (1, 1, 400), (1, 0, 100)], "goal int, y int, milli int")
    at = {r.i: r for r in E.sweep(rows, ["goal"], 10).collect()}
    assert (at[9].tp, at[9].fp, at[9].fn, at[9].tn) == (1, 0, 1, 2) and (at[4].tp, at[4].fp) == (2, 1)
    assert E.best(E.sweep(rows, ["goal"], 10), ["goal"]).first()["i"] == 9
    long = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 0, 1), (2, 1, 0, 0), (2, 2, 0, 0)], "s int, goal int, y int, p int")
    assert tuple(E.multi_label(long, "s").first()) == (0.5, 0.25, 0.75, round((2 / 3 + 1) / 2, 6))


def test_loaders(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from loomlens.operators import alignment as A
    from loomlens.sources import loaders as L

    (tmp_path / "r").mkdir()
    for i, (c, s, y) in enumerate([("Byron Shire", "NSW", 2023), ("Hobart City", "TAS", 2024), ("Ballina Shire", "NSW", 2024)]):
        (tmp_path / "r" / f"{i}.json").write_text(json.dumps({"council": c, "state": s, "year": y}))
    path = str(tmp_path / "r")
    assert L.results(spark, path).count() == 3 and L.results(spark, path, "shire", [2024], ["NSW"]).first().council == "Ballina Shire"
    assert [r.state for r in L.distinct_values(L.results(spark, path), "state").collect()] == ["NSW", "TAS"]
    (tmp_path / "c" / "2023").mkdir(parents=True)
    (tmp_path / "c" / "2023" / "NSW_Byron_Urban_2023_alignment.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "c" / "other.csv").write_text("a,b\n3,z\n")
    assert sorted((r.a, r.file_name) for r in L.csv_files(spark, str(tmp_path / "c")).collect()) == [("1", "NSW_Byron_Urban_2023_alignment.csv"), ("2", "NSW_Byron_Urban_2023_alignment.csv")]
    (tmp_path / "o.tsv").write_text("text_id\ttext\tsdg\tagreement\n1\tgood \"one\t3\t0.9\n2\t \t3\t0.9\n3\tlow\t3\t0.5\n4\tgoal\t18\t0.9\n5\tgood two\t17\t0.7\n")
    assert sorted(r.text_id for r in L.agreed_labels(spark, str(tmp_path / "o.tsv")).collect()) == ["1", "5"] and L.agreed_labels(spark, str(tmp_path / "o.tsv"), n=1).count() == 1
    names = ", ".join(f"SDG{g} int" for g in range(1, 18))
    wide = L.wide_labels(spark.createDataFrame([("two words", *([1] + [None] * 16)), (" ", *([1] * 17)), ("none", *([None] * 17)), (None, *([1] * 17))], "Description string, " + names))
    assert [(r.text, r.SDG1, r.SDG2, r.words) for r in wide.collect()] == [("two words", 1, 0, 2)] and L.binary_labels(wide).first().labels == [1] + [0] * 16
    long = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("a", 1)], "text string, sdg int")
    assert {r.text: (r.sdg_1, r.sdg_2, r.sdg_3) for r in L.pivoted_labels(long).collect()} == {"a": (1, 0, 1), "b": (0, 1, 0)}
    paths = spark.createDataFrame([("/x/2022/vic/Some_Council_Rural_2023.pdf",), ("/x/NSW_Byron_Bay_Urban_2021.pdf",), ("/x/plain.pdf",)], "p string")
    got = [tuple(r) for r in paths.select(*(c.alias(k) for k, c in L.path_metadata(F.col("p")).items())).collect()]
    assert got == [("2022", "VIC", "Rural", "Some Council"), ("2021", "NSW", "Urban", "Byron Bay"), (None, None, None, "plain")]
    (tmp_path / "p" / "2024" / "QLD").mkdir(parents=True)
    (tmp_path / "p" / "2024" / "QLD" / "a.pdf").write_bytes(b"x")
    assert [(r.year, r.state) for r in L.discovered(spark, str(tmp_path / "p")).collect()] == [("2024", "QLD")]
    score = lambda text, title: spark.createDataFrame([(text, title)], "t string, h string").select(L.annual_report(F.col("t"), F.col("h"), ("annual report", "council", "financial", "mayor"))).first()[0]
    assert score("Council and mayor", "x") is True and score("council", "x") is False and score("council 2022-23", "x") is True and score("council", "Annual Report") is True
    goals = spark.createDataFrame([(1, "No Poverty", "End it", ["rates relief"], [], ["poor", "income"])], "goal int, name string, description string, local_keywords array<string>, indicators array<string>, keywords array<string>")
    assert {r.variant: r.text for r in A.goal_variants(goals).collect()} == {"core": "No Poverty. End it", "local": "rates relief", "keywords": "poor income"}
