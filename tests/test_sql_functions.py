"""Functions that SQL uses, against the columns they stand for; tables out of HTML by hand."""

import pytest
from pyspark.sql import functions as F

from loomlens import sql_functions as SF
from loomlens.functions import text as T
from loomlens.operators import alignment as A


@pytest.fixture(scope="module")
def known(spark):
    SF.register(spark)
    return spark


def test_scalar_functions_are_the_rules(known):
    rows = known.createDataFrame([(g, t, s, a, b) for g in (1, 3, 17, 18) for t, s, a, b in (("Health & Waste — plan", "environment", 0.7, 0.7), ("ROADS", "finance", 0.5, 0.69), ("", None, 0.1, 1.0), (None, "x", None, 0.9))], "goal int, body string, section string, a double, b double")
    rows.createOrReplaceTempView("rule_rows")
    got = known.sql("SELECT *, goal_threshold(goal, 'sentence_transformer') AS th, goal_threshold(goal, 'none') AS nt, model_weight(goal) AS mw, section_of(body) AS so, normalized_text(body) AS no, slug_of(body) AS sl, rating_of(a, b) AS ra FROM rule_rows")
    c = F.col
    wrong = got.where(~(c("th").eqNullSafe(A.threshold(c("goal"), "sentence_transformer")) & c("nt").isNull() & c("so").eqNullSafe(T.section_type(c("body"))) & c("no").eqNullSafe(T.normalized(c("body"))) & c("sl").eqNullSafe(T.slug(c("body"))) & c("ra").eqNullSafe(T.rating(c("a"), c("b")))))
    assert got.count() == 16 and wrong.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan  # bodies are put in place


def test_gains_and_weights(known):
    row = known.sql("SELECT keyword_gain(3, 'Mental HEALTH') AS a, keyword_gain(3, 'roads') AS b, keyword_gain(2, 'health') AS c, section_weight('environment', 6) AS d, section_weight('x', 6) AS e").first()
    assert tuple(row) == (0.2, 0.0, 0.0, 1.5, 1.0)


def grid(spark, html):
    rows = spark.sql("SELECT c.* FROM {d} d, LATERAL html_cells(d.h) c", d=spark.createDataFrame([(html,)], "h string")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.table_no, {}).setdefault(r.row_no, {})[r.col_no] = r.value
    return {t: [[row[k] for k in sorted(row)] for _, row in sorted(rows.items())] for t, rows in out.items()}


@pytest.mark.parametrize(("html", "want"), [
    ("<table><tr><td>a<td>b<tr><td>c</table>", {0: [["a", "b"], ["c"]]}),
    ("<TABLE><TR><TH rowspan=2> x \n y </TH><TH colspan='2'>h</TH></TR><tr><td>1</td><td>2</td></tr></TABLE>", {0: [["x y", "h", "h"], ["x y", "1", "2"]]}),
    ("<table><tr><td rowspan=0>all</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>", {0: [["all", "1"], ["all", "2"], ["all", "3"]]}),
    ("<table><tr><td>1</td><td rowspan=3>d</td></tr><tr></tr><tr><td>2</td></tr></table>", {0: [["1", "d"], ["d"], ["2", "d"]]}),
    ("<table><tr><td>o<table><tr><td>i</td></tr></table>u</td></tr></table>", {0: [["ou"]], 1: [["i"]]}),
    ("<p>no<td>cell</td><table><tr><td>a &amp; b<br>c<script>x<y</script><style>s</style></td><td colspan=x>d</td>", {0: [["a & b c", "d"]]}),
    ("<table><tr><td colspan=3>a</td></tr><tr><td>b</td><td rowspan=2 colspan=2>c</td></tr><tr><td>d</td></tr></table>", {0: [["a", "a", "a"], ["b", "c", "c"], ["d", "c", "c"]]}),
    ("", {}), (None, {}), ("<table></table><table><tr><td></td></tr></table>", {1: [[""]]}),
])
def test_cells_of_tables(known, html, want):
    assert grid(known, html) == want


def test_no_span_is_beyond_bounds(known):
    got = grid(known, "<table><tr><td colspan=99999999>x</td><td>y</td></tr></table>")
    assert len(got[0][0]) == 1001 and got[0][0][-1] == "y"


def test_columns_follow_from_the_table(known):
    docs = known.createDataFrame([(1, "One two three. Four five! Six seven eight nine?  Ten.", 0.5), (2, None, 1.0), (3, "", 2.0)], "id int, body string, x double")
    got = known.sql("SELECT * FROM split_candidates(TABLE({d}), 'body', 3)", d=docs)
    assert got.dtypes == [("id", "int"), ("x", "double"), ("pos", "int"), ("statement", "string"), ("n_words", "int")]
    assert [tuple(r) for r in got.collect()] == [(1, 0.5, 0, "One two three.", 3), (1, 0.5, 1, "Six seven eight nine?", 4)]
    with pytest.raises(Exception, match="split_candidates takes"):
        known.sql("SELECT * FROM split_candidates(TABLE({d}), 'nothing', 3)", d=docs)
