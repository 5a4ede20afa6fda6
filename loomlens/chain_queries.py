"""Queries from texts to corrected reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import corrections_queries as CQ
from .functions import lexicons as L
from .operators import alignment as A
from .operators import corrections as C
from .operators import reporting as R
from .plans.facts import VECTOR_FACTS, table, vector_facts
from .plans.sql import rounded

QUERIES: dict = {}


def _activities(spark, sf_dir):
    """A document is a report and each of its lines an activity, with a phrase of the corrections' words picked by its place."""
    n, words = len(CQ.PHRASES), F.array(*map(F.lit, CQ.PHRASES))
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    phrase = lambda a, b: F.get(words, ((F.col("doc_id") * a + F.col("pos") * b) % n).cast("int"))
    return lines.select("doc_id", "pos", F.concat_ws(" ", phrase(7, 13), "line", phrase(31, 5)).alias("text"))


def _goals(spark):
    return R.goal_vectors(spark, R.goal_texts(), R.hashed_vector)


def report_from_lines(spark, sf_dir):
    return R.reported(R.aligned(_activities(spark, sf_dir), _goals(spark)), "doc_id", "pos")


def report_from_texts(spark, sf_dir):
    """Activities are extracted as they are from reports: paragraphs, bullets and sentences of twenty words and more."""
    return R.from_texts(table(spark, sf_dir, "documents"), "doc_id")


def _sql() -> str:
    n, listed = len(CQ.PHRASES), "[" + ", ".join(map(CQ._q, CQ.PHRASES)) + "]"
    bucket = lambda w: f"('0x' || left(md5({w}), 4))::INTEGER % {R.DIMS}"
    vector = lambda t: f"list_transform(range(0, {R.DIMS}), lambda d: len(list_filter(list_transform(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''), lambda w: {bucket('w')}), lambda x: x = d))::DOUBLE)"
    goals = ", ".join(f"({g}, {CQ._q(t)})" for g, t in R.goal_texts().items())
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    one = lambda g: f"(SELECT v FROM gv WHERE goal = {g})"
    cosine = lambda g: f"CASE WHEN n > 0 THEN {dot('v', one(g))} / (sqrt(n) * (SELECT sqrt(n) FROM gv WHERE goal = {g})) ELSE 0.0 END"
    rules, last = CQ._rules_sql(tuple(C.MODULES))
    boost, last = CQ._boost_sql(last)
    best = "greatest(" + ", ".join(f"s{g}" for g in C.GOALS) + ")"
    top = "CASE " + " ".join(f"WHEN s{g} = {best} THEN {g}" for g in C.GOALS) + " END"
    each = " UNION ALL ".join(f"SELECT doc_id, {g} AS goal, s{g} AS score, coalesce(a{g}, false) AS is_aligned, ({top}) = {g} AS is_first FROM {last}" for g in C.GOALS)
    return (
        f"WITH gt AS (SELECT * FROM (VALUES {goals}) t(goal, text)), g0 AS (SELECT goal, {vector('text')} AS v FROM gt), gv AS (SELECT goal, v, {dot('v', 'v')} AS n FROM g0), "
        f"ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL), "
        f"tx AS (SELECT doc_id, pos, ph[(doc_id * 7 + pos * 13) % {n} + 1] || ' ' || line || ' ' || ph[(doc_id * 31 + pos * 5) % {n} + 1] AS text FROM ln, (SELECT {listed} AS ph)), "
        f"v0 AS MATERIALIZED (SELECT *, {vector('text')} AS v FROM tx), v1 AS (SELECT *, {dot('v', 'v')} AS n FROM v0), u AS MATERIALIZED (SELECT doc_id, pos, lower(text) AS t, {', '.join(f'{cosine(g)} AS u{g}' for g in C.GOALS)} FROM v1), "
        f"x AS (SELECT *, {', '.join(f'round(u{g}, 4) AS s{g}' for g in C.GOALS)} FROM u){CQ._flags_sql('u')}{rules}{boost}, e AS ({each}) "
        f"SELECT doc_id, goal, count(*) AS activities, sum(is_aligned::INT)::BIGINT AS aligned, {rounded('sum(round(score * 1e6)::BIGINT)', 'count(*)', 1_000_000)} AS mean_score, "
        f"{rounded('sum(is_aligned::INT)', 'count(*)', 1)} AS coverage, sum(is_aligned::INT) = 0 AS is_gap, sum(is_first::INT)::BIGINT AS firsts FROM e GROUP BY 1, 2"
    )


QUERIES["report_from_lines"] = (report_from_lines, _sql())
QUERIES["report_from_texts"] = (report_from_texts, None)

# Context: weights of a section, then alignment, counts and explanation of the new scores.
_SECTIONS = tuple(L.SECTION_WEIGHTS)


def context_realigned(spark, sf_dir):
    f = vector_facts(spark, sf_dir).select("vec_id", "goal", "score", F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("vec_id") % len(_SECTIONS) + 1).cast("int")).alias("section"))
    return A.realigned(A.context_weighted(f, "section", digits=8), ["vec_id"], "sentence_transformer", {g: 0.3 for g in range(1, 18)}).drop("section")


_CW = "CASE " + " ".join(f"WHEN section = '{s}' AND goal = {g} THEN {w}::DOUBLE" for s, own in L.SECTION_WEIGHTS.items() for g, w in own.items()) + " ELSE 1.0::DOUBLE END"
QUERIES["context_realigned"] = (
    context_realigned,
    VECTOR_FACTS + f""", s AS (SELECT vec_id, goal, score, ([{', '.join(f"'{s}'" for s in _SECTIONS)}])[vec_id % {len(_SECTIONS)} + 1] AS section FROM f),
w AS (SELECT vec_id, goal, round(least(1.0, score * (1 + ({_CW} - 1) * 0.3)), 8) AS score FROM s), a AS (SELECT *, score >= 0.3 AS is_aligned FROM w),
n AS (SELECT vec_id, sum(is_aligned::INT)::INTEGER AS num_aligned, arg_max(goal, (score, -goal)) AS g, max(score) AS m FROM a GROUP BY 1)
SELECT vec_id, goal, score, is_aligned, num_aligned, CASE WHEN m > 0 THEN 'goal ' || g || CASE WHEN m >= 0.7 THEN ' strongly, ' WHEN m >= 0.5 THEN ' moderately, ' ELSE ' weakly, ' END || num_aligned || ' aligned' ELSE 'no goal' END AS explanation FROM a JOIN n USING (vec_id)""",
)
