"""Queries over groups of reports, their words, targets and misses, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import alignment as A
from .operators import evaluation as E
from .operators import keywords as K
from .operators import rollups as R
from .plans.facts import ORDER_FACTS as OF
from .plans.facts import VECTOR_FACTS as VF
from .plans.facts import order_facts, table, vector_facts
from .plans.sql import MEAN, SHARE, rounded

QUERIES: dict = {}

# A document's score for a goal is the share of the goal's word pieces that it has.
GOAL_WORDS = {1: ("tion", "ther", "thon", "hely"), 2: ("rewh", "orre", "ment", "que"), 3: ("lich", "heit", "keit", "ung"), 4: ("the ", "and ", "zzzz", "les ")}


def _scored_docs(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("goal"), A.keyword_match(F.col("text"), F.array(*map(F.lit, words))).alias("score")) for g, words in GOAL_WORDS.items())))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", each.alias("x")).select("doc_id", "text", "x.goal", "x.score")
    return rows.withColumn("is_aligned", F.col("score") >= 0.25)


_PIECES = "CASE g " + " ".join(f"WHEN {g} THEN (" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ") / 4" for g, words in GOAL_WORDS.items()) + " END"
_IN = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"
QUERIES["aligned_words"] = (
    lambda s, d: K.aligned_words(_scored_docs(s, d), "text", 20),
    f"""WITH f AS (SELECT g::INTEGER AS goal, t FROM (SELECT lower(text) AS t, unnest([1, 2, 3, 4]) AS g FROM documents WHERE text IS NOT NULL) WHERE {_PIECES} >= 0.5),
w AS (SELECT goal, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS word FROM f), c AS (SELECT goal, word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN {_IN} GROUP BY 1, 2), a AS (SELECT goal, count(*) AS activities FROM f GROUP BY 1)
SELECT goal, word, n, activities, row_number() OVER (PARTITION BY goal ORDER BY n DESC, word)::INTEGER AS rank FROM c JOIN a USING (goal) QUALIFY rank <= 20""",
)
_GRAMS = " || ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in (1, 2, 3))
QUERIES["weighed_terms"] = (
    lambda s, d: K.weighed_terms(table(s, d, "documents").where("source is not null and text is not null"), "source", "doc_id"),
    f"""WITH d AS (SELECT source, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4 AND x NOT IN {_IN}) AS w FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({_GRAMS}) AS term FROM d) GROUP BY 1, 2, 3), n AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT source, term, sum(tf) AS total, count(*) AS df, any_value(n) AS n FROM tf JOIN n USING (source) GROUP BY 1, 2 HAVING count(*) <= 0.95 * any_value(n)),
k AS (SELECT source, term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY total DESC, term) <= 1000),
v AS (SELECT source, doc_id, term, df, tf * idf AS w FROM tf JOIN k USING (source, term)), l AS (SELECT source, doc_id, sqrt(sum(w * w)) AS length FROM v GROUP BY 1, 2),
s AS (SELECT source, term, df, round(sum(w / length), 4) AS weight FROM v JOIN l USING (source, doc_id) GROUP BY 1, 2, 3)
SELECT source, term, df, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
)

# Targets: two of each label, each put together from three variants, the mean vectors of the label's vectors by their number.
WEIGHTS = {"v0": 0.5, "v1": 0.3, "v2": 0.2}


def _targets(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("label is not null")
    name = F.concat_ws(".", F.col("label") + 1, F.floor(F.col("vec_id") / 3) % 2 + 1)
    parts = v.select(name.alias("goal"), F.concat(F.lit("v"), F.col("vec_id") % 3).alias("variant"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("goal", "variant", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    wide = means.groupBy("goal", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("reference"))
    return A.combined(wide, WEIGHTS)


def target_scores(spark, sf_dir):
    """Every vector with every target, as numbers of their goals."""
    rows = A.scored(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _targets(spark, sf_dir), "embedding", 5)
    return rows.select("vec_id", F.col("goal").alias("target"), F.substring_index("goal", ".", 1).cast("int").alias("goal"), "score")


_TARGETS = VF.rstrip() + """, tx AS (SELECT (label + 1) || '.' || ((vec_id // 3) % 2 + 1) AS target, label + 1 AS goal, 'v' || vec_id % 3 AS variant, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label IS NOT NULL),
tm AS (SELECT target, goal, variant, i, avg(x) AS x FROM tx GROUP BY 1, 2, 3, 4), tw AS (SELECT *, CASE variant WHEN 'v0' THEN 0.5 WHEN 'v1' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM tm), tr AS (SELECT target, goal, i, sum(w * x) / sum(w) AS x FROM tw GROUP BY 1, 2, 3),
tn AS (SELECT target, sqrt(sum(x * x)) AS n FROM tr GROUP BY 1), td AS (SELECT x.vec_id, tr.target, tr.goal, sum(x.x * tr.x) AS d FROM x JOIN tr USING (i) GROUP BY 1, 2, 3),
ts AS (SELECT td.vec_id, td.target, td.goal::INTEGER AS goal, round(coalesce(d / nullif(vn.n * tn.n, 0), 0), 5) AS score FROM td JOIN tn USING (target) JOIN vn USING (vec_id)) """  # fmt: skip
QUERIES["target_scores"] = (target_scores, _TARGETS + "SELECT vec_id, target, goal, score FROM ts")


def missed_goals(spark, sf_dir):
    f = vector_facts(spark, sf_dir).where("truth is not null").select("vec_id", "goal", "score", (F.col("goal") == F.col("truth")).cast("int").alias("y"))
    return E.missed(f, target_scores(spark, sf_dir), "vec_id", F.lit(0.4))


QUERIES["missed_goals"] = (
    missed_goals,
    _TARGETS + """, mf AS (SELECT vec_id, goal, score FROM f WHERE goal = truth AND score < 0.4), mr AS (SELECT *, count(*) OVER (PARTITION BY goal) AS misses FROM mf QUALIFY row_number() OVER (PARTITION BY goal ORDER BY md5('42:' || vec_id), vec_id) <= 200),
mb AS (SELECT vec_id, goal, max(score) AS best FROM ts GROUP BY 1, 2)
SELECT goal, any_value(misses) AS misses, count(*) AS looked_at, round(avg((best >= 0.4)::INT), 5) AS target_rate, round(avg(score), 5) AS mean_score, round(avg(best), 5) AS mean_target FROM mr LEFT JOIN mb USING (vec_id, goal) GROUP BY 1""",
)

_PLACED = lambda s, d: vector_facts(s, d).withColumns({"milli": F.greatest(F.floor(F.col("score") * 1000).cast("long"), F.lit(0)), "is_aligned": F.col("similarity") >= 0.2, "state": F.concat(F.lit("state "), F.col("report_id") % 3), "year": (2020 + F.floor(F.col("report_id") / 3) % 4).cast("int"), "group": F.col("report_id") % 5})
_P = VF.rstrip() + ", gg AS (SELECT *, greatest(floor(score * 1000)::BIGINT, 0) AS milli, similarity >= 0.2 AS is_aligned, 'state ' || report_id % 3 AS state, (2020 + (report_id // 3) % 4)::INTEGER AS year, report_id % 5 AS \"group\" FROM f) "
QUERIES["group_goals"] = (
    lambda s, d: R.group_alignment(_PLACED(s, d), "group", ["report_id"], "vec_id", ["state", "year"], threshold=0.1)[0],
    _P + f"SELECT \"group\", goal, {MEAN} AS mean_score, {SHARE} AS coverage, {MEAN} < 0.1 AS is_gap FROM gg GROUP BY 1, 2",
)
QUERIES["group_summary"] = (
    lambda s, d: R.group_alignment(_PLACED(s, d), "group", ["report_id"], "vec_id", ["state", "year"])[1],
    _P + f""", t AS (SELECT "group", report_id, state, year, vec_id, max(milli) AS top FROM gg GROUP BY 1, 2, 3, 4, 5), r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY top DESC, vec_id) AS r FROM t)
SELECT "group", count(*) AS activities, count(DISTINCT report_id) AS reports, {rounded('sum(top)', 'count(*)', 1000)} AS mean_top_score, string_agg(DISTINCT state, ',' ORDER BY state) AS state, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS year,
  string_agg(vec_id || ':' || top, ',' ORDER BY r) FILTER (WHERE r <= 10) AS best FROM r GROUP BY 1""",
)
QUERIES["report_headlines"] = (
    lambda s, d: R.headlines(_PLACED(s, d), ["report_id"], "vec_id"),
    _P + f""", l AS (SELECT report_id, goal, sum(is_aligned::INT)::BIGINT AS aligned, {MEAN} AS m FROM gg GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY sum(is_aligned::INT) DESC, {MEAN} DESC, goal) = 1),
z AS (SELECT report_id, count(DISTINCT vec_id) AS activities, arg_max({{'v': vec_id, 'g': goal, 'm': milli}}, (milli, -vec_id, -goal)) FILTER (WHERE is_aligned) AS x FROM gg GROUP BY 1)
SELECT report_id, activities, CASE WHEN aligned > 0 THEN goal END AS leading_goal, {rounded('aligned', 'activities', 1)} AS leading_share, x.v AS strongest, x.g AS strongest_goal, x.m AS milli FROM z JOIN l USING (report_id)""",
)
QUERIES["order_headlines"] = (
    lambda s, d: R.headlines(order_facts(s, d), ["council", "year"], "activity_id"),
    OF + f""", l AS (SELECT council, year, goal, sum(is_aligned::INT)::BIGINT AS aligned, {MEAN} AS m FROM f GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY council, year ORDER BY sum(is_aligned::INT) DESC, {MEAN} DESC, goal) = 1),
z AS (SELECT council, year, count(DISTINCT activity_id) AS activities, arg_max({{'v': activity_id, 'g': goal, 'm': milli}}, (milli, -activity_id, -goal)) FILTER (WHERE is_aligned) AS x FROM f GROUP BY 1, 2)
SELECT council, year, activities, CASE WHEN aligned > 0 THEN goal END AS leading_goal, {rounded('aligned', 'activities', 1)} AS leading_share, x.v AS strongest, x.g AS strongest_goal, x.m AS milli FROM z JOIN l USING (council, year)""",
)
