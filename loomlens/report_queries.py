"""Queries that read reports, councils and runs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import alignment as A
from .operators import evaluation as E
from .operators import extraction as EX
from .operators import reads as Q
from .operators import trends as TR
from .plans.facts import ORDER_FACTS as OF
from .plans.facts import VECTOR_FACTS as VF
from .plans.facts import order_facts, table, vector_facts
from .plans.sql import MEAN, SHARE, fitted, rounded, yearly

QUERIES: dict = {}


def over_orders(name, f, sql):
    QUERIES[name] = (lambda spark, sf_dir: f(order_facts(spark, sf_dir)), OF + sql)


def over_vectors(name, f, sql):
    QUERIES[name] = (lambda spark, sf_dir: f(aligned_vectors(spark, sf_dir)), VF + ", v AS (SELECT *, floor(score * 1000)::BIGINT AS milli, score >= 0.1 AS is_aligned FROM f) " + sql)


def aligned_vectors(spark, sf_dir):
    return vector_facts(spark, sf_dir).withColumns({"milli": F.floor(F.col("score") * 1000).cast("long"), "is_aligned": F.col("score") >= 0.1})


_GOALS = "coalesce(string_agg(goal::VARCHAR, ',' ORDER BY {0} DESC, goal) FILTER (WHERE {1} <= 5), '')"
over_orders("comparison_rows", lambda f: Q.comparison(f, Q.REPORT), f", p AS (SELECT council, year, goal, count(*) AS n, sum(milli) AS s, {MEAN} AS m, {SHARE} AS c FROM f GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY council, year ORDER BY m DESC, goal) AS rm, row_number() OVER (PARTITION BY council, year ORDER BY c DESC, goal) AS rc FROM p) SELECT council, year, sum(n)::BIGINT AS activities, {rounded('sum(s)', 'sum(n)', 1000)} AS mean_score, {_GOALS.format('m', 'rm')} AS top_by_mean, {_GOALS.format('c', 'rc')} AS top_by_coverage FROM r GROUP BY 1, 2")
for _by in ("state", "year"):
    over_orders(f"{_by}_analysis", lambda f, by=_by: Q.groups_of_reports(f, Q.REPORT, by), f"SELECT {_by}, count(DISTINCT (council, year)) AS reports, count(*) AS activities, {MEAN} AS mean_score, {SHARE} AS coverage FROM f WHERE {_by} IS NOT NULL AND {_by}::VARCHAR <> 'Unknown' GROUP BY 1 HAVING count(DISTINCT (council, year)) >= 2")
over_orders("coverage_by_threshold", lambda f: Q.covered_councils(f, "setting", 950), f", p AS (SELECT setting, council, goal, max((milli > 950)::INT) AS hit FROM f GROUP BY 1, 2, 3) SELECT setting, goal, {rounded('sum(hit)', 'count(*)', 1)} AS coverage, count(*) AS councils FROM p GROUP BY 1, 2")
over_orders("samples_of_top_goals", lambda f: f.join(F.broadcast(Q.top_goals(f, 3).select("goal")), "goal", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("milli"), "activity_id"))).where("rank <= 3").select("goal", "rank", "activity_id", "milli"), f", t AS (SELECT goal FROM f GROUP BY 1 ORDER BY {MEAN} DESC, goal LIMIT 3) SELECT goal, row_number() OVER (PARTITION BY goal ORDER BY milli DESC, activity_id)::INTEGER AS rank, activity_id, milli FROM f WHERE goal IN (SELECT goal FROM t) QUALIFY rank <= 3")
over_orders("top_goals", Q.top_goals, f"SELECT goal, {MEAN} AS mean_score, count(*) AS n, row_number() OVER (ORDER BY {MEAN} DESC, goal)::INTEGER AS rank FROM f GROUP BY 1 QUALIFY rank <= 5")
over_orders("latest_year_shares", lambda f: f.join(F.broadcast(f.agg(F.max("year").alias("year"))), "year", "left_semi").groupBy("state", "setting", "goal").agg(F.count("*").alias("n"), Q.share(F.col("is_aligned")).alias("coverage")), f"SELECT state, setting, goal, count(*) AS n, {SHARE} AS coverage FROM f WHERE year = (SELECT max(year) FROM f) GROUP BY 1, 2, 3")
over_vectors("council_detail", lambda f: Q.evidence(f, ["report_id"], "vec_id"), "SELECT report_id, goal, count(*) OVER (PARTITION BY report_id, goal) AS aligned, row_number() OVER (PARTITION BY report_id, goal ORDER BY milli DESC, vec_id)::INTEGER AS rank, vec_id, milli, coalesce((SELECT string_agg(o.goal::VARCHAR, ',' ORDER BY o.goal) FROM v o WHERE o.vec_id = v.vec_id AND o.is_aligned AND o.goal <> v.goal), '') AS also FROM v WHERE is_aligned QUALIFY rank <= 3")
_NATIONAL = f", p AS (SELECT {{0}}, goal, sum(is_aligned::INT)::BIGINT AS a FROM {{1}} GROUP BY {{0}}, goal), n AS (SELECT count(DISTINCT {{2}}) AS n FROM {{1}}) SELECT goal, {rounded('sum(a)', 'any_value(n)', 1)} AS share, sum((a > 0)::INT)::BIGINT AS reports_with FROM p, n GROUP BY 1"
over_orders("national_coverage", lambda f: Q.national(f, Q.REPORT, "activity_id"), _NATIONAL.format("council, year", "f", "activity_id"))
over_vectors("national_coverage_all_goals", lambda f: Q.national(f, ["report_id"], "vec_id"), _NATIONAL.format("report_id", "v", "vec_id"))
over_orders("median_goals", lambda f: Q.median_goals(f, "council", "year"), ", p AS (SELECT council, year, count(DISTINCT CASE WHEN is_aligned THEN goal END) AS goals FROM f GROUP BY 1, 2), l AS (SELECT council, arg_max(goals, year) AS goals FROM p GROUP BY 1) SELECT count(*) AS councils, median(goals)::DOUBLE AS median_goals FROM l")
_PAGES = lambda f: f.groupBy(*Q.REPORT).agg((F.count("*") * 3 % 7 * 30).alias("pages"))
over_orders("report_summary", lambda f: Q.normalised(f, _PAGES(f), Q.REPORT), ", p AS (SELECT council, year, goal, count(*) AS n, sum(is_aligned::INT)::BIGINT AS a FROM f GROUP BY 1, 2, 3), r AS (SELECT council, year, sum(n)::BIGINT AS activities, sum(n)::BIGINT * 3 % 7 * 30 AS pages, sum(n - a)::BIGINT AS barren, coalesce(string_agg(goal::VARCHAR, ',' ORDER BY goal) FILTER (WHERE a = 0), '') AS gaps FROM p GROUP BY 1, 2) SELECT *, CASE WHEN pages > 0 THEN round(activities * 100.0::DOUBLE / pages, 1) END AS per_100_pages, CASE WHEN pages <= 0 THEN 'unknown' WHEN activities * 100.0::DOUBLE / pages >= 40 THEN 'rich' WHEN activities * 100.0::DOUBLE / pages >= 15 THEN 'moderate' ELSE 'thin' END AS extraction FROM r")
_RUNS = lambda f: f.groupBy(*Q.REPORT).agg(F.count("*").alias("activities"), F.count_distinct(F.when(F.col("is_aligned"), F.col("goal"))).alias("goals")).withColumns({"status": F.when(F.col("activities") % 5 == 0, "failed").when(F.col("activities") % 7 == 0, "queued").otherwise("completed"), "published": F.col("activities") % 2 == 0})
_RUNS_SQL = ", r AS (SELECT council, year, count(*) AS activities, count(DISTINCT CASE WHEN is_aligned THEN goal END) AS goals FROM f GROUP BY 1, 2), runs AS (SELECT *, CASE WHEN activities % 5 = 0 THEN 'failed' WHEN activities % 7 = 0 THEN 'queued' ELSE 'completed' END AS status, activities % 2 = 0 AS published FROM r) "
over_orders("run_stats", lambda f: Q.run_stats(_RUNS(f)), _RUNS_SQL + "SELECT count(*) AS total, sum((status = 'completed')::INT)::BIGINT AS completed, sum((status = 'completed' AND published)::INT)::BIGINT AS published, sum(CASE WHEN status = 'completed' THEN activities END)::BIGINT AS activities, round(avg(CASE WHEN status = 'completed' THEN goals::DOUBLE END), 6) AS mean_goals FROM runs")
over_orders("newest_runs", lambda f: _RUNS(f).orderBy(F.desc("year"), "council").limit(50), _RUNS_SQL + "SELECT * FROM runs ORDER BY year DESC, council LIMIT 50")
over_orders("publish_all", lambda f: Q.published(_RUNS(f), F.lit(True)), _RUNS_SQL + "SELECT council, year, activities, goals, status, published OR status = 'completed' AS published FROM runs")
over_orders("compare_runs", lambda f: Q.by_ids(_RUNS(f).withColumn("id", F.concat_ws(":", "council", "year")), "id", ["NATION_1:1996", "NATION_2:1997", "NOWHERE:1"])[0], _RUNS_SQL + "SELECT *, council || ':' || year AS id FROM runs WHERE council || ':' || year IN ('NATION_1:1996', 'NATION_2:1997', 'NOWHERE:1')")
over_orders("missing_runs", lambda f: Q.by_ids(_RUNS(f).withColumn("id", F.concat_ws(":", "council", "year")), "id", ["NATION_1:1996", "NATION_2:1997", "NOWHERE:1"])[1], _RUNS_SQL + "SELECT x AS id FROM (SELECT unnest(['NATION_1:1996', 'NATION_2:1997', 'NOWHERE:1']) AS x) WHERE x NOT IN (SELECT council || ':' || year FROM runs)")
over_orders("depth_ratio", lambda f: Q.depth(f.where("is_aligned").withColumn("group", F.concat_ws(":", "council", "goal")), "group"), ", n AS (SELECT council || ':' || goal AS g, count(*) AS n FROM f WHERE is_aligned GROUP BY 1) SELECT a.g AS deep, b.g AS shallow, round(a.n::DOUBLE / b.n, 4) AS ratio FROM n a JOIN n b ON a.n > 2 * b.n")
over_orders("setting_spread", lambda f: f.where("is_aligned").groupBy("goal", "setting").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("n"), "setting"))), "SELECT goal, setting, count(*) AS n, row_number() OVER (PARTITION BY goal ORDER BY count(*) DESC, setting)::INTEGER AS rank FROM f WHERE is_aligned GROUP BY 1, 2")
over_orders("peer_means", lambda f: Q.peer_means(f, "state"), f", p AS (SELECT state, council, year, count(DISTINCT goal) AS goals FROM f WHERE is_aligned GROUP BY 1, 2, 3) SELECT state, year, {rounded('sum(goals)', 'count(*)', 1)} AS mean_goals FROM p GROUP BY 1, 2")
over_orders("council_share", lambda f: Q.council_share(f), f", g AS (SELECT * FROM f), p AS (SELECT council, goal, max(is_aligned::INT) AS hit FROM g GROUP BY 1, 2), n AS (SELECT count(DISTINCT council) AS c FROM g) SELECT goal, {rounded('sum(hit)', 'any_value(c)', 1)} AS share FROM p, n GROUP BY 1")
over_orders("two_reports", lambda f: Q.two_reports(f, F.col("year") == 1995, F.col("year") == 1997, 498), f", a AS (SELECT goal, {MEAN} AS m FROM f WHERE year = 1995 GROUP BY 1), b AS (SELECT goal, {MEAN} AS m FROM f WHERE year = 1997 GROUP BY 1), j AS (SELECT goal, coalesce(a.m, 0) AS first, coalesce(b.m, 0) AS second FROM a FULL JOIN b USING (goal)) SELECT goal, first, second, round(second - first, 6) AS difference, first > 0.498::DOUBLE AS first_covers, second > 0.498::DOUBLE AS second_covers FROM j")
over_vectors("heatmap_top50", lambda f: f.groupBy("vec_id").agg(F.max("milli").alias("best"), *(F.max(F.when(F.col("goal") == g, F.col("milli"))).alias(f"goal_{g}") for g in range(1, 11))).orderBy(F.desc("best"), "vec_id").limit(50), "SELECT vec_id, max(milli) AS best, " + ", ".join(f"max(CASE WHEN goal = {g} THEN milli END) AS goal_{g}" for g in range(1, 11)) + " FROM v GROUP BY 1 ORDER BY best DESC, vec_id LIMIT 50")
over_orders("score_diagnostics", lambda f: Q.diagnostics(f, "council"), f", r AS (SELECT 'all' AS of, milli FROM f UNION ALL SELECT 'best', max(milli) FROM f GROUP BY council) SELECT of, count(*) AS n, min(milli) AS low, max(milli) AS high, {MEAN} AS mean_score, median(milli)::DOUBLE AS median, round(sqrt((count(*) * sum(milli * milli) - sum(milli) * sum(milli))::DOUBLE) / count(*), 4) AS deviation FROM r GROUP BY 1")
over_vectors("top_counts", lambda f: Q.top_counts(f, "vec_id"), ", b AS (SELECT goal FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY milli DESC, goal) = 1) SELECT v.goal, max(milli) AS largest, (SELECT count(*) FROM b WHERE b.goal = v.goal) AS firsts FROM v GROUP BY 1")
over_orders("activities_search", lambda f: Q.page(f, "activity_id", 3, "nation_1", "council", 2, 40).select("activity_id", "council", "milli", "total"), "SELECT activity_id, council, milli, count(*) OVER () AS total FROM f WHERE goal = 3 AND is_aligned AND contains(lower(council), 'nation_1') ORDER BY activity_id LIMIT 40 OFFSET 40")
_CS = ", c AS (SELECT council, trim(regexp_replace(lower(council), '[^a-z0-9]+', '-', 'g'), '-') AS slug, state, list_sort(list(DISTINCT year)) AS years, count(DISTINCT CASE WHEN is_aligned THEN goal END) AS goals, count(*) AS n FROM f GROUP BY council, state), s AS (SELECT council, arg_max(setting, (n, setting)) AS setting FROM (SELECT council, setting, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1) "
over_orders("browse_filtered", lambda f: Q.browse(Q.councils(f), name="NATION_1", year=1996).select("council", "slug", "state", "goals"), _CS + "SELECT council, slug, state, goals FROM c WHERE contains(lower(council), 'nation_1') AND list_contains(years, 1996) ORDER BY goals DESC, council")
over_orders("council_by_slug", lambda f: Q.councils(f).where("slug = 'nation-7'").select("council", "state", "goals", F.size("years").cast("long").alias("years")), _CS + "SELECT council, state, goals, len(years)::BIGINT AS years FROM c WHERE slug = 'nation-7'")
over_orders("search_box", lambda f: Q.search_box(Q.councils(f).withColumn("postcodes", F.array(F.concat(F.lit("2"), F.regexp_extract("council", "([0-9]+)$", 1)))), "21").select("council"), _CS + "SELECT council FROM c WHERE contains(lower(council), '21') OR starts_with('2' || regexp_extract(council, '([0-9]+)$', 1), '21') ORDER BY council LIMIT 7")
over_orders("peers_of_state_or_setting", lambda f: Q.peers(f.groupBy("council", "state").agg(F.max("setting").alias("setting"))), ", p AS (SELECT council, state, max(setting) AS setting FROM f GROUP BY 1, 2) SELECT DISTINCT a.council, b.council AS peer FROM p a JOIN p b ON (a.state = b.state OR a.setting = b.setting) AND a.council <> b.council")
over_orders("year_or_latest", lambda f: Q.year_or_latest(Q.councils(f), 1996), ", c AS (SELECT council, list(DISTINCT year) AS y FROM f GROUP BY 1) SELECT council, CASE WHEN list_contains(y, 1996) THEN 1996 ELSE list_max(y) END AS year FROM c")
over_orders("setting_sorted", lambda f: f.where("setting = 'Urban'").orderBy(F.desc("milli"), "activity_id").limit(100).select("activity_id", "setting", "milli"), "SELECT activity_id, setting, milli FROM f WHERE setting = 'Urban' ORDER BY milli DESC, activity_id LIMIT 100")
QUERIES["reference_goals"] = (
    lambda spark, sf_dir: Q.reference_goals(spark).join(table(spark, sf_dir, "embeddings").groupBy((F.col("label") + 1).alias("goal")).agg(F.count("*").alias("vectors")), "goal", "left"),
    "SELECT goal, name, vectors FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in Q.GOAL_NAMES.items()) + ") t(goal, name) LEFT JOIN (SELECT label + 1 AS goal, count(*) AS vectors FROM embeddings GROUP BY 1) USING (goal)",
)

# Trends
_DENSE = ", y AS (SELECT council, year, goal, {0} AS score FROM f GROUP BY 1, 2, 3), g AS (SELECT DISTINCT council, year, k::INTEGER AS goal FROM f, (SELECT unnest(range(1, 8)) AS k)), d AS (SELECT council, goal, year, coalesce(score, 0) AS score FROM g LEFT JOIN y USING (council, year, goal))"
_SCORES = lambda f: f.groupBy("council", "year", "goal").agg(Q.mean().alias("score"))
over_orders("report_scores", lambda f: TR.dense(_SCORES(f), ["council", "year"], range(1, 8)), _DENSE.format(MEAN) + " SELECT council, year, goal, score FROM d")
over_orders("council_trends", lambda f: TR.with_p_value(TR.dense(_SCORES(f), ["council", "year"], range(1, 8)), ["council", "goal"]), _DENSE.format(MEAN) + fitted("council, goal", "d") + " SELECT * FROM q")
over_orders("overall_trends", lambda f: TR.with_p_value(TR.yearly_means(f, Q.REPORT, []), ["goal"]), yearly("", "f") + fitted("goal", "y") + " SELECT * FROM q")
over_orders("urban_trends", lambda f: TR.with_p_value(TR.yearly_means(f.where("setting = 'Urban'"), Q.REPORT, ["state"]), ["state", "goal"]), ", e AS (SELECT * FROM f WHERE setting = 'Urban')" + yearly("state", "e") + fitted("state, goal", "y") + " SELECT * FROM q")
over_orders("trend_table", lambda f: f.groupBy("goal").agg(F.array_join(F.array_sort(F.collect_set("year")), ", ").alias("years"), F.count_distinct("year").alias("n")), "SELECT goal, string_agg(DISTINCT year::VARCHAR, ', ' ORDER BY year::VARCHAR) AS years, count(DISTINCT year) AS n FROM f GROUP BY 1")
over_orders("strongest_trends", lambda f: TR.strongest(TR.trends(f.groupBy("council", "goal", "year").agg(Q.mean().alias("score")), ["council", "goal"]), ["council", "goal"]), f", d AS (SELECT council, goal, year, {MEAN} AS score FROM f GROUP BY 1, 2, 3) SELECT council, goal, round(regr_slope(score, year), 8) AS slope FROM d GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY abs(round(regr_slope(score, year), 8)) DESC, council, goal LIMIT 5")


# Texts: pieces, counts and activities
def over_docs(name, f, sql=None):
    QUERIES[name] = (lambda spark, sf_dir: f(table(spark, sf_dir, "documents")), sql)


over_docs("paragraphs", lambda d: d.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph")), "SELECT doc_id, i::INTEGER AS pos, p[i + 1] AS paragraph FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents))".replace("\\\\", "\\"))
over_docs("bullets", lambda d: d.select("doc_id", F.size(T.bullets(F.col("text"))).alias("pieces")), r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\s*[•·\-–—*]\s+'), lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS pieces FROM documents")
over_docs("normalized", lambda d: d.select("doc_id", F.md5(T.normalized(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).alias("digest")), r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
over_docs("action_verbs", lambda d: d.select("doc_id", T.has_action_verb(F.col("text"), ("tion", "rewh", "ther", "orre", "the", "and")).alias("has_verb"), T.simple_confidence(F.col("text")).alias("confidence")), r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(tion|rewh|ther|orre|the|and)($|[^\p{L}\p{N}_])') AS has_verb, CASE WHEN " + " OR ".join(f"contains(lower(text), '{v}')" for v in T.L.PRIORITY_VERBS) + " THEN 0.9::DOUBLE WHEN " + " OR ".join(f"contains(lower(text), '{v}')" for v in T.L.STANDARD_VERBS) + " THEN 0.7::DOUBLE WHEN " + " OR ".join(f"contains(lower(text), '{v}')" for v in T.L.WEAK_VERBS) + " THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents")
over_docs("summary_stats", lambda d: d.select("doc_id", *(c.alias(k) for k, c in T.summary_stats(F.col("text")).items())))
over_docs("candidates", lambda d: EX.candidates(d, "doc_id"))
over_docs("extract_activities", lambda d: EX.extracted(d, "doc_id", 0.3))  # invented prose has few of the words that raise a score
over_docs("activity_sections", lambda d: EX.by_section(EX.extracted(d, "doc_id", 0.3), "doc_id"))
over_docs("filter_failures", lambda d: EX.failures(EX.candidates(d, "doc_id")))
QUERIES["quality_tiers"] = (lambda spark, sf_dir: EX.tiers(table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 11 / 10.0).alias("is_activity"), (F.col("vec_id") % 7 / 6.0).alias("is_council")), "label"), "SELECT label, CASE WHEN least(vec_id % 11 / 10.0::DOUBLE, vec_id % 7 / 6.0::DOUBLE) >= 0.7::DOUBLE THEN 'high' WHEN least(vec_id % 11 / 10.0::DOUBLE, vec_id % 7 / 6.0::DOUBLE) >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 4) AS share FROM embeddings GROUP BY 1, 2")


# Evaluation and sampling
def over_labels(name, f, sql):
    """Over vectors with labels of several goals: y is whether goal and truth are near, p and q two models' predictions."""
    pre = VF + ", l AS (SELECT vec_id, goal, truth, score, (abs(goal - truth) <= vec_id % 3)::INT AS y, (score >= 0.1)::INT AS p, floor(greatest(0, least(0.999, score)) * 1000)::BIGINT AS milli, (vec_id % 4)::INTEGER AS fold FROM f) "
    QUERIES[name] = (lambda spark, sf_dir: f(labelled(spark, sf_dir)), pre + sql)


def labelled(spark, sf_dir):
    c = F.col
    return vector_facts(spark, sf_dir).select("vec_id", "goal", "truth", "score", (F.abs(c("goal") - c("truth")) <= c("vec_id") % 3).cast("int").alias("y"), (c("score") >= 0.1).cast("int").alias("p"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999), c("score"))) * 1000).cast("long").alias("milli"), (c("vec_id") % 4).cast("int").alias("fold"))


_PG = "pg AS (SELECT goal, sum((y = 1 AND p = 1)::INT)::BIGINT AS tp, sum((y = 0 AND p = 1)::INT)::BIGINT AS fp, sum((y = 1 AND p = 0)::INT)::BIGINT AS fn, sum((y = 0 AND p = 0)::INT)::BIGINT AS tn FROM {0} GROUP BY 1)"
_R = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
_MM = f"SELECT round({_R('sum(tp)', 'sum(tp + fp)')}, 6) AS micro_precision, round({_R('sum(tp)', 'sum(tp + fn)')}, 6) AS micro_recall, round({_R('2 * sum(tp)', 'sum(2 * tp + fp + fn)')}, 6) AS micro_f1, round(avg({_R('tp', 'tp + fp')}), 6) AS macro_precision, round(avg({_R('tp', 'tp + fn')}), 6) AS macro_recall, round(avg({_R('2 * tp', '2 * tp + fp + fn')}), 6) AS macro_f1, (SELECT round(avg(ok), 6) FROM (SELECT min((y = p)::INT) AS ok FROM {{0}} GROUP BY vec_id)) AS subset_accuracy FROM pg"
_FORCED = "h AS (SELECT vec_id, goal, truth, y, (score >= 0.25 OR (max(score) OVER (PARTITION BY vec_id) < 0.25 AND row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, goal) = 1))::INT AS p FROM l)"
over_labels("goal_confusion", E.per_goal, ", " + _PG.format("l") + " SELECT * FROM pg")
over_labels("micro_macro", lambda f: E.micro_macro(f, "vec_id"), ", " + _PG.format("l") + " " + _MM.format("l"))
over_labels("forced_micro_macro", lambda f: E.micro_macro(E.forced(f, "vec_id", 0.25), "vec_id"), ", " + _FORCED + ", " + _PG.format("h") + " " + _MM.format("h"))
over_labels("label_cardinality", lambda f: E.cardinality(f, "vec_id"), ", k AS (SELECT vec_id, sum(y)::BIGINT AS k, count(*) AS n FROM l GROUP BY 1) SELECT least(k, 5) AS labels, count(*) AS n, (SELECT round(avg(k), 6) FROM k) AS cardinality, (SELECT round(avg(k / n), 6) FROM k) AS density FROM k GROUP BY 1")
over_labels("score_statistics", lambda f: E.score_statistics(f, ["goal", "y"]), "SELECT goal, y, count(*) AS n, min(milli) AS low, max(milli) AS high, round(sum(milli)::DOUBLE / count(*), 4) AS mean, round(sqrt((count(*) * sum(milli * milli) - sum(milli) * sum(milli))::DOUBLE) / count(*), 4) AS deviation, median(milli)::DOUBLE AS median FROM l GROUP BY 1, 2")
over_labels("model_compare", lambda f: E.compared(f.groupBy("vec_id").agg(F.first("truth").alias("truth"), (-F.max(F.struct("score", (-F.col("goal")).alias("g")))["g"]).alias("first"), F.min_by("goal", F.struct("score", "goal")).alias("second"))), ", c AS (SELECT vec_id, any_value(truth) AS truth, arg_min(goal, (-score, goal)) AS a, arg_min(goal, (score, goal)) AS b FROM l GROUP BY 1) SELECT count(*) AS n, sum((a = b)::INT)::BIGINT AS agree, sum((a = truth)::INT)::BIGINT AS first_right, sum((b = truth)::INT)::BIGINT AS second_right, sum((a = truth AND b = truth)::INT)::BIGINT AS both_right FROM c")
over_labels("cv_thresholds", lambda f: E.cross_validated(f.select("goal", "fold", F.col("y").cast("long").alias("y"), "milli"), ["goal"]), f", s AS (SELECT goal, fold, i::INTEGER AS i, sum((y = 1 AND milli >= i * 10)::INT)::BIGINT AS tp, sum((y = 0 AND milli >= i * 10)::INT)::BIGINT AS fp, sum((y = 1 AND milli < i * 10)::INT)::BIGINT AS fn FROM l, (SELECT unnest(range(1, 100)) AS i) GROUP BY 1, 2, 3), r AS (SELECT *, sum(tp) OVER w - tp AS a, sum(fp) OVER w - fp AS b, sum(fn) OVER w - fn AS c FROM s WINDOW w AS (PARTITION BY goal, i)), q AS (SELECT goal, fold, i, round({_R('2 * a', '2 * a + b + c')}, 6) AS inside, round({_R('2 * tp', '2 * tp + fp + fn')}, 6) AS outside FROM r) SELECT *, outside >= 0.9::DOUBLE * inside AS holds FROM q QUALIFY row_number() OVER (PARTITION BY goal, fold ORDER BY inside DESC, i DESC) = 1")
over_labels("boost_effects", lambda f: E.boost_effects(f.withColumns({"before": F.col("score") >= 0.2, "after": F.col("score") + (F.col("vec_id") % 3) * 0.1 >= 0.2})), "SELECT goal, sum((score + (vec_id % 3) * 0.1::DOUBLE >= 0.2::DOUBLE AND score < 0.2::DOUBLE)::INT)::BIGINT AS new, sum((y = 1 AND score + (vec_id % 3) * 0.1::DOUBLE >= 0.2::DOUBLE AND score < 0.2::DOUBLE)::INT)::BIGINT AS right, sum((y <> 1 AND score + (vec_id % 3) * 0.1::DOUBLE >= 0.2::DOUBLE AND score < 0.2::DOUBLE)::INT)::BIGINT AS wrong FROM l GROUP BY 1")
_KEY = "md5('42:' || vec_id)"
over_labels("signature_sample", lambda f: E.by_signature(f, "vec_id", 0.1), f", s AS (SELECT vec_id, coalesce(string_agg(goal::VARCHAR, ',' ORDER BY goal) FILTER (WHERE y = 1), '') AS signature FROM l GROUP BY 1) SELECT vec_id, signature FROM s QUALIFY row_number() OVER (PARTITION BY signature ORDER BY {_KEY}, vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY signature) * 0.1 + 0.5))")
over_labels("tier_sample", lambda f: E.allocated(f.where("goal = 1").withColumn("tier", F.when(F.col("score") >= 0.1, "A").when(F.col("score") >= 0, "B").otherwise("C")), "tier", "vec_id", {"A": 5, "B": 20}).select("vec_id", "tier"), f", t AS (SELECT vec_id, CASE WHEN score >= 0.1 THEN 'A' WHEN score >= 0 THEN 'B' ELSE 'C' END AS tier FROM l WHERE goal = 1) SELECT vec_id, tier FROM t QUALIFY row_number() OVER (PARTITION BY tier ORDER BY {_KEY}, vec_id) <= CASE tier WHEN 'A' THEN 5 WHEN 'B' THEN 20 ELSE 0 END")
over_labels("drawn_sample", lambda f: E.drawn(f.select("vec_id").distinct(), "vec_id", 40, f.where("score >= 0.3").select("vec_id").distinct()), f"SELECT vec_id FROM (SELECT DISTINCT vec_id FROM l WHERE vec_id NOT IN (SELECT vec_id FROM l WHERE score >= 0.3)) ORDER BY {_KEY}, vec_id LIMIT 40")
over_labels("goal_split", lambda f: E.test_split(f.where("goal = truth").select("vec_id", "truth"), "truth", "vec_id"), f"SELECT vec_id, truth, row_number() OVER (PARTITION BY truth ORDER BY {_KEY}, vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY truth) * 0.2 + 0.5)) AS is_test FROM l WHERE goal = truth")
over_labels("training_pairs", lambda f: E.training_pairs(f.where("goal = truth").select("vec_id", "goal"), f.select("goal").distinct().withColumn("variant", F.explode(F.array(F.lit("name"), F.lit("text")))), "vec_id").select("vec_id", "goal", "variant", "batch"), f"SELECT vec_id, goal, variant, (row_number() OVER (PARTITION BY goal ORDER BY {_KEY}, vec_id, variant) - 1)::INTEGER AS batch FROM l, (SELECT unnest(['name', 'text']) AS variant) WHERE goal = truth")
over_labels("single_label_summary", lambda f: E.single_label(f.groupBy("vec_id").agg(F.first("truth").alias("truth"), (-F.max(F.struct("score", (-F.col("goal")).alias("g")))["g"]).alias("predicted"))), f", c AS (SELECT any_value(truth) AS truth, arg_min(goal, (-score, goal)) AS q FROM l GROUP BY vec_id), u AS (SELECT truth AS k, 1 AS t, 0 AS p, 0 AS h FROM c UNION ALL SELECT q, 0, 1, (truth = q)::INT FROM c), s AS (SELECT k, sum(t)::BIGINT AS support, round({_R('sum(h)', 'sum(p)')}, 6) AS precision, round({_R('sum(h)', 'sum(t)')}, 6) AS recall, round({_R('2 * sum(h)', 'sum(t) + sum(p)')}, 6) AS f1 FROM u GROUP BY 1 HAVING sum(t) > 0) SELECT round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall, round(avg(f1), 5) AS macro_f1, round(avg({_R('5 * precision * recall', '4 * precision + recall')}), 5) AS macro_f2, round(sum(precision * support) / sum(support), 5) AS weighted_precision, round(sum(recall * support) / sum(support), 5) AS weighted_recall, round(sum(f1 * support) / sum(support), 5) AS weighted_f1, (SELECT round(avg((truth = q)::INT), 6) FROM c) AS accuracy FROM s")
over_labels("consensus_labels", lambda f: E.consensus(f.withColumn("vote", F.when(F.col("score") >= 0, "a").otherwise("b")).where("goal <= 5"), "vec_id", "goal", "vote", "milli", 5), ", v AS (SELECT vec_id, goal, milli, CASE WHEN score >= 0 THEN 'a' ELSE 'b' END AS vote FROM l WHERE goal <= 5) SELECT vec_id, string_agg(vote, '' ORDER BY goal) AS votes, CASE WHEN sum((vote = 'a')::INT) >= 3 THEN 'a' WHEN sum((vote = 'b')::INT) >= 3 THEN 'b' ELSE 'neutral' END AS consensus, round(avg(milli), 6) AS mean_score FROM v GROUP BY 1 HAVING count(DISTINCT goal) = 5")


# Similarity
def over_variants(name, f, sql):
    """Over the mean vectors of each goal's vectors with vec_id % 3 of 0, 1 and 2, as three variants."""
    pre = "WITH x AS (SELECT label + 1 AS goal, 'v' || vec_id % 3 AS variant, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label IS NOT NULL), m AS (SELECT goal, variant, i, avg(x) AS x FROM x GROUP BY 1, 2, 3), w AS (SELECT *, CASE variant WHEN 'v0' THEN 0.5 WHEN 'v1' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM m), s AS (SELECT goal, i, sum(w * x) / sum(w) AS x FROM w GROUP BY 1, 2), c AS (SELECT goal, i, x / sqrt(sum(x * x) OVER (PARTITION BY goal)) AS x FROM s)"
    QUERIES[name] = (lambda spark, sf_dir: f(A.combined(variants(spark, sf_dir), {"v0": 0.5, "v1": 0.3})), pre + sql)


def variants(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("label is not null")
    parts = v.select((F.col("label") + 1).alias("goal"), F.concat(F.lit("v"), F.col("vec_id") % 3).alias("variant"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("goal", "variant", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("goal", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("reference"))


over_variants("combined_embeddings", lambda g: g.select("goal", F.posexplode("reference").alias("i", "x")).select("goal", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x")), " SELECT goal, i, round(x, 5) AS x FROM c")
over_variants("goals_compared", lambda g: A.goals_compared(g).select("goal", "other", F.round("score", 4).alias("score")), " SELECT a.goal, b.goal AS other, round(round(sum(a.x * b.x), 6), 4) AS score FROM c a JOIN c b ON a.i = b.i AND a.goal <> b.goal GROUP BY 1, 2")
over_vectors("top_target", lambda f: A.top_target(f.select("vec_id", "goal", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("target"), "score").withColumn("score", F.round(F.col("score") * ((F.ascii("target") * 7 + F.col("vec_id")) % 5 + 1), 6)), ["vec_id"]), ", t AS (SELECT vec_id, goal, target, round(score * ((ascii(target) * 7 + vec_id) % 5 + 1), 6) AS score FROM f, (SELECT unnest(['a', 'b', 'c']) AS target)) SELECT vec_id, goal, target, score FROM t QUALIFY row_number() OVER (PARTITION BY vec_id, goal ORDER BY score DESC, target) = 1")
over_vectors("weighed_variants", lambda f: A.weighed_variants(f.select("vec_id", "goal", F.explode(F.array(F.lit("core"), F.lit("local"), F.lit("none"))).alias("variant"), "score").withColumn("score", F.when(F.col("variant") == "core", F.col("score")).otherwise(1 - F.col("score"))), ["vec_id"], {"core": 0.75, "local": 0.25}).withColumn("score", F.round("score", 7)), ", w AS (SELECT vec_id, goal, (0.75::DOUBLE * score + 0.25::DOUBLE * (1 - score)) / 1.0::DOUBLE AS score FROM f) SELECT vec_id, goal, round(score, 7) AS score FROM w")
over_vectors("second_model", lambda f: A.logits(f.select("vec_id", "goal", (F.col("score") * 8 - 1).alias("logit"))).select("vec_id", "goal", F.round("score", 6).alias("score")), " SELECT vec_id, goal, round(1 / (1 + exp(-(score * 8 - 1))), 6) AS score FROM f".lstrip())
over_docs("keyword_match", lambda d: d.select("doc_id", F.round(A.keyword_match(F.col("text"), F.array(*map(F.lit, ("tion", "REWH", "ther", "zzzz")))), 4).alias("share")), "SELECT doc_id, round((contains(lower(text), 'tion')::INT + contains(lower(text), 'rewh')::INT + contains(lower(text), 'ther')::INT) / 4, 4) AS share FROM documents")
