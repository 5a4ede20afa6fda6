"""Queries over the driver's tables: name to (function of spark and folder, DuckDB SQL or None)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from . import chain_queries as CHQ
from . import corrections_queries as CQ
from . import group_queries as GQ
from . import page_queries as PQ
from . import report_queries as RQ
from . import sql_queries as SQ
from . import stream_queries as STQ
from . import workflow_queries as WQ
from .functions import text as T
from .operators import alignment as A
from .operators import evaluation as E
from .operators import keywords as K
from .operators import rollups as R
from .operators import topics as TP
from .operators import trends as TR
from .plans.facts import ORDER_FACTS as OF
from .plans.facts import VECTOR_FACTS as VF
from .plans.facts import order_facts, table, vector_facts
from .plans.sql import MEAN, SHARE, fitted, rounded, yearly
from .streaming import ingest as S

QUERIES: dict = {}
#: Words that do on the driver's invented prose what domain words do on reports.
PROSE = ("tion", "ther", "thon", "hely", "rewh", "orre")
PROGRAM = ((1, ("tion",), ("thon",), 0.4, {2: 0.15}), (2, ("ther",), ("hely",), 0.35, {3: 0.1, 1: 0.15}), (3, ("rewh",), ("orre",), 0.3, {1: 0.2}))


def query(sql=None, name=None):
    def put(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return put


def facts_query(name, f, sql):
    QUERIES[name] = (lambda spark, sf_dir: f(order_facts(spark, sf_dir)), OF + sql)


def vector_query(name, f, sql):
    QUERIES[name] = (lambda spark, sf_dir: f(vector_facts(spark, sf_dir)), VF + sql)


def docs_query(name, f, sql):
    """Over all documents."""
    QUERIES[name] = (lambda spark, sf_dir: f(table(spark, sf_dir, "documents")), sql)


# Similarity and alignment
@query("SELECT label + 1 AS goal, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings) WHERE label IS NOT NULL GROUP BY 1, 2")
def goal_centroids(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label") + 1)
    return A.centroids(v, "label", "embedding").select("goal", F.posexplode("reference").alias("i", "x")).select("goal", "i", F.round("x", 6).alias("x"))


@query("SELECT vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def topk_similar(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    first = v.where("vec_id = 0").select("embedding").first()
    return A.nearest(v.select("vec_id", "embedding"), first[0], 10, "embedding")


_MILLI = lambda: F.floor(F.col("score") * 1000).cast("long")
_ALIGNED = lambda f: f.withColumns({"is_aligned": F.col("similarity") >= A.threshold(F.col("goal"), "sentence_transformer"), "milli": _MILLI()})
_THR = "CASE goal " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(A.L.THRESHOLDS["sentence_transformer"][1], 1)) + " ELSE 0.52 END"
_VA = f", a AS (SELECT *, similarity >= {_THR} AS is_aligned, floor(score * 1000)::BIGINT AS milli FROM f) "
vector_query("goal_alignment_long", lambda f: _ALIGNED(f).drop("truth", "report_id", "similarity"), _VA + "SELECT vec_id, goal, score, is_aligned, milli FROM a")
vector_query("cosine_top_goal", lambda f: A.top_goal(f, ["vec_id"]).select("vec_id", "goal", "score"), "SELECT vec_id, goal, score FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, goal) = 1")
vector_query("report_alignment", lambda f: R.alignment(_ALIGNED(f), ["report_id"]), _VA + f"SELECT report_id, goal, count(*) AS n, {MEAN} AS mean_score, {SHARE} AS coverage FROM a GROUP BY 1, 2")
_GAP = f", r AS (SELECT report_id, goal, {MEAN} AS mean_score, {SHARE} AS coverage FROM a GROUP BY 1, 2) SELECT report_id, goal, mean_score"
vector_query("report_gaps_zero", lambda f: R.gaps(_ALIGNED(f), ["report_id"], "zero"), _VA + _GAP + " FROM r WHERE coverage = 0")
vector_query("report_gaps_threshold", lambda f: R.gaps(_ALIGNED(f), ["report_id"], "threshold", 0.52), _VA + _GAP + " FROM r WHERE mean_score < 0.52")
vector_query("report_gaps_ranked", lambda f: R.gaps(_ALIGNED(f), ["report_id"], "ranked"), _VA + _GAP + ", row_number() OVER (PARTITION BY report_id ORDER BY mean_score DESC, goal)::INTEGER AS rank FROM r WHERE coverage = 0")
_TWO = lambda f: f.select("vec_id", "goal", F.col("score").alias("st"), F.round(F.greatest(F.lit(0.0), 1 - (1 - F.col("score")) * 2), 6).alias("bert"))
_M = ", m AS (SELECT vec_id, goal, score AS st, round(greatest(0.0, 1 - (1 - score) * 2), 6) AS bert FROM f) "
_W = "CASE goal " + " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(A.L.MODEL_WEIGHTS, 1)) + " ELSE 0.5 END"
_ENS = lambda mode: lambda f: A.ensemble(_TWO(f), ["vec_id"], mode).select("vec_id", "goal", F.round("score", 10).alias("score"), "primary_model")
vector_query("ensemble_weighted", _ENS("weighted"), _M + f"SELECT vec_id, goal, round({_W} * bert + (1 - {_W}) * st, 10) AS score, 'ensemble' AS primary_model FROM m")
vector_query("ensemble_fallback", _ENS("fallback"), _M + "SELECT vec_id, goal, round(CASE WHEN w THEN bert ELSE st END, 10) AS score, CASE WHEN w THEN 'bert' ELSE 'st' END AS primary_model FROM (SELECT *, max(st) OVER (PARTITION BY vec_id) < 0.5 AS w FROM m)")
vector_query("ensemble_single", _ENS("single"), _M + "SELECT vec_id, goal, round(st, 10) AS score, 'st' AS primary_model FROM m")
# Two models: the similarities, and the same weighed by the second model's share of each goal.
vector_query(
    "model_agreement", lambda f: (lambda a, b: a.join(b, "vec_id").groupBy("first").agg(F.count("*").alias("n"), F.sum((F.col("first") == F.col("second")).cast("long")).alias("agree"), F.sum((F.col("first") == F.col("truth")).cast("long")).alias("first_right"), F.sum((F.col("second") == F.col("truth")).cast("long")).alias("second_right")))(
        A.top_goal(f, ["vec_id"]).select("vec_id", "truth", F.col("goal").alias("first")), A.top_goal(A.ensemble(_TWO(f), ["vec_id"], "weighted").withColumn("score", F.round("score", 10)), ["vec_id"]).select("vec_id", F.col("goal").alias("second"))),
    _M + f", a AS (SELECT vec_id, truth, goal AS first FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, goal) = 1), b AS (SELECT vec_id, goal AS second FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({_W} * bert + (1 - {_W}) * st, 10) DESC, goal) = 1) "
    "SELECT first, count(*) AS n, sum((first = second)::INT)::BIGINT AS agree, sum((first = truth)::INT)::BIGINT AS first_right, sum((second = truth)::INT)::BIGINT AS second_right FROM a JOIN b USING (vec_id) GROUP BY 1",
)
_SECTIONS = ("environment", "community", "economic", "governance")
_CW = "CASE " + " ".join(f"WHEN section = '{s}' AND goal = {g} THEN {w}::DOUBLE" for s in _SECTIONS for g, w in A.L.SECTION_WEIGHTS[s].items()) + " ELSE 1.0::DOUBLE END"
vector_query("context_weighted", lambda f: A.context_weighted(f.select("vec_id", "goal", "score", F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("vec_id") % 4 + 1).cast("int")).alias("section")), "section", digits=8), f", s AS (SELECT vec_id, goal, score, (['environment', 'community', 'economic', 'governance'])[vec_id % 4 + 1] AS section FROM f) SELECT vec_id, goal, section, round(least(1.0, score * (1 + ({_CW} - 1) * 0.3)), 8) AS score FROM s")
vector_query("alignment_matrix", lambda f: f.groupBy("vec_id").pivot("goal", list(range(1, 11))).agg(F.max("score")).na.fill(0.0).select("vec_id", *(F.col(str(g)).alias(f"goal_{g}") for g in range(1, 11))), "SELECT vec_id, " + ", ".join(f"coalesce(max(CASE WHEN goal = {g} THEN score END), 0.0) AS goal_{g}" for g in range(1, 11)) + " FROM f GROUP BY 1")
_TEXT_FACTS = lambda d: d.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("goal")).withColumn("score", ((F.col("doc_id") * 7 + F.col("goal") * 31) % 100) / 100.0)
_TF = "WITH f AS (SELECT doc_id, lower(text) AS t, g::INTEGER AS goal, ((doc_id * 7 + g * 31) % 100) / 100.0::DOUBLE AS score FROM documents, (SELECT unnest([1, 2, 3]) AS g))"


def _program_sql():
    out, score = [], "score"
    for k, (goal, wanted, unwanted, penalty, gains) in enumerate(PROGRAM):
        has, ok = (" OR ".join(f"contains(t, '{w}')" for w in ws) for ws in (unwanted, wanted))
        cases = f"CASE WHEN goal = {goal} AND ({has}) AND NOT ({ok}) THEN greatest(0.0::DOUBLE, {score} - {penalty}::DOUBLE) " + " ".join(f"WHEN goal = {g} AND ({has}) THEN least(1.0::DOUBLE, {score} + {x}::DOUBLE)" for g, x in gains.items()) + f" ELSE {score} END AS score"
        out.append(f", p{k} AS (SELECT doc_id, t, goal, {cases} FROM {'f' if not k else f'p{k - 1}'})")
    return "".join(out) + f" SELECT doc_id, goal, round(score, 6) AS score FROM p{len(PROGRAM) - 1}"


docs_query("correction_program", lambda d: A.corrected(_TEXT_FACTS(d), "text", PROGRAM).select("doc_id", "goal", F.round("score", 6).alias("score")), _TF + _program_sql())
docs_query("keyword_boost", lambda d: A.keyword_boost(_TEXT_FACTS(d), "text", {1: (("rewh", "orre"), 0.2), 2: (("hely",), 0.25)}).select("doc_id", "goal", "boosted", F.round("score", 6).alias("score")), _TF + ", b AS (SELECT *, CASE WHEN goal = 1 AND (contains(t, 'rewh') OR contains(t, 'orre')) THEN 0.2::DOUBLE WHEN goal = 2 AND contains(t, 'hely') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS g FROM f) SELECT doc_id, goal, g > 0 AS boosted, round(least(1.0::DOUBLE, score + g), 6) AS score FROM b")

# Rollups
facts_query("coverage_summary_wide", lambda f: R.wide(f, ["council", "year"], range(1, 6)), "SELECT council, year, count(*) AS activities, " + ", ".join(f"{rounded(f'sum((goal = {g} AND is_aligned)::INT)', 'count(*)', 1)} AS goal_{g}" for g in range(1, 6)) + " FROM f GROUP BY 1, 2")
facts_query("rollup_grouping_sets", lambda f: R.grouped(f, [["state"], ["year"], ["setting"], ["state", "year", "setting"], []]), f"SELECT coalesce(setting, 'all') AS setting, coalesce(state, 'all') AS state, coalesce(year::VARCHAR, 'all') AS year, goal, count(*) AS n, {MEAN} AS mean_score, {SHARE} AS coverage FROM f GROUP BY GROUPING SETS ((state, goal), (year, goal), (setting, goal), (state, year, setting, goal), (goal))")
facts_query("yearly_mean_of_means", lambda f: R.mean_of_means(f, ["council", "year"], ["year"]), f"SELECT year, goal, round(avg(s::DOUBLE / n / 1000), 12) AS mean_of_means, {rounded('sum(s)', 'sum(n)', 1000)} AS pooled_mean FROM (SELECT council, year, goal, sum(milli) AS s, count(*) AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2")
facts_query("council_coverage", lambda f: R.council_coverage(f, ["year"], "council"), "SELECT year, goal, round(100.0 * sum(h) / count(*), 2)::DOUBLE AS coverage_pct, coalesce(string_agg(council, ',' ORDER BY council) FILTER (WHERE h = 1), '') AS councils FROM (SELECT year, goal, council, max(is_aligned::INT) AS h FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2")
facts_query("urban_rural_distribution", lambda f: R.distribution(f, ["setting", "goal"]), "SELECT setting, goal, min(milli) AS low, max(milli) AS high, round(quantile_cont(milli, 0.25), 4)::DOUBLE AS q25, round(quantile_cont(milli, 0.5), 4)::DOUBLE AS median, round(quantile_cont(milli, 0.75), 4)::DOUBLE AS q75 FROM f GROUP BY 1, 2")
QUERIES["topgoal_proportions"] = (lambda s, d: R.proportions(order_facts(s, d), ["council", "year"], s.range(1, 6).select(F.col("id").cast("int").alias("goal"))), OF + f", c AS (SELECT council, year, goal, count(*) AS n FROM f GROUP BY 1, 2, 3), g AS (SELECT DISTINCT council, year, k::INTEGER AS goal FROM f, (SELECT unnest(range(1, 6)) AS k)), p AS (SELECT council, year, goal, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY council, year) AS t FROM g LEFT JOIN c USING (council, year, goal)) SELECT council, year, goal, {rounded('n', 't', 1)} AS proportion FROM p")
facts_query("region_deviation", lambda f: R.deviation(f, "setting"), "SELECT setting, goal, round(s::DOUBLE / n / 1000 - (sum(s) OVER w)::DOUBLE / (sum(n) OVER w) / 1000, 6) AS deviation FROM (SELECT setting, goal, sum(milli) AS s, count(*) AS n FROM f GROUP BY 1, 2) WINDOW w AS (PARTITION BY goal)")
facts_query("states_with_both", lambda f: f.groupBy("state").agg(F.count_distinct("setting").alias("settings"), F.count_distinct("council").alias("councils")).where("settings >= 2"), "SELECT state, count(DISTINCT setting) AS settings, count(DISTINCT council) AS councils FROM f GROUP BY 1 HAVING count(DISTINCT setting) >= 2")
facts_query("sample_top3_per_goal", R.samples, "SELECT goal, row_number() OVER (PARTITION BY goal ORDER BY milli DESC, activity_id)::INTEGER AS rank, activity_id, milli FROM f QUALIFY rank <= 3")
facts_query("ledger_bands", lambda f: R.ledger(f, ["council"]), f", r AS (SELECT council, goal, sum(is_aligned::INT)::BIGINT AS aligned, {MEAN} AS mean_score FROM f GROUP BY 1, 2) SELECT *, CASE WHEN aligned = 0 THEN 'none' WHEN aligned < 5 THEN 'few' WHEN aligned < 15 THEN 'some' ELSE 'many' END AS band, row_number() OVER (PARTITION BY council ORDER BY aligned DESC, mean_score DESC, goal)::INTEGER AS place FROM r")
facts_query("public_coverage", lambda f: R.latest(f, "council", "year"), "SELECT council, year, count(DISTINCT CASE WHEN is_aligned THEN goal END) AS goals, count(*) AS activities, CASE WHEN count(*) >= 40 THEN 'rich' WHEN count(*) >= 15 THEN 'moderate' ELSE 'thin' END AS extraction FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY council ORDER BY year DESC) = 1")
facts_query("national_shares", lambda f: f.groupBy("goal").agg(R.share(F.col("is_aligned")).alias("goal_share"), F.count_distinct("council").alias("councils")), f"SELECT goal, {SHARE} AS goal_share, count(DISTINCT council) AS councils FROM f GROUP BY 1")
facts_query("compare_notes", lambda f: R.compared(f, "state"), f", r AS (SELECT state, goal, {MEAN} AS m FROM f GROUP BY 1, 2) SELECT goal, round(max(m) - min(m), 6) AS gap, arg_max(state, (m, state)) AS leader, min(m) AS least FROM r GROUP BY 1")
facts_query("goal_union_years", lambda f: f.where("is_aligned").groupBy("council").agg(F.array_join(F.array_sort(F.collect_set("goal")).cast("array<string>"), ",").alias("goals"), F.count_distinct("year").alias("years")), "SELECT council, string_agg(DISTINCT goal::VARCHAR, ',' ORDER BY goal::VARCHAR) AS goals, count(DISTINCT year) AS years FROM f WHERE is_aligned GROUP BY 1")
facts_query("score_histogram", R.histogram, "SELECT floor(milli * 10 / 1000)::INTEGER AS bin, count(*) AS n FROM f GROUP BY 1")
# Every fact is in one of two runs: a council's goals up to 1998 and since.
_PERIOD = lambda f: f.groupBy(F.concat_ws(":", "council", F.col("goal").cast("string")).alias("council_goal")).agg(F.sum("milli").alias("milli"))
facts_query("run_diff", lambda f: R.changed(_PERIOD(f.where("year > 1998")), _PERIOD(f.where("year <= 1998")), "council_goal", "milli"), "SELECT council_goal, n.milli AS new_value, o.milli AS old_value, CASE WHEN o.milli IS NULL THEN 'new' WHEN n.milli IS NULL THEN 'dropped' ELSE 'both' END AS state FROM (SELECT council || ':' || goal AS council_goal, sum(milli)::BIGINT AS milli FROM f WHERE year > 1998 GROUP BY 1) n FULL JOIN (SELECT council || ':' || goal AS council_goal, sum(milli)::BIGINT AS milli FROM f WHERE year <= 1998 GROUP BY 1) o USING (council_goal)")
facts_query("activities_page", lambda f: f.where("goal = 2 and is_aligned").orderBy("activity_id").offset(50).limit(50).select("activity_id", "council", "milli"), "SELECT activity_id, council, milli FROM f WHERE goal = 2 AND is_aligned ORDER BY activity_id LIMIT 50 OFFSET 50")
facts_query("browse_councils", lambda f: f.groupBy("council", "state").agg(F.count_distinct("goal").alias("goals")).where(F.lower("council").contains("on_1")).withColumn("slug", T.slug(F.col("council"))), "SELECT council, state, count(DISTINCT goal) AS goals, trim(regexp_replace(lower(council), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM f WHERE contains(lower(council), 'on_1') GROUP BY 1, 2")
facts_query("peers", lambda f: (lambda c: c.join(c.toDF("peer", "peer_state"), (F.col("state") == F.col("peer_state")) & (F.col("council") != F.col("peer"))).select("council", "peer"))(f.select("council", "state").distinct()), "SELECT DISTINCT a.council, b.council AS peer FROM f a JOIN (SELECT DISTINCT council, state FROM f) b ON a.state = b.state AND a.council <> b.council")

# Trends
_YEARLY = lambda f: TR.yearly_means(f, ["council", "year"], ["state"])
_Y = yearly("state", "f") + fitted("state, goal", "y") + ", tt AS (SELECT q.*, p_value < 0.05 AS sure, a, z, b FROM q JOIN (SELECT state, goal, regr_slope(score, year) AS b, arg_min(score, year) AS a, arg_max(score, year) AS z FROM y GROUP BY 1, 2) USING (state, goal)) "
_T = "SELECT state, goal, n, slope, r2, round(CASE WHEN a <> 0 THEN (z - a) / a * 100 ELSE 0 END, 4) AS percent_change, sure AS is_significant, CASE WHEN NOT sure THEN 'stable' WHEN b > 0.01 THEN 'increasing' WHEN b < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction FROM tt"
facts_query("trend_ols", lambda f: TR.trends(_YEARLY(f), ["state", "goal"]), _Y + _T)
facts_query("state_trend_rank", lambda f: TR.ranking(TR.trends(_YEARLY(f), ["state", "goal"]), "state"), _Y + f", u AS ({_T}) SELECT state, round(avg(slope), 5) AS mean_slope, rank() OVER (ORDER BY round(avg(slope), 5) DESC)::INTEGER AS rank FROM u GROUP BY 1")
facts_query("year_contiguity", lambda f: TR.contiguous(f, ["council"]), "SELECT council, min(year) AS first_year, max(year) AS last_year, max(year) - min(year) + 1 = count(DISTINCT year) AS contiguous FROM f GROUP BY 1")

# Texts
docs_query("split_sentences", lambda d: d.select("doc_id", F.posexplode(T.sentences(F.col("text"), abbreviations=())).alias("pos", "sentence")).select("doc_id", F.length("sentence").cast("long").alias("length"), "sentence"), f"SELECT doc_id, length(s)::BIGINT AS length, s AS sentence FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?]+\\s+')), ' ') AS s FROM documents) WHERE length(s) > 10")
docs_query("filter_flags", lambda d: d.select("doc_id", (F.regexp_count("text", F.lit(r"\|")) >= 2).alias("pipes"), (F.regexp_count("text", F.lit("%")) >= 2).alias("percents"), T.is_mostly_numbers(F.col("text")).alias("is_mostly_numbers"), T.is_fragmented_start(F.col("text")).alias("is_fragmented_start")), f"SELECT doc_id, length(text) - length(replace(text, '|', '')) >= 2 AS pipes, length(text) - length(replace(text, '%', '')) >= 2 AS percents, len(w) = 0 OR len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '[,.$%*|+\\-]', '', 'g'), '^[0-9]+$'))) / len(w) > 0.35 AS is_mostly_numbers, coalesce(lower(w[1]) IN ({', '.join(repr(x) for x in T.L.DEPENDENT_STARTERS)}) OR (lower(w[1]) IN ('this', 'these', 'those', 'such') AND lower(w[2]) IN ('includes', 'include', 'includes:', 'include:')), false) AS is_fragmented_start FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
# What a text passes is put together from its flags, so that each filter is evaluated once.
_FLAGS = lambda d: d.select("source", *(f(F.col("text")).alias(k) for k, f in T.FILTERS.items()))
docs_query("filter_report", lambda d: _FLAGS(d).groupBy("source").agg(*(F.sum(F.col(k).cast("long")).alias(k) for k in T.FILTERS), F.sum((~reduce(lambda a, b: a | b, map(F.col, T.FILTERS))).cast("long")).alias("passed")), None)
docs_query("section_type", lambda d: d.select("doc_id", T.section_type(F.col("text"), (("first", PROSE[:2]), ("second", PROSE[2:4]), ("third", PROSE[4:]))).alias("section")), f"SELECT doc_id, CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'ther') THEN 'first' WHEN contains(lower(text), 'thon') OR contains(lower(text), 'hely') THEN 'second' WHEN contains(lower(text), 'rewh') OR contains(lower(text), 'orre') THEN 'third' ELSE 'general' END AS section FROM documents")
_SPEC = " + ".join(f"contains(l, '{w}')::INT" for w in T.L.SPECIFICITY)
docs_query("relevance_score", lambda d: d.select("doc_id", F.round(T.relevance(F.col("text"), PROSE, outcome=0), 3).alias("relevance")), f"SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE round(least((0.3::DOUBLE + least(({' + '.join(f'contains(l, {x!r})::INT' for x in PROSE)}) * 0.04::DOUBLE, 0.16::DOUBLE) + least(({_SPEC}) * 0.02::DOUBLE, 0.08::DOUBLE)) * CASE WHEN s > 0.25 THEN 0.6::DOUBLE WHEN s > 0.15 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 1.0), 4) END, 3) AS relevance FROM (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / nullif(len(w), 0) AS s FROM (SELECT doc_id, lower(text) AS l, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))")
# The SQL of split_sentences and relevance_score knows neither abbreviations nor outcomes.
docs_query("segment_sentences", lambda d: d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")), None)
docs_query("relevance_with_outcome", lambda d: d.select("doc_id", T.relevance(F.col("text"), PROSE).alias("relevance")), None)
docs_query("clean_text", lambda d: d.select("doc_id", T.clean_text(F.col("text")).alias("text")), None)
docs_query("smart_join", lambda d: d.select("doc_id", F.posexplode(T.joined_sentences(T.sentences(F.col("text")), ("the", "and", "of", "to"), 60)).alias("pos", "statement")), None)
QUERIES["html_to_text"] = (lambda s, d: table(s, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text")), r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
_NAME = lambda d: d.select("doc_id", F.concat_ws("_", F.coalesce(F.upper("lang"), F.lit("")), F.col("source"), F.lit("Shire"), F.when(F.col("doc_id") % 2 == 0, "Urban").otherwise("Rural"), (2023 + F.col("doc_id") % 3).cast("string")).alias("n"))
docs_query("report_identity", lambda d: _NAME(d).select("doc_id", *(F.nullif(c, F.lit("")).alias(k) for k, c in T.report_identity(F.concat(F.col("n"), F.lit(".csv"))).items())), f"SELECT doc_id, upper(lang) AS state, source || ' Shire' AS council, CASE WHEN doc_id % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS setting, (2023 + doc_id % 3)::VARCHAR AS year FROM documents")

# Keywords
_WORDS = f"SELECT {{}}, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents"
docs_query("goal_keywords", lambda d: K.frequent(d, ["source"], 10), f"SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word)::INTEGER AS rank FROM ({_WORDS.format('source')}) WHERE length(word) >= 4 GROUP BY 1, 2 QUALIFY rank <= 10")
docs_query("tfidf_keywords", lambda d: K.tf_idf(d, "doc_id", 50), f"WITH t AS (SELECT doc_id, word, count(*) AS tf FROM ({_WORDS.format('doc_id')}) WHERE length(word) >= 4 GROUP BY 1, 2) SELECT word, count(*) AS df, round(sum(tf) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1), 4) AS weight FROM t GROUP BY 1 ORDER BY weight DESC, word LIMIT 50")
docs_query("logodds_keywords", lambda d: K.log_odds(d, F.col("doc_id") % 2 == 0, 50), f"WITH w AS (SELECT word, sum(f::INT)::BIGINT AS t, sum((NOT f)::INT)::BIGINT AS c FROM ({_WORDS.format('doc_id % 2 = 0 AS f')}) WHERE length(word) >= 4 GROUP BY 1), s AS (SELECT sum(t) AS tt, sum(c) AS cc FROM w) SELECT word, t, c, round(ln((t + 0.5) / (tt + 0.5)) - ln((c + 0.5) / (cc + 0.5)), 6) AS log_odds FROM w, s WHERE t >= 3 ORDER BY log_odds DESC, word LIMIT 50")
docs_query("bigrams", lambda d: K.pairs(d, 50), f"SELECT a || ' ' || b AS pair, count(*) AS n FROM (SELECT unnest(w) AS a, unnest(w[2:] || ['']) AS b FROM (SELECT regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents)) WHERE length(a) > 3 AND length(b) > 3 GROUP BY 1 ORDER BY n DESC, pair LIMIT 50")
docs_query("keyword_overlap", lambda d: K.overlap(K.frequent(d, ["source"], 20), "source"), f"WITH k AS (SELECT source, word FROM ({_WORDS.format('source')}) WHERE length(word) >= 4 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) <= 20) SELECT x.source AS a, y.source AS b, count(*) AS shared FROM k x JOIN k y ON x.word = y.word AND x.source < y.source GROUP BY 1, 2")

# Evaluation and sampling
_EV = lambda f: f.select("goal", (F.col("goal") == F.col("truth")).cast("long").alias("y"), F.greatest(F.lit(0), F.least(F.lit(999), _MILLI())).alias("milli"))
_SW = ", e AS (SELECT goal, (goal = truth)::BIGINT AS y, greatest(0, least(999, floor(score * 1000)::BIGINT)) AS milli FROM f), s AS (SELECT goal, i::INTEGER AS i, sum((y = 1 AND milli >= i * 10)::INT)::BIGINT AS tp, sum((y = 0 AND milli >= i * 10)::INT)::BIGINT AS fp, sum((y = 1 AND milli < i * 10)::INT)::BIGINT AS fn, sum((y = 0 AND milli < i * 10)::INT)::BIGINT AS tn FROM e, (SELECT unnest(range(1, 100)) AS i) GROUP BY 1, 2), m AS (SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr FROM s) SELECT * FROM m"
vector_query("threshold_sweep", lambda f: E.sweep(_EV(f), ["goal"]), _SW)
vector_query("threshold_best", lambda f: E.best(E.sweep(_EV(f), ["goal"]), ["goal"]), _SW + " WHERE fpr <= 0.35 QUALIFY row_number() OVER (PARTITION BY goal ORDER BY f1 DESC, i DESC) = 1")
QUERIES["threshold_best_fine"] = (lambda s, d: E.best_fine(_EV(vector_facts(s, d)), ["goal"]), None)
_PRED = lambda f: A.top_goal(f, ["vec_id"]).select("truth", F.col("goal").alias("predicted"))
_P = ", p AS (SELECT truth, goal AS predicted FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, goal) = 1) "
vector_query("per_class_metrics", lambda f: E.per_class(_PRED(f)), _P + ", c AS (SELECT truth AS class, 1 AS t, 0 AS p, 0 AS h FROM p UNION ALL SELECT predicted, 0, 1, (truth = predicted)::INT FROM p), s AS (SELECT class, sum(t)::BIGINT AS support, sum(p)::BIGINT AS q, sum(h)::BIGINT AS h FROM c GROUP BY 1) SELECT class, support, round(coalesce(h::DOUBLE / nullif(q, 0), 0), 6) AS precision, round(coalesce(h::DOUBLE / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * h::DOUBLE / nullif(support + q, 0), 0), 6) AS f1 FROM s")
vector_query("confusion_pairs", lambda f: E.confusion(_PRED(f)), _P + "SELECT truth, predicted, count(*) AS n FROM p WHERE truth <> predicted GROUP BY 1, 2 ORDER BY n DESC, truth, predicted LIMIT 10")
vector_query("topn_accuracy", lambda f: A.top_goal(f, ["vec_id"], 3).groupBy("vec_id").agg(F.max((F.col("goal") == F.col("truth")).cast("int")).alias("hit")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits")), ", t AS (SELECT vec_id, max((goal = truth)::INT) AS h FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, goal) <= 3) GROUP BY 1) SELECT count(*) AS n, sum(h)::BIGINT AS hits FROM t")
QUERIES["label_stats"] = (lambda s, d: table(s, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")), "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
_RANKED = f"(SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)"
docs_query("stratified_sample", lambda d: E.stratified(d, ["source"], "doc_id", 0.1).select("doc_id", "source"), f"SELECT doc_id, source FROM {_RANKED} WHERE r <= greatest(1, floor(n * 0.1 + 0.5))")
docs_query("kfold", lambda d: E.folds(d, ["source"], "doc_id").select("doc_id", "source", "fold"), f"SELECT doc_id, source, ((r - 1) % 5)::INTEGER AS fold FROM {_RANKED}")
docs_query("doc_split", lambda d: E.split(d, ["source"], "doc_id").select("doc_id", "part"), f"SELECT doc_id, CASE WHEN r / n <= 0.7 THEN 'train' WHEN r / n <= 0.7::DOUBLE + 0.15::DOUBLE THEN 'validate' ELSE 'test' END AS part FROM {_RANKED}")
QUERIES["consensus_vote"] = (lambda s, d: E.votes(table(s, d, "conversations"), "conv_id", "role", 3, "user", "assistant"), "SELECT conv_id, sum((role = 'user')::INT)::BIGINT AS n_first, sum((role = 'assistant')::INT)::BIGINT AS n_second, count(*) AS n, CASE WHEN sum((role = 'user')::INT) >= 3 THEN 'user' WHEN sum((role = 'assistant')::INT) >= 3 THEN 'assistant' ELSE 'neutral' END AS consensus FROM conversations GROUP BY 1")

# Events
QUERIES["json_props_agg"] = (lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n")), "SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
QUERIES["tumbling_window"] = (lambda s, d: S.tumbling(table(s, d, "events")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
QUERIES["sliding_rate"] = (lambda s, d: S.sliding_rate(table(s, d, "events"), 2), "SELECT w AS window_start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2 HAVING count(*) > 2")
QUERIES["session_users"] = (lambda s, d: S.sessions(table(s, d, "events")), "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")

# Further alignment, evaluation and text operators
_TARGETS = lambda f: f.select("vec_id", "goal", F.explode(F.array(F.lit(1), F.lit(2))).alias("target"), "score").withColumn("score", F.round(F.col("score") * (0.9 + F.col("target") * 0.1 * (F.col("vec_id") % 3)), 8))
vector_query("target_boost", lambda f: A.target_boost(f.select("vec_id", "goal", "score"), _TARGETS(f), ["vec_id"]), ", t AS (SELECT vec_id, goal, max(round(score * (0.9::DOUBLE + k * 0.1::DOUBLE * (vec_id % 3)), 8)) AS m FROM f, (SELECT unnest([1, 2]) AS k) GROUP BY 1, 2) SELECT vec_id, goal, m > score AS boosted, greatest(score, m) AS score FROM f JOIN t USING (vec_id, goal)")
vector_query("weight_grid_search", lambda f: E.weight_grid(_TWO(f).join(f.select("vec_id", "goal", "truth"), ["vec_id", "goal"]), ["vec_id"], "truth"), ", m AS (SELECT vec_id, goal, truth, score AS st, round(greatest(0.0, 1 - (1 - score) * 2), 6) AS bert FROM f), grid AS (SELECT i::INTEGER AS i, vec_id, truth, goal, round(i / 10 * bert + (1 - i / 10) * st, 8) AS s FROM m, (SELECT unnest(range(0, 11)) AS i)), t AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY i, vec_id ORDER BY s DESC, goal) = 1) SELECT i, count(*) AS n, sum((goal = truth)::INT)::BIGINT AS hits FROM t GROUP BY 1")
vector_query("multilabel_metrics", lambda f: E.multi_label(f.select("vec_id", "goal", (F.col("goal") == F.col("truth")).cast("int").alias("y"), (F.col("score") >= 0.3).cast("int").alias("p")), "vec_id"), ", r AS (SELECT vec_id, count(*) AS n, sum((goal = truth)::INT) AS y, sum((score >= 0.3)::INT) AS p, sum((goal = truth AND score >= 0.3)::INT) AS b, sum(((goal = truth) <> (score >= 0.3))::INT) AS o FROM f GROUP BY 1) SELECT round(avg((o = 0)::INT), 6) AS exact, round(avg(o / n), 6) AS hamming, round(avg(CASE WHEN y + p - b = 0 THEN 1.0 ELSE b / (y + p - b) END), 6) AS jaccard, round(avg(CASE WHEN y + p = 0 THEN 1.0 ELSE 2 * b / (y + p) END), 6) AS sample_f1 FROM r")
docs_query("mention_scan", lambda d: d.select("doc_id", T.mention(F.col("text"), "rewh").alias("mention")).where("mention is not null"), f"SELECT doc_id, trim(m) AS mention FROM (SELECT doc_id, regexp_extract(text, '(?i)[^.!?]*(?:rewh)[^.!?]*[.!?]') AS m FROM documents) WHERE trim(m) <> ''")
docs_query("source_context", lambda d: d.select("doc_id", T.context(F.col("text"), F.get(T.sentences(F.col("text"), abbreviations=()), 1)).alias("context")).where("context is not null"), "WITH s AS (SELECT doc_id, text, (list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: trim(x, ' ')), lambda x: length(x) > 10))[2] AS s FROM documents), p AS (SELECT *, strpos(text, left(s, 50)) AS p FROM s WHERE s IS NOT NULL) SELECT doc_id, substr(text, greatest(1, p - 100), p - greatest(1, p - 100) + length(s) + 100) AS context FROM p WHERE p > 0")
docs_query("ocr_density", lambda d: d.select("doc_id", F.round(T.broken_letters(F.col("text")), 6).alias("density")), None)
_SIMILAR = lambda d: E.similar(d.select("doc_id", T.tokens(F.lower("text")).alias("w")), "doc_id", "w", 80)
docs_query("jaccard_pairs", _SIMILAR, "WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS w FROM documents), c AS (SELECT w, min(doc_id) AS class_id, count(*) AS n FROM s WHERE len(w) > 0 GROUP BY 1), p AS (SELECT a.class_id AS a, b.n, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS x, len(b.w) AS y FROM c a JOIN c b ON a.class_id <> b.class_id AND least(len(a.w), len(b.w)) > 0.8 * greatest(len(a.w), len(b.w))), l AS (SELECT a, sum(n)::BIGINT AS n FROM p WHERE 10 * k > 8 * (x + y - k) GROUP BY 1) SELECT s.doc_id, c.class_id, (c.n - 1 + coalesce(l.n, 0))::BIGINT AS links FROM s JOIN c USING (w) LEFT JOIN l ON l.a = c.class_id")
vector_query(
    "gap_nearest", lambda f: R.nearest_to_gaps(f.withColumns({"milli": _MILLI(), "is_aligned": F.col("similarity") >= 0.4}), ["report_id"], "vec_id"),
    f", a AS (SELECT *, similarity >= 0.4 AS is_aligned, floor(score * 1000)::BIGINT AS milli FROM f), r AS (SELECT report_id, goal, ((2000 * sum(milli))::BIGINT + count(*)) // (2 * count(*)) AS m, arg_max(vec_id, (milli, -vec_id)) AS vec_id, max(milli) AS milli FROM a GROUP BY 1, 2 HAVING NOT bool_or(is_aligned)) "
    "SELECT report_id, goal, row_number() OVER (PARTITION BY report_id ORDER BY m DESC, goal)::INTEGER AS rank, CASE WHEN milli > 0 THEN vec_id END AS vec_id, CASE WHEN milli > 0 THEN milli END AS milli FROM r",
)
QUERIES["kmeans_topics"] = (lambda s, d: TP.kmeans(table(s, d, "embeddings"), "vec_id", "embedding"), None)
QUERIES["lda_topics"] = (lambda s, d: TP.lda(table(s, d, "documents")), None)

# Corrections of scores, reads over reports, lines and pages
QUERIES.update(CQ.QUERIES)
QUERIES.update(PQ.QUERIES)
QUERIES.update(SQ.QUERIES)
QUERIES.update(STQ.QUERIES)
QUERIES.update(WQ.QUERIES)
QUERIES.update(CHQ.QUERIES)
QUERIES.update(GQ.QUERIES)
QUERIES.update(RQ.QUERIES)
