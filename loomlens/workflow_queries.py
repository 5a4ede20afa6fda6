"""Queries over stored tables that change, caches, models' answers and searches for weights, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import alignment as A
from .operators import answers as AN
from .operators import evaluation as E
from .operators import search as SE
from .plans import stored as ST
from .plans.facts import VECTOR_FACTS, table, vector_facts
from .plans.scratch import shared_path

QUERIES: dict = {}


def stored_runs(spark, sf_dir):
    """Orders as runs, changed in five versions: all completed ones published, one priority's runs replaced by fresh ones, one run withdrawn, one cancelled, old open ones swept."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("queued")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.lit(False).alias("published"), F.col("o_orderdate").cast("timestamp").alias("updated"), "o_orderpriority")
    runs = ST.Runs(spark, shared_path(spark, "runs"))
    runs.write(rows, 1)
    runs.publish_all()
    fresh = rows.where("o_orderpriority = '1-URGENT'").withColumns({"status": F.lit("queued"), "updated": F.lit("1999-01-01").cast("timestamp")})
    runs.merge(fresh.unionByName(fresh.withColumn("updated", F.lit("1990-01-01").cast("timestamp"))), replace=True)
    runs.publish(1, False)
    runs.cancel(2)
    runs.sweep("1996-01-01")
    runs.delete(3)
    return runs.read().groupBy("status", "published", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("run_id").alias("ids"))


QUERIES["stored_runs"] = (
    stored_runs,
    """WITH r AS (SELECT o_orderkey AS run_id, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'queued' END AS status, o_orderdate AS updated FROM orders),
p AS (SELECT *, status = 'completed' AS published FROM r), m AS (SELECT run_id, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 'queued' ELSE status END AS status, published AND o_orderpriority <> '1-URGENT' AND NOT (run_id = 1 AND status = 'completed') AS published,
  CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '1999-01-01' ELSE updated END AS updated FROM p WHERE run_id <> 3)
SELECT CASE WHEN status IN ('queued', 'processing') AND (run_id = 2 OR updated < TIMESTAMP '1996-01-01') THEN 'failed' ELSE status END AS status, published, o_orderpriority, count(*) AS n, sum(run_id)::BIGINT AS ids FROM m GROUP BY 1, 2, 3""",
)


def cached_results(spark, sf_dir):
    """Short texts are cached, and longer ones in a batch that shares some with them; then all texts are asked for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cache = ST.Cache(spark, shared_path(spark, "cache"), "array<double>")
    value = F.array(F.length("text").cast("double"), F.ascii("text").cast("double"))
    model = F.lit("lengths-1")
    for batch, some, day in (("a", "length(text) < 600", "2024-01-01"), ("b", "length(text) < 2500", "2024-02-01"), ("b", "length(text) < 2500", "2024-03-01")):
        missing = cache.misses(docs.where(some), "text", model)
        cache.put(missing.select("key", value.alias("value")) if batch == "a" else docs.where(some).select(ST.cache_key(F.col("text"), model).alias("key"), value.alias("value")), batch, model, F.lit(day))
    later = cache.clear(F.lit("2024-02-15").cast("timestamp"), shared_path(spark, "cache"))
    both = cache.get(docs, "text", model).select("doc_id", "key", "value").join(later.rows().select("key", F.lit(True).alias("new")), "key", "left")
    return both.select("doc_id", "key", F.col("value").isNotNull().alias("hit"), F.get("value", F.lit(0)).cast("long").alias("length"), F.coalesce("new", F.lit(False)).alias("recent"))


QUERIES["cached_results"] = (
    cached_results,
    """WITH d AS (SELECT doc_id, left(sha256(coalesce(text, '') || ':lengths-1'), 32) AS key, length(coalesce(text, ''))::BIGINT AS length FROM documents),
k AS (SELECT key, bool_or(length < 600) AS old, bool_or(length < 2500) AS hit FROM d GROUP BY 1)
SELECT doc_id, key, coalesce(hit, false) AS hit, CASE WHEN hit THEN length END AS length, coalesce(hit AND NOT coalesce(old, false), false) AS recent FROM d JOIN k USING (key)""",
)


# Answers as a model might give them, made from turns of conversations: a block of eight turns is a batch of numbered sentences.
_TURNS = lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 8).alias("block"), (F.col("turn") % 8 + 1).alias("i"), F.regexp_replace(F.trim(F.regexp_replace(F.col("text"), r"[\s|\[\]]+", " ")), "^[^A-Za-z]+", "").alias("text"))
_TAG = ("ACTION", "policy", "Neutral")


def numbered_answers(spark, sf_dir):
    """Lines in the strict form, in a looser one, without a label, and missing, by turn and conversation."""
    r = _TURNS(spark, sf_dir)
    kind = (F.col("conv_id") + F.col("turn")) % 4
    tag = F.element_at(F.array(*map(F.lit, _TAG)), (F.col("turn") % 3 + 1).cast("int"))
    strict = F.concat(F.lit("Sentence "), F.col("i"), F.lit(": Reasoning: x"), F.col("text"), F.lit(" | Category: ["), tag, F.lit("]"))
    line = F.when(kind == 0, strict).when(kind == 1, F.concat(F.lit(" "), F.col("i"), F.lit(") reasoning: x"), F.col("text"), F.lit(" ["), tag, F.lit("]"))).when(kind == 2, F.concat(F.col("i"), F.lit(". no label here")))
    batches = r.withColumn("line", line).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"), F.max("i").cast("int").alias("n"))
    asked = batches.select(F.concat_ws("-", "conv_id", "block").alias("batch"), (F.col("n") + 1).alias("n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("answer"))
    return AN.numbered(asked, "batch", "answer", "n")


_CLEAN = r"regexp_replace(trim(regexp_replace(text, '[\s|\[\]]+', ' ', 'g')), '^[^A-Za-z]+', '')"
QUERIES["numbered_answers"] = (
    numbered_answers,
    f"""WITH t AS (SELECT conv_id || '-' || (turn // 8) AS batch, turn % 8 + 1 AS i, (conv_id + turn) % 4 AS kind, upper((['ACTION', 'policy', 'Neutral'])[turn % 3 + 1]) AS tag, trim('x' || {_CLEAN}) AS text FROM conversations),
b AS (SELECT batch, unnest(range(1, max(i) + 2))::INTEGER AS number FROM t GROUP BY 1)
SELECT batch, number, CASE WHEN kind = 0 OR kind = 1 THEN tag ELSE 'PARSE_ERROR' END AS label, CASE WHEN kind = 0 THEN text WHEN kind = 1 THEN text || ' [' || (['ACTION', 'policy', 'Neutral'])[(number - 1 + 8 * split_part(batch, '-', 2)::INTEGER) % 3 + 1] || ']' ELSE '' END AS reasoning
FROM b LEFT JOIN t ON t.batch = b.batch AND t.i = b.number""".replace("SELECT batch, number, CASE", "SELECT b.batch, number, CASE").replace("split_part(batch", "split_part(b.batch"),
)


def labelled_answers(spark, sf_dir):
    """Objects in fences of both kinds, bare ones, cut ones, and none."""
    r = _TURNS(spark, sf_dir)
    body = F.to_json(F.struct(F.left("text", F.lit(12)).alias("label"), F.array(F.left("text", F.lit(3)), F.lit("b")).alias("entities"), F.col("text").alias("summary")))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    answer = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("```"))).when(kind == 2, body).when(kind == 3, F.left(body, F.length(body) - 2))
    return AN.labelled(r.withColumn("answer", answer), "answer", "text").select("conv_id", "turn", "label", "category", F.array_join("entities", ";").alias("entities"), "summary", "llm_error")


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
QUERIES["labelled_answers"] = (
    labelled_answers,
    f"""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 5 >= 3 AS bad, {_CLEAN} AS text FROM conversations), w AS (SELECT *, {_WORDS} AS w FROM t), f AS (SELECT *, array_to_string(w[1:4], ' ') AS four FROM w)
SELECT conv_id, turn, CASE WHEN NOT bad THEN left(text, 12) WHEN len(w) >= 4 THEN upper(left(four, 1)) || lower(substr(four, 2)) ELSE left(text, 30) END AS label, 'General' AS category, CASE WHEN bad THEN '' ELSE left(text, 3) || ';b' END AS entities,
  CASE WHEN bad AND length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS summary, bad AS llm_error FROM f""",
)


# Three variants of a goal's score: its own, and those of the two goals after it. Labels of vectors are the truth.
WEIGHTS = {"core": 0.5, "context": 0.3, "anchor": 0.2}


def _variants(spark, sf_dir):
    f = vector_facts(spark, sf_dir).where("truth is not null").select("vec_id", "truth", "goal", "score")
    own = f.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("m"))
    of = lambda k: F.element_at("m", (F.col("goal") - 1 + k) % 10 + 1)
    return f.join(own, "vec_id").select("vec_id", "truth", "goal", F.col("score").alias("core"), of(1).alias("context"), of(2).alias("anchor"))


_V = VECTOR_FACTS + ", v AS (SELECT a.vec_id, a.truth, a.goal, a.score AS core, b.score AS context, c.score AS anchor FROM f a JOIN f b ON a.vec_id = b.vec_id AND b.goal = a.goal % 10 + 1 JOIN f c ON a.vec_id = c.vec_id AND c.goal = (a.goal + 1) % 10 + 1 WHERE a.truth IS NOT NULL)"
_FOLDED = lambda v: v.join(E.folds(v.select("vec_id", "truth").distinct(), ["truth"], "vec_id").select("vec_id", "fold"), "vec_id")
_FOLDS = ", o AS (SELECT vec_id, ((row_number() OVER (PARTITION BY truth ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5)::INTEGER AS fold FROM (SELECT DISTINCT vec_id, truth FROM v)), w AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS point, a, b, 10 - a - b AS c FROM (SELECT unnest(range(0, 11)) AS a) x, (SELECT unnest(range(0, 11)) AS b) y WHERE a + b <= 10), s AS (SELECT v.*, fold, point, round((core * a + context * b + anchor * c) / 10, 9) AS s FROM v JOIN o USING (vec_id), w)"
_CHOOSE = ", r AS (SELECT t.fold, t.point, t.x AS train, e.x AS test FROM t JOIN e USING (fold, point) QUALIFY row_number() OVER (PARTITION BY t.fold ORDER BY t.x DESC, t.point) = 1) SELECT fold, point::INTEGER AS point, round(train, 6) AS train, round(test, 6) AS test, a::INTEGER AS core_units, b::INTEGER AS context_units, c::INTEGER AS anchor_units FROM r JOIN w USING (point)"
QUERIES["simplex_accuracy"] = (
    lambda spark, sf_dir: SE.searched_top(_FOLDED(_variants(spark, sf_dir)), "vec_id", list(WEIGHTS), "truth", "fold"),
    _V + _FOLDS + ", h AS (SELECT fold, point, count(*) AS n, sum((g = truth)::INT) AS hits FROM (SELECT fold, point, vec_id, any_value(truth) AS truth, arg_max(goal, (s, -goal)) AS g FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "e AS (SELECT fold, point, round(hits / n, 9) AS x FROM h), t AS (SELECT a.fold, a.point, round(sum(b.hits) / sum(b.n), 9) AS x FROM h a JOIN h b ON a.point = b.point AND a.fold <> b.fold GROUP BY 1, 2)" + _CHOOSE,
)
_F1 = "round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END), 9)"
QUERIES["simplex_macro_f1"] = (
    lambda spark, sf_dir: SE.searched_labels(_FOLDED(_variants(spark, sf_dir)).withColumn("y", (F.col("goal") == F.col("truth")).cast("int")), list(WEIGHTS), "y", F.lit(0.15), "fold"),
    _V + _FOLDS + ", h AS (SELECT fold, point, goal, sum((goal = truth AND s >= 0.15)::INT) AS tp, sum((goal <> truth AND s >= 0.15)::INT) AS fp, sum((goal = truth AND s < 0.15)::INT) AS fn FROM s GROUP BY 1, 2, 3), "
    f"e AS (SELECT fold, point, {_F1} AS x FROM h GROUP BY 1, 2), t AS (SELECT fold, point, {_F1} AS x FROM (SELECT a.fold, a.point, a.goal, sum(b.tp) AS tp, sum(b.fp) AS fp, sum(b.fn) AS fn FROM h a JOIN h b ON a.point = b.point AND a.goal = b.goal AND a.fold <> b.fold GROUP BY 1, 2, 3) GROUP BY 1, 2)" + _CHOOSE,
)


def _targets(v):
    """Two targets a goal; the second has the variants the other way round."""
    return v.select("vec_id", "goal", F.explode(F.array(F.struct(F.lit("x").alias("t"), "core", "context", "anchor"), F.struct(F.lit("y").alias("t"), F.col("anchor").alias("core"), F.col("core").alias("context"), F.col("context").alias("anchor")))).alias("k")).select("vec_id", "goal", F.concat_ws(".", "goal", "k.t").alias("target"), "k.core", "k.context", "k.anchor")


def _attributed(spark, sf_dir):
    v = _variants(spark, sf_dir)
    goals = v.select("vec_id", "goal", F.col("core").alias("score"), (F.col("goal") == F.col("truth")).cast("int").alias("y"))
    return SE.attributed(goals, _targets(v), ["vec_id"], WEIGHTS, F.lit(0.1))


_A = _V + """, y AS (SELECT vec_id, goal, truth, core AS score, goal || '.x' AS target, round(core * 0.5, 9) AS p, round(context * 0.3, 9) AS q, round(anchor * 0.2, 9) AS r FROM v UNION ALL
  SELECT vec_id, goal, truth, core, goal || '.y', round(anchor * 0.5, 9), round(core * 0.3, 9), round(context * 0.2, 9) FROM v),
b AS (SELECT *, round(p + q + r, 9) AS s FROM y QUALIFY row_number() OVER (PARTITION BY vec_id, goal ORDER BY round(p + q + r, 9) DESC, target) = 1),
a AS (SELECT vec_id, goal, target, s AS target_score, score, p AS core_share, q AS context_share, r AS anchor_share, CASE greatest(p, q, r) WHEN p THEN 'core' WHEN q THEN 'context' ELSE 'anchor' END AS dominant, goal <> truth AS is_wrong FROM b WHERE score < 0.1 AND s > score AND s >= 0.1)"""  # fmt: skip
QUERIES["boost_attribution"] = (_attributed, _A + " SELECT * FROM a")
_COUNTS = "sum(is_wrong::INT)::BIGINT AS wrong, sum((NOT is_wrong)::INT)::BIGINT AS \"right\", round(avg(is_wrong::INT), 6) AS wrong_share FROM a"
QUERIES["boost_attribution_counts"] = (
    lambda spark, sf_dir: SE.attribution_counts(_attributed(spark, sf_dir)),
    _A + f" SELECT 'goal' AS kind, goal::VARCHAR AS name, {_COUNTS} GROUP BY 2 UNION ALL SELECT 'target', target, {_COUNTS} GROUP BY 2 UNION ALL SELECT 'variant', dominant, {_COUNTS} GROUP BY 2 UNION ALL SELECT 'all', 'all', {_COUNTS} HAVING count(*) > 0",
)
