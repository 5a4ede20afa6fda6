"""Queries put in Spark SQL over the library's own functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sql_functions as SF
from .functions import lexicons as L
from .plans.facts import VECTOR_FACTS, table, vector_facts

QUERIES: dict = {}
#: Orders on a page at most, and the page that a customer's orders make: two rows of heads, a cell that spans all rows of the customer.
A_PAGE = 256


def _order_pages(spark, sf_dir):
    """(customer, block, html) of all orders: blocks of an equal quotient of the order's number, so that a page has at most A_PAGE orders, whatever customer they are of."""
    row = F.concat(F.lit("<td>"), F.col("o_orderkey"), F.lit("<td> "), F.col("o_orderstatus"), F.lit("&amp;<b>x</b> </td><td>"), F.floor("o_totalprice").cast("long"), F.lit("</td></tr>"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / A_PAGE).alias("block"), F.struct("o_orderkey", row.alias("html")).alias("r"))
    pages = orders.groupBy("o_custkey", "block").agg(F.sort_array(F.collect_list("r")).alias("r"))
    head = "<html><p>Orders</p><table><tr><th rowspan=2>customer</th><th colspan=2>order</th><th rowspan='2'>price</th></tr><tr><th>key</th><th>status</th></tr><tr>"
    body = F.array_join(F.transform("r", lambda x: x["html"]), "<tr>")
    return pages.select("o_custkey", "block", F.concat(F.lit(head), F.lit("<td rowspan="), F.size("r"), F.lit(">"), F.col("o_custkey"), F.lit("</td>"), body, F.lit("</table>")).alias("html"))


def order_tables(spark, sf_dir):
    SF.register(spark)
    return spark.sql("SELECT p.o_custkey, p.block, c.* FROM {p} p, LATERAL html_cells(p.html) c", p=_order_pages(spark, sf_dir))


_CELLS = """WITH o AS (SELECT o_custkey, floor(o_orderkey / 256)::BIGINT AS block, o_orderkey, (row_number() OVER (PARTITION BY o_custkey, floor(o_orderkey / 256) ORDER BY o_orderkey) + 1)::INTEGER AS row_no,
  [o_custkey::VARCHAR, o_orderkey::VARCHAR, o_orderstatus || '&x', floor(o_totalprice)::BIGINT::VARCHAR] AS v FROM orders),
h AS (SELECT o_custkey, block, 0 AS row_no, ['customer', 'order', 'order', 'price'] AS v, true AS is_header FROM o UNION SELECT o_custkey, block, 1, ['customer', 'key', 'status', 'price'], true FROM o),
a AS (SELECT o_custkey, block, row_no, v, is_header FROM h UNION ALL SELECT o_custkey, block, row_no, v, false FROM o)
SELECT o_custkey, block, 0 AS table_no, row_no, unnest(range(0, 4))::INTEGER AS col_no, is_header, unnest(v) AS value FROM a"""
QUERIES["order_tables"] = (order_tables, _CELLS)


def candidate_statements(spark, sf_dir):
    SF.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return spark.sql("SELECT doc_id, pos, statement, n_words, section_of(statement) AS section, normalized_text(source) AS source FROM split_candidates(TABLE({d}), 'text', 5)", d=docs)


_SECTION = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(statement), '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in L.SECTIONS) + " ELSE 'general' END"
QUERIES["candidate_statements"] = (
    candidate_statements,
    f"""WITH d AS (SELECT doc_id, source, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents), s AS (SELECT doc_id, source, trim(unnest(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)))) AS statement,
  unnest(range(0, len(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))))) AS i FROM d), w AS (SELECT *, len(list_filter(string_split(statement, ' '), lambda x: x <> ''))::INTEGER AS n_words FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, statement, n_words, {_SECTION} AS section, lower(source) AS source FROM w WHERE n_words >= 5""",
)


def sql_thresholds(spark, sf_dir):
    SF.register(spark)
    return spark.sql(
        "SELECT goal, count(*) AS n, sum(cast(score >= goal_threshold(goal, 'hybrid') AS BIGINT)) AS hybrid, sum(cast(score >= goal_threshold(goal, 'sdgbert') AS BIGINT)) AS second, "
        "max(model_weight(goal)) AS weight, max(section_weight('environment', goal)) AS section_weight, max(keyword_gain(goal, 'health and waste')) AS gain FROM {f} GROUP BY goal",
        f=vector_facts(spark, sf_dir).withColumn("goal", F.col("goal").cast("int")),
    )


_CASE = lambda cases, other: "CASE goal " + " ".join(f"WHEN {g} THEN {x}" for g, x in cases.items()) + f" ELSE {other} END"
_OF = lambda mode: _CASE(dict(enumerate(L.THRESHOLDS[mode][1], 1)), L.THRESHOLDS[mode][0])
QUERIES["sql_thresholds"] = (
    sql_thresholds,
    VECTOR_FACTS + f"SELECT goal, count(*) AS n, sum((score >= {_OF('hybrid')})::INT)::BIGINT AS hybrid, sum((score >= {_OF('sdgbert')})::INT)::BIGINT AS second, max({_CASE(dict(enumerate(L.MODEL_WEIGHTS, 1)), 0.5)})::DOUBLE AS weight, "
    f"max({_CASE(L.SECTION_WEIGHTS['environment'], 1.0)})::DOUBLE AS section_weight, max(CASE goal WHEN 3 THEN 0.2 WHEN 12 THEN 0.2 ELSE 0 END)::DOUBLE AS gain FROM f GROUP BY 1",
)
