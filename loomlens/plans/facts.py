"""The driver's tables as the goal analysis sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts: an order is an activity, its priority the goal, its customer's nation the council, the region the state."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    milli = F.floor("o_totalprice").cast("long") % 1000
    return rows.select(
        F.col("o_orderkey").alias("activity_id"), F.col("n_name").alias("council"), F.col("r_name").alias("state"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_custkey") % 2 == 0, "Urban").otherwise("Rural").alias("setting"), F.substring("o_orderpriority", 1, 1).cast("int").alias("goal"), milli.alias("milli"), (milli >= 500).alias("is_aligned"),
    )


#: The same for DuckDB.
ORDER_FACTS = """WITH f AS (
  SELECT o_orderkey AS activity_id, n_name AS council, r_name AS state, year(o_orderdate)::INTEGER AS year, CASE WHEN o_custkey % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS setting,
         substr(o_orderpriority, 1, 1)::INTEGER AS goal, floor(o_totalprice)::BIGINT % 1000 AS milli, floor(o_totalprice)::BIGINT % 1000 >= 500 AS is_aligned
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def vector_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts: a vector is an activity of report vec_id % 20, each label's mean vector a goal (from 1); score is their cosine in six digits, similarity as it is; whether a goal is aligned is judged on the latter."""
    v = table(spark, sf_dir, "embeddings")
    rows = v.select("vec_id", (F.col("vec_id") % 20).alias("report_id"), (F.col("label") + 1).alias("truth"), "embedding")
    goals = A.centroids(v.withColumn("label", F.col("label") + 1), "label", "embedding")
    return A.scored(rows, goals, "embedding", 6)


VECTOR_FACTS = """WITH x AS (SELECT vec_id, label + 1 AS goal, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
), g AS (SELECT goal, i, avg(x) AS x FROM x WHERE goal IS NOT NULL GROUP BY 1, 2
), gn AS (SELECT goal, sqrt(sum(x * x)) AS n FROM g GROUP BY 1), vn AS (SELECT vec_id, any_value(goal) AS truth, sqrt(sum(x * x)) AS n FROM x GROUP BY 1
), d AS (SELECT x.vec_id, g.goal, sum(x.x * g.x) AS d FROM x JOIN g USING (i) GROUP BY 1, 2
), f AS (SELECT d.vec_id, d.vec_id % 20 AS report_id, vn.truth, d.goal, round(coalesce(d.d / nullif(vn.n * gn.n, 0), 0), 6) AS score, coalesce(d.d / nullif(vn.n * gn.n, 0), 0) AS similarity FROM d JOIN gn USING (goal) JOIN vn USING (vec_id))
"""
