"""Queries that run a stream over a given table to its end, with the DuckDB SQL of what the stream should have said."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.facts import table
from .plans.scratch import shared_path
from .streaming import ingest as S
from .streaming import jobs as J

QUERIES: dict = {}
#: A day without an event is a stall; a user's week is a job.
STALL = 1440
_KIND = {"signup": J.QUEUE, "view": J.PROGRESS, "click": J.PROGRESS, "purchase": J.DONE}


def _stream(spark, sf_dir, name):
    """A table as a stream, be it a file or a folder: a stream takes a file's path only as a pattern. Watermarks need times with a zone."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def job_states(spark, sf_dir):
    """Each job's last state after the stream has ended and timers up to its watermark have gone off."""
    kind = F.lit(None).cast("string")
    for event, k in _KIND.items():
        kind = F.when(F.col("event_type") == event, k).otherwise(kind)
    kind = F.coalesce(kind, F.when(F.col("event_id") % 2 == 0, J.FAIL).otherwise(J.CANCEL))
    at = F.date_trunc("millisecond", "ts")
    job = F.concat_ws("-", F.col("user_id").cast("string"), F.weekofyear("ts").cast("string"))
    events = _stream(spark, sf_dir, "events").select(job.alias("job"), at.alias("at"), "event_id", kind.alias("kind"), F.col("value").alias("progress"), F.col("event_type").alias("step"))
    return J.current(J.written(J.changes(events, stall_minutes=STALL), shared_path(spark, "jobs"), shared_path(spark, "jobs-mark"))).select("job", "seq", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("moved_at"), "status", "progress", "step", "error")


QUERIES["job_states"] = (
    job_states,
    """WITH e AS (SELECT user_id || '-' || weekofyear(ts) AS job, date_trunc('millisecond', ts) AS tm, event_id, value AS progress, event_type AS step,
  CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'done' ELSE CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'cancel' END END AS kind FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY tm, event_id) AS r FROM e QUALIFY sum((kind = 'queue')::INT) OVER (PARTITION BY job ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) > 0),
m AS (SELECT *, kind <> 'queue' OR row_number() OVER (PARTITION BY job ORDER BY r) = 1 AS moves FROM b),
g AS (SELECT *, coalesce(tm - last_value(CASE WHEN moves THEN tm END IGNORE NULLS) OVER w > INTERVAL 1 DAY, false) OR coalesce(bool_or(kind IN ('done', 'fail', 'cancel')) OVER w, false) AS x FROM m WINDOW w AS (PARTITION BY job ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, bool_or(x) OVER (PARTITION BY job ORDER BY r ROWS UNBOUNDED PRECEDING) AS over FROM g),
l AS (SELECT job, count(*) FILTER (WHERE moves AND NOT over) AS n, bool_or(over) AS cut, arg_max({'tm': tm, 'kind': kind, 'step': step}, r) FILTER (WHERE moves AND NOT over) AS z,
  arg_max({'progress': progress, 'step': step}, r) FILTER (WHERE moves AND NOT over AND kind = 'progress') AS p FROM o GROUP BY 1),
s AS (SELECT *, z.kind NOT IN ('done', 'fail', 'cancel') AND (cut OR z.tm + INTERVAL 1 DAY < (SELECT max(tm) - INTERVAL 10 MINUTE FROM e)) AS stalled FROM l)
SELECT job, (n + stalled::INT)::INTEGER AS seq, strftime(CASE WHEN stalled THEN z.tm + INTERVAL 1 DAY ELSE z.tm END, '%Y-%m-%d %H:%M:%S.%g') AS moved_at,
  CASE WHEN z.kind = 'done' THEN 'completed' WHEN stalled OR z.kind IN ('fail', 'cancel') THEN 'failed' WHEN z.kind = 'progress' THEN 'processing' ELSE 'queued' END AS status,
  CASE WHEN z.kind = 'done' THEN 100.0 ELSE least(greatest(coalesce(p.progress, 0), 0), 100) END::DOUBLE AS progress, CASE WHEN z.kind = 'done' THEN 'Complete' ELSE p.step END AS step,
  CASE WHEN z.kind = 'fail' THEN z.step WHEN z.kind = 'cancel' THEN 'Cancelled by user' WHEN stalled THEN 'stalled' END AS error FROM s""",
)


def stream_distinct(spark, sf_dir):
    """Events that come in twice, by two sources, counted once each."""
    events = _stream(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    found = J.written(S.first_of_each(events.union(events), ["event_id"], "1 hour"), shared_path(spark, "distinct"), shared_path(spark, "distinct-mark"))
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES["stream_distinct"] = (stream_distinct, "SELECT user_id, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")


def stream_windows(spark, sf_dir):
    """Windows that had closed when the stream ended: those that end at its watermark or before."""
    events = _stream(spark, sf_dir, "events")
    found = J.written(S.tumbling(events, "1 hour", "2 hours"), shared_path(spark, "windows"), shared_path(spark, "windows-mark"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES["stream_windows"] = (
    stream_windows,
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)",
)
