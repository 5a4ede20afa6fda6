"""Streams that carry state, in several batches, against a fold over all events and by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlens.streaming import ingest as S
from loomlens.streaming import jobs as J

START = datetime(2024, 1, 1)


def random_events(n_jobs=60, seed=3):
    rng, rows = random.Random(seed), []
    for j in range(n_jobs):
        t = rng.randint(0, 600)
        for _ in range(rng.randint(1, 9)):
            rows.append((f"j{j}", START + timedelta(seconds=60 * t), len(rows), rng.choices(["queue", "progress", "done", "fail", "cancel"], [3, 6, 1, 1, 1])[0], rng.choice([None, -5.0, 12.5, 60.0, 140.0]), rng.choice([None, "read", "score"])))
            t += rng.choice([0, 1, 5, 14, 15, 16, 40])
    return rows


def fold(rows, stall, upto):
    """Each job's last state by one loop over its events."""
    out = {}
    for job, at, _, kind, progress, step in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = out.get(job)
        if s and s[2] in ("queued", "processing") and at - s[1] > stall:
            s = out[job] = (s[0] + 1, s[1] + stall, "failed", s[3], s[4], "stalled")
        if s is None and kind == "queue":
            out[job] = (1, at, "queued", 0.0, None, None)
        elif s and s[2] in ("queued", "processing") and kind != "queue":
            if kind == "progress":
                out[job] = (s[0] + 1, at, "processing", min(max(progress or 0.0, 0.0), 100.0), step, None)
            elif kind == "done":
                out[job] = (s[0] + 1, at, "completed", 100.0, "Complete", None)
            else:
                out[job] = (s[0] + 1, at, "failed", s[3], s[4], step if kind == "fail" else "Cancelled by user")
    return {j: (s[0] + 1, s[1] + stall, "failed", s[3], s[4], "stalled") if s[2] in ("queued", "processing") and s[1] + stall < upto else s for j, s in out.items()}


def states(frame):
    return {r.job: (r.seq, r.at, r.status, r.progress, r.step, r.error) for r in frame.collect()}


def test_stream_of_jobs_in_batches(spark, tmp_path):
    rows = sorted(random_events(), key=lambda r: (r[1], r[2]))
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    stall, late = timedelta(minutes=15), timedelta(minutes=10)
    # Batches of rows in order of time, cut between two times, so that none is late.
    cuts = [0, *(i for i in (60, 61, 150, 250) if i < len(rows)), len(rows)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        while z < len(rows) and rows[z - 1][1] == rows[z][1]:
            z += 1
        batch = [r for r in rows[a:z] if r[2] not in {x[2] for x in rows[: max(a, 0)]}]
        if batch:
            spark.createDataFrame(batch, J.EVENTS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(J.EVENTS).parquet(source)
            found = J.written(J.changes(stream), out, mark)
    seen = sorted({r[2]: r for r in rows}.values(), key=lambda r: (r[1], r[2]))
    upto = max(r[1] for r in seen) - late
    assert states(J.current(found)) == fold(seen, stall, upto)
    assert states(J.settled(spark.createDataFrame(seen, J.EVENTS), F.lit(upto))) == fold(seen, stall, upto)
    changes = found.collect()
    assert len({(r.job, r.seq) for r in changes}) == len(changes) == sum(s[0] for s in fold(seen, stall, upto).values())
    # Run again with nothing new: nothing is told twice.
    assert J.written(J.changes(spark.readStream.schema(J.EVENTS).parquet(source)), out, mark).count() == len(changes)


@pytest.mark.parametrize("seed", range(3))
def test_settled_against_the_fold(spark, seed):
    rows = random_events(80, seed)
    upto = START + timedelta(minutes=400)
    assert states(J.settled(spark.createDataFrame(rows, J.EVENTS).repartition(3), F.lit(upto))) == fold(rows, timedelta(minutes=15), upto)
    assert J.settled(spark.createDataFrame([], J.EVENTS), F.lit(upto)).count() == 0


def test_duplicates_and_late_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "k int, ts timestamp, v string"
    at = lambda m: START + timedelta(minutes=m)
    batches = [
        [(1, at(0), "a"), (1, at(1), "again"), (2, at(2), "b")],
        [(1, at(9), "within ten minutes"), (3, at(40), "moves the watermark to 30")],
        [(4, at(5), "late, older than the watermark"), (2, at(35), "forgotten key, new again"), (3, at(41), "again")],
        [(5, at(90), "moves it to 80")],
        [(3, at(85), "forgotten, new again"), (6, at(79), "late")],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        stream = S.first_of_each(spark.readStream.schema(schema).parquet(source), ["k"], "10 minutes")
        found = J.written(stream, out, mark)
        if i == 0:
            assert {r.k for r in found.collect()} == {1, 2} and found.count() == 2
    got = {(r.k, r.v) for r in found.collect()}
    assert {k for k, _ in got} == {1, 2, 3, 5} and len(got) == 6
    assert (2, "forgotten key, new again") in got and (3, "forgotten, new again") in got and not any("late" in v for _, v in got)


def test_windows_close_with_the_watermark(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "ts timestamp, event_type string"
    for minutes in ([0, 10, 59], [70, 75], [5, 200], [61, 260]):
        spark.createDataFrame([(START + timedelta(minutes=m), "x") for m in minutes], schema).coalesce(1).write.mode("append").parquet(source)
        found = J.written(S.tumbling(spark.readStream.schema(schema).parquet(source), late="20 minutes"), out, mark)
    # 0 to 60 held three rows when it closed at the watermark of 180, with the late row of minute 5, which came before; 61 came after its window had closed.
    assert {(r.window_start.hour, r.n) for r in found.collect()} == {(0, 4), (1, 2), (3, 1)}
