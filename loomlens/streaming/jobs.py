"""Jobs as a stateful stream: queued, processing, completed or failed, with progress, and failure of those that stall.

Events of a job move its state on; a job that is done or failed stays so. Each change goes out once, in order. A job that no event moves for
``stall`` fails: between events by their own times, and after its last event by a timer when the watermark has passed. State is one small row a job, kept
in the state store, so that it survives lost executors and grows with open jobs only; of a finished job a mark stays until it expires.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Columns that a stream of events needs, and those of the changes that come out.
EVENTS = "job string, at timestamp, event_id long, kind string, progress double, step string"
CHANGES = "job string, seq int, at timestamp, status string, progress double, step string, error string"

#: What an event does: the status it leads to, and from which.
QUEUE, PROGRESS, DONE, FAIL, CANCEL = "queue", "progress", "done", "fail", "cancel"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(events: DataFrame, late: str = "10 minutes", stall_minutes: int = 15) -> DataFrame:
    """The changes of state of a stream of events, ready for a sink in append mode.

    A job begins with its first ``queue``; events before it, and after its end, change nothing. ``progress`` makes it processing, ``done`` completes it at 100, ``fail``
    and ``cancel`` fail it. Events of a job within a batch are taken in the order of time, then event_id. Later batches' events that are older than a job's state count at the state's time.
    """
    from pyspark.sql.streaming import StatefulProcessor

    events.sparkSession.conf.set(_STORE, _ROCKS)
    stall_ms, kinds = stall_minutes * 60_000, (QUEUE, PROGRESS, DONE, FAIL, CANCEL)

    class Jobs(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            # status, times in milliseconds, progress, step, and how many changes went out.
            self.state = handle.getValueState("job", "status string, at long, progress double, step string, seq int")

        def close(self) -> None:
            pass

        def told(self, job, status, at, progress, step, seq, error):
            from datetime import UTC, datetime, timedelta

            when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=at)
            return Row(job=job, seq=seq, at=when, status=status, progress=progress, step=step, error=error)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            queue, progress_, done, fail, cancel = kinds
            held = self.state.get() if self.state.exists() else None
            status, at, progress, step, seq = tuple(held) if held is not None else (None, 0, 0.0, None, 0)
            began = at
            for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
                ms = max(round(r["at"].timestamp() * 1000), at)
                if status in ("queued", "processing") and ms - at > stall_ms:
                    status, at, seq = "failed", at + stall_ms, seq + 1
                    yield self.told(key[0], status, at, progress, step, seq, "stalled")
                kind, error = r["kind"], None
                if status is None and kind == queue:
                    status, step = "queued", None
                elif status in ("queued", "processing") and kind in (progress_, done, fail, cancel):
                    if kind == progress_:
                        status, progress, step = "processing", min(max(r["progress"] or 0.0, 0.0), 100.0), r["step"]
                    elif kind == done:
                        status, progress, step = "completed", 100.0, "Complete"
                    else:
                        status, error = "failed", r["step"] if kind == fail else "Cancelled by user"
                else:
                    continue
                at, seq = ms, seq + 1
                yield self.told(key[0], status, at, progress, step, seq, error)
            if status is not None:
                self.state.update((status, at, progress, step, seq))
                if status in ("queued", "processing") and at != began:
                    self.handle.deleteTimer(began + stall_ms)
                    self.handle.registerTimer(at + stall_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            status, at, progress, step, seq = tuple(self.state.get())
            if status in ("queued", "processing") and expiredTimerInfo.getExpiryTimeInMs() >= at + stall_ms:
                self.state.update(("failed", at + stall_ms, progress, step, seq + 1))
                yield self.told(key[0], "failed", at + stall_ms, progress, step, seq + 1, "stalled")

    keyed = events.withWatermark("at", late).groupBy("job")
    return keyed.transformWithState(statefulProcessor=Jobs(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def written(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is and gives what the sink then holds; call it again when more has come. The sink's log of batches lets retried ones count once."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def current(found: DataFrame) -> DataFrame:
    """Each job's last change."""
    last = F.max_by(F.struct("seq", "at", "status", "progress", "step", "error"), "seq")
    return found.groupBy("job").agg(last.alias("x")).select("job", "x.*")


def settled(events: DataFrame, upto, stall_minutes: int = 15) -> DataFrame:
    """The same last states from a finished table of events, by windows: for a second look at what a stream said. ``upto`` is a column: the watermark.

    Of a job's events from its first ``queue`` on, those count that come before a gap of more than the stall and before the first that ends it.
    """
    order = Window.partitionBy("job").orderBy("at", "event_id")
    kind = F.col("kind")
    rows = events.withColumn("began", F.max(F.when(kind == QUEUE, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("began = 1")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    moves = (kind != QUEUE) | (F.row_number().over(order) == 1)
    rows = rows.withColumn("moves", moves)
    gap = F.col("at").cast("double") - F.last(F.when(F.col("moves"), F.col("at").cast("double")), ignorenulls=True).over(before) > stall_minutes * 60
    over = F.coalesce(gap, F.lit(False)) | F.coalesce(F.max(kind.isin(DONE, FAIL, CANCEL)).over(before), F.lit(False))
    rows = rows.withColumn("_over", over)
    rows = rows.withColumn("over", F.max("_over").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counts, place = ~F.col("over") & F.col("moves"), F.struct("at", "event_id")
    last = F.max_by(F.when(counts, F.struct("at", "kind", "step")), F.when(counts, place))
    moved = F.max_by(F.when(counts & (kind == PROGRESS), F.struct("progress", "step")), F.when(counts & (kind == PROGRESS), place))
    one = rows.groupBy("job").agg(F.sum(counts.cast("int")).cast("int").alias("n"), last.alias("last"), moved.alias("moved"), F.max("over").alias("cut"))
    ended = F.col("last.kind").isin(DONE, FAIL, CANCEL)
    # What comes after a job's last event that counts, if that didn't end it, came after a stall.
    stalled = ~ended & (F.col("cut") | (F.col("last.at") + F.expr(f"INTERVAL {stall_minutes} MINUTES") < upto))
    status = F.when(F.col("last.kind") == DONE, "completed").when(ended | stalled, "failed").when(F.col("last.kind") == PROGRESS, "processing").otherwise("queued")
    clipped = F.least(F.greatest(F.coalesce("moved.progress", F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    return one.select(
        "job", (F.col("n") + F.when(stalled, 1).otherwise(0)).cast("int").alias("seq"), F.when(stalled, F.col("last.at") + F.expr(f"INTERVAL {stall_minutes} MINUTES")).otherwise(F.col("last.at")).alias("at"), status.alias("status"),
        F.when(F.col("last.kind") == DONE, 100.0).otherwise(clipped).alias("progress"), F.when(F.col("last.kind") == DONE, "Complete").otherwise(F.col("moved.step")).alias("step"),
        F.when(F.col("last.kind") == FAIL, F.col("last.step")).when(F.col("last.kind") == CANCEL, "Cancelled by user").when(stalled, "stalled").alias("error"),
    )
