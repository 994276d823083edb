"""Stale-job detection over a stream of heartbeats, by timers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.jobs import STALE_SECS, norm_status, stale_after
from ..operators.ordered import keep_last
from ..session import shared_dir
from . import sinks


class _Heartbeats(StatefulProcessor):
    """Per job the newest beat and, while it runs, a timer for the moment it will have been silent
    too long. A newer beat moves the timer; when it goes off the job is reported as interrupted, until
    a newer beat shows that it runs."""

    def __init__(self, until_ms: int | None):
        self.until_ms = until_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        beat = max(rows, key=lambda r: r["ms"])
        if self.last.exists() and self.last.get()[1] > beat["ms"]:
            return
        self.last.update((beat["status"], beat["ms"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = beat["ms"] + 1000 * beat["stale_secs"]
        if beat["status"] == "running" and (self.until_ms is None or due < self.until_ms):
            self.handle.registerTimer(due + 1)
        yield Row(job=key[0], ms=beat["ms"], at=beat["ms"], status=beat["status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = self.last.get()[1]
        self.last.update(("interrupted", ms))
        yield Row(job=key[0], ms=ms, at=expiredTimerInfo.getExpiryTimeInMs(), status="interrupted")

    def close(self) -> None:
        pass


def _newest_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest beat of every job of an Arrow batch, so that a busy job sends few rows to its task."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("job", "ascending"), ("ms", "ascending")]))
        job = batch.column("job")
        if batch.num_rows:
            last = pc.fill_null(pc.not_equal(job.slice(0, batch.num_rows - 1), job.slice(1)), True)
            yield batch.filter(pa.concat_arrays([last, pa.array([True])]))


def status_changes(beats: DataFrame, until: str | None = None, stale: Column | None = None) -> DataFrame:
    """(job, ms, at, status): every newer beat of a job (at its time ``ms``), and ``interrupted`` as soon as the clock shows that
    a running one has been silent for too long: 600 s, or 120 s for kinds of chat (column ``kind``), or
    as many seconds as ``stale`` says.

    Timers follow the clock, so a job is reported without any new input. ``until`` replays a log up to
    a moment of the past: what would have gone off by then does, later timers are not set.
    """
    until_ms = None
    if until is not None:
        until_ms = beats.sparkSession.sql("SELECT unix_millis(CAST(? AS TIMESTAMP))", args=[until]).first()[0]
    secs = stale if stale is not None else stale_after(F.col("kind")) if "kind" in beats.columns else F.lit(STALE_SECS)
    narrow = beats.select("job", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "status", secs.cast("long").alias("stale_secs"))
    narrow = narrow.where("job IS NOT NULL AND ms IS NOT NULL")
    fewer = narrow.mapInArrow(_newest_of_each, narrow.schema)
    out = T.StructType([T.StructField("job", beats.schema["job"].dataType), T.StructField("ms", T.LongType()),
                        T.StructField("at", T.LongType()), T.StructField("status", T.StringType())])
    sinks.on_state_store(beats.sparkSession)
    return fewer.groupBy("job").transformWithState(_Heartbeats(until_ms), out, "Update", "ProcessingTime")


def run_statuses(beats: DataFrame, until: str | None = None, work: str | None = None) -> DataFrame:
    """Last known status per job (job, ms, at, status) after the available input."""
    spark = beats.sparkSession
    work = work or shared_dir(spark, "heartbeats")
    log = os.path.join(work, "changes")
    changes = status_changes(beats, until)
    sinks.run_available(changes, work, sinks.write_batch(log), "update", idle_batches=False)
    return keep_last(sinks.read_batches(spark, log, changes.schema), ["job"], ["ms", "at"])


def last_heartbeats(beats: DataFrame) -> DataFrame:
    """Latest status and time per job of a table of beats."""
    return beats.groupBy("job").agg(F.max("ts").alias("last_ts"), F.max_by("status", "ts").alias("status"))


def with_staleness(last: DataFrame, now: str, stale_secs: int = STALE_SECS) -> DataFrame:
    """Status at ``now``: running without an update for too long is interrupted."""
    idle = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_ts")
    return last.withColumn("status", norm_status(F.col("status"), idle, stale_secs=stale_secs))
