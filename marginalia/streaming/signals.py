"""Signal streams: de-duplicated append, late-data filter, rolling and weekly counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signals as G
from ..session import shared_dir
from . import sinks


def dedup_append(stream: DataFrame, work: str | None = None, order: str = "seq",
                 as_of: str | None = None) -> DataFrame:
    """Append only titles never seen before; the set of seen titles does not expire.

    The set is the keyed state of an aggregate: for every title the batch that brought it first and,
    of that batch, its first row. A batch touches the titles it brings, combined before their
    shuffle, and emits those whose first batch it is; nothing that was appended is read again. With
    ``as_of`` items that are too old on arrival are dropped first, undated ones are kept. The report
    (``sinks.report``) counts what arrived and what was too late.
    """
    spark = stream.sparkSession
    work = work or shared_dir(spark, "signal-pool")
    pool = os.path.join(work, "pool")
    schema = G.with_key(stream).schema
    late = ~G.is_fresh(as_of) if as_of else F.lit(False)
    items = G.with_key(stream.withColumn("_late", late).observe(
        "arrivals", F.count(F.lit(1)).alias("arrived"), F.count_if("_late").alias("late")).where("NOT _late").drop("_late"))
    batch = F.current_timestamp()  # the same for all rows of a batch, also when it is repeated
    rest = [c for c in schema.names if c != "key"]
    first = items.withColumn("_batch", batch).groupBy("key").agg(
        F.min_by(F.struct(*rest), F.struct("_batch", order)).alias("_row"), F.min("_batch").alias("_batch"))
    new = first.where(F.col("_batch") == batch).select("key", "_row.*").select(*schema.names)
    sinks.run_available(new, work, sinks.write_batch(pool), "update")
    return sinks.read_batches(spark, pool, schema)


def dedup_within_watermark(stream: DataFrame, ts: str, days: int = G.MAX_AGE_DAYS) -> DataFrame:
    """Bounded alternative: a title may come back after ``days`` without it."""
    return G.with_key(stream).withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["key"])


def rolling_counts(stream: DataFrame, ts: str, days: int = 7, late_days: int = G.MAX_AGE_DAYS) -> DataFrame:
    """Signals per theme over the last days, sliding by one day. A window is closed, and leaves the
    state, when the newest time is ``late_days`` past its end; rows that come later are dropped."""
    return (stream.withWatermark(ts, f"{late_days} days").groupBy(F.window(ts, f"{days} days", "1 day").alias("span"), "theme")
            .agg(F.count(F.lit(1)).alias("n")))


def weekly_counts(stream: DataFrame, ts: str, late_days: int = G.MAX_AGE_DAYS) -> DataFrame:
    """Signals per theme and calendar week from Monday (the epoch is a Thursday), closed as above."""
    return (stream.withWatermark(ts, f"{late_days} days").groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("span"), "theme")
            .agg(F.count(F.lit(1)).alias("n")))


def run_windows(counts: DataFrame, name: str, work: str | None = None) -> DataFrame:
    """(start, theme, n, closed) after the available input: closed windows as the stream appended
    them, and the open ones as they stand in its state."""
    spark = counts.sparkSession
    work = work or shared_dir(spark, name)
    table = os.path.join(work, "closed")
    sinks.run_available(counts, work, sinks.write_batch(table))
    closed = sinks.read_batches(spark, table, counts.schema).select("span.start", "theme", "n", F.lit(True).alias("closed"))
    state = spark.read.format("statestore").load(sinks.checkpoint(work))
    return closed.unionByName(state.select("key.window.start", "key.theme", F.col("value.count").alias("n"), F.lit(False).alias("closed")))
