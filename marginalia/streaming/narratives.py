"""Narrative state: history rows as updates arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..operators import narratives as N
from ..session import shared_dir
from ..sources import upserts
from .sinks import batch_path, read_batches, run_available


def narrative_history(stream: DataFrame, work: str | None = None) -> DataFrame:
    """History rows of a stream of updates that arrives in sequence order.

    Each micro-batch runs the batch operator, started from the narratives known so far. These lie in
    a keyed table: a batch reads and rewrites the buckets of its own themes. A theme with a third of
    all updates is processed like in batch, not by one stateful task. The table is changed last, so a
    batch that is repeated starts from the same state, or finds that all of it has been done.
    """
    spark = stream.sparkSession
    work = work or shared_dir(spark, "narratives")
    log, state = os.path.join(work, "history"), os.path.join(work, "state")
    hist_schema = N.history(spark.createDataFrame([], stream.schema)).schema

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id <= upserts.applied(session, state):
            return
        batch = batch.persist()
        now = N.current(batch).select("theme", "seq", "narrative").persist()
        before = upserts.lookup(session, state, now.schema, now, ["theme"])
        N.history(batch, before).write.mode("overwrite").parquet(batch_path(log, batch_id))
        upserts.upsert(now, state, ["theme"], batch_id)
        now.unpersist()
        batch.unpersist()

    run_available(stream, work, each)
    return read_batches(spark, log, hist_schema)
