"""How streams run: over what is available, with keyed state on RocksDB, a folder per micro-batch as
sink, and a report of what every batch read and kept."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from ..sources import upserts

# Files count whatever their modification time; the source's own default drops those a week older
# than the newest one.
MAX_FILE_AGE = "36500d"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REPORT = "batch_id long, rows_read long, state_rows long, late_in_state long, observed map<string, long>"


def stream_table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A parquet table of the folder as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE).options(**options)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def batch_path(table: str, batch_id: int) -> str:
    return os.path.join(table, f"batch_id={batch_id}")


def on_state_store(spark: SparkSession) -> None:
    """Keyed state lies on local disk with its changes in the checkpoint, so it may outgrow memory and
    a batch touches only the keys it brings. A stream keeps the store it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _report_row(progress) -> dict:
    """What one batch did. Observed metrics are the numbers the stream itself counted."""
    progress = json.loads(progress.json) if hasattr(progress, "json") else progress
    states = progress.get("stateOperators", [])
    observed = {k: v for row in (progress.get("observedMetrics") or {}).values() for k, v in dict(row).items()}
    return {"batch_id": progress["batchId"], "rows_read": progress["numInputRows"], "state_rows": sum(s["numRowsTotal"] for s in states),
            "late_in_state": sum(s["numRowsDroppedByWatermark"] for s in states), "observed": observed}


def run_available(stream: DataFrame, work: str, each: Callable[[DataFrame, int], None],
                  mode: str = "append", idle_batches: bool = True) -> None:
    """Process what is there now, one micro-batch after another, and stop. The batches are added to
    the report in ``work``. Without ``idle_batches`` the run ends with the last batch of input; a stream
    with timers of the clock would otherwise go on for good."""
    spark, setting = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    on_state_store(spark)
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(idle_batches).lower())
    try:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint(work))
                 .trigger(availableNow=True).foreachBatch(each).start())
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    rows = [_report_row(p) for p in query.recentProgress]
    if rows:
        spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("append").json(os.path.join(work, "report"))


def checkpoint(work: str) -> str:
    return os.path.join(work, "checkpoint")


def report(spark: SparkSession, work: str) -> DataFrame:
    """(batch_id, rows_read, state_rows, late_in_state, observed) of the batches run so far."""
    return spark.read.schema(REPORT).json(os.path.join(work, "report"))


def write_batch(table: str) -> Callable[[DataFrame, int], None]:
    """Append sink: a folder per batch, overwritten when the batch is repeated."""
    return lambda df, i: df.write.mode("overwrite").parquet(batch_path(table, i))


def read_batches(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(table).select(*[F.col(c) for c in schema.names])


def run_to_table(stream: DataFrame, name: str, keys: list[str], work: str | None = None) -> DataFrame:
    """Run an aggregate in update mode over the available input: each batch brings the keys that
    changed, which take the place of their rows in a keyed table. They are written first, as the state
    of a batch can be taken once only."""
    spark = stream.sparkSession
    work = work or shared_dir(spark, name)
    table, changed = os.path.join(work, "table"), os.path.join(work, "changed")

    def each(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(changed)
        upserts.upsert(df.sparkSession.read.schema(stream.schema).parquet(changed), table, keys, batch_id)

    run_available(stream, work, each, "update")
    return upserts.read(spark, table, stream.schema)
