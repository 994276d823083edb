"""Keyed tables that are updated in place: rows lie in buckets of their key's hash.

A change reads and rewrites only the buckets its keys fall into; the commit record of the new version
names, for every bucket, the folder it was written to last (see ``versions`` for how a record comes
into force). A rewritten bucket is one file again, so nothing piles up that would have to be
compacted later. When the buckets hold more than ``ROWS`` rows on average, the next change deals the
table out anew into as many more as needed, so a bucket stays small whatever the table's size, and
the work of a change follows the number of its keys.

The record also keeps the number of the last change (a stream's batch id): a change that is repeated
after a failure finds that it has been made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions

BUCKETS, ROWS = 16, 200_000


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folders(content: dict) -> set[str]:
    return {folder for folder, _ in content["parts"].values()}


def applied(spark: SparkSession, path: str) -> int:
    """Number of the last change, -1 before the first."""
    content = versions.last(spark, path)[1]
    return content["change"] if content else -1


def _read(spark: SparkSession, content: dict | None, schema: T.StructType, wanted: set[int] | None) -> DataFrame:
    parts = [f"{folder}/bucket={b}" for b, (folder, rows) in (content["parts"] if content else {}).items()
             if rows and (wanted is None or int(b) in wanted)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the version in force."""
    return _read(spark, versions.last(spark, path)[1], schema, None)


def _touched(keys: DataFrame, names: Sequence[str], buckets: int) -> set[int]:
    """The buckets of the keys: at most ``buckets`` small numbers, whatever the number of keys."""
    return {r[0] for r in keys.select(_bucket(names, buckets)).distinct().collect()}


def lookup(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the table with a key in ``keys``, read from the buckets of these keys only."""
    content = versions.last(spark, path)[1]
    if content is None:
        return spark.createDataFrame([], schema)
    found = _read(spark, content, schema, _touched(keys, names, content["buckets"]))
    return found.join(keys.select(*names).distinct(), list(names), "left_semi").select(*schema.names)


def upsert(changes: DataFrame, path: str, names: Sequence[str], change: int, buckets: int = BUCKETS, rows: int = ROWS) -> None:
    """Put the rows of ``changes`` (unique keys) in place of the table's rows with the same keys.

    ``change`` counts up; one that is not above the last is taken as repeated and does nothing.
    """
    spark, schema = changes.sparkSession, changes.schema
    number, content = versions.last(spark, path)
    if content and change <= content["change"]:
        return
    count = content["buckets"] if content else buckets
    total = sum(n for _, n in content["parts"].values()) if content else 0
    wider = count
    while total > wider * rows:
        wider *= 2
    touched = None if wider != count else _touched(changes, names, count)
    if touched == set():
        versions.commit(spark, path, number + 1, {"change": change, "buckets": count, "parts": content["parts"] if content else {}})
        return
    stays = _read(spark, content, schema, touched).join(changes.select(*names), list(names), "left_anti")
    merged = stays.select(*schema.names).unionByName(changes).withColumn("bucket", _bucket(names, wider))
    wide = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    folder = versions.data_path(path)
    try:
        merged.repartition(wider if touched is None else len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
        counts = spark.read.schema(wide).parquet(folder).groupBy("bucket").count().collect()  # a row per bucket
        parts = {} if touched is None or not content else dict(content["parts"])
        parts |= {str(r["bucket"]): (folder, r["count"]) for r in counts}
        versions.commit(spark, path, number + 1, {"change": change, "buckets": wider, "parts": parts})
    except BaseException:
        versions.delete(spark, folder)
        raise
    versions.forget(spark, path, folders=_folders)
