"""Incremental corpus index: only files that differ from the stored index are read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import corpus_files as S
from ..sources import versions


def incremental_index(spark: SparkSession, root: str, work: str | None = None) -> DataFrame:
    """Bring the index in ``work`` up to date with the Markdown files below ``root`` and return it.

    The listing (path, time, length) is written as a table and compared with the listing of the last
    run. New and changed files are opened by the tasks that hold their rows, whatever their
    modification time; the rows of changed and removed files go. Neither the listing nor a path comes
    to the driver. Index and listing come into force together, by one commit record, so a failed run
    changes nothing and one of two runs at once wins.
    """
    work = work or shared_dir(spark, "index")
    table = os.path.join(work, "index")
    key = S.LISTING.names
    number, content = versions.last(spark, table)
    docs_at, seen_at = versions.data_path(table), versions.data_path(table)
    try:
        S.list_files(spark, root).write.parquet(seen_at)
        listing = spark.read.schema(S.LISTING).parquet(seen_at)
        known = spark.read.schema(S.LISTING).parquet(content["seen"]) if content else spark.createDataFrame([], S.LISTING)
        fresh = S.index_files(S.read_listed(listing.join(known, key, "left_anti")), root)
        stored = spark.read.schema(fresh.schema).parquet(content["folder"]) if content else spark.createDataFrame([], fresh.schema)
        stays = S.relative_path(listing.join(known, key, "left_semi"), root).select(F.col("rel").alias("path"))
        docs = stored.join(stays, "path", "left_semi").select(*fresh.columns).unionByName(fresh)
        docs.write.parquet(docs_at)
        versions.commit(spark, table, number + 1, {"folder": docs_at, "seen": seen_at})
    except BaseException:
        versions.delete(spark, docs_at)
        versions.delete(spark, seen_at)
        raise
    versions.forget(spark, table, folders=lambda r: {r["folder"], r["seen"]})
    return versions.read(spark, table, fresh.schema)
