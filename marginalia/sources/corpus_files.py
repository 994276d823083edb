"""Corpus folders: scan Markdown files, decode them, build and store the index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import metadata as M
from ..functions.expr import col, quoted
from ..operators.corpus import NO_TRACK
from ..operators.lookup import first_keyword
from . import versions

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


@pandas_udf(T.StringType())
def _gbk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def decode(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return None
    for raw in batches:
        yield raw.map(decode)


def decode_utf8(content: str | Column) -> Column:
    """Text of valid UTF-8 bytes, else null."""
    c = col(content)
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))


def decode_text(files: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """UTF-8, else GBK, else UTF-8 with replacement signs. Only bytes that are not UTF-8 reach
    Python; the others are passed as null."""
    rest = F.when(decode_utf8(content).isNull(), F.col(content))
    return files.withColumn(out, F.coalesce(
        decode_utf8(content), _gbk(rest), F.make_valid_utf8(F.col(content).cast("string"))))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files in the root folder and one level of folders below it."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
    top = reader.load(root)
    below = _exists_glob(spark, f"{root}/*/*.md")
    return top.unionByName(reader.load(f"{root}/*/*.md")) if below else top


def _exists_glob(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


LISTING = T.StructType(BINARY_SCHEMA.fields[:3])
LISTED_AT_ONCE, READ_AT_ONCE = 10_000, 32_000_000  # files of a listing, and bytes of contents, held by a task


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a path, the path in it, and what stands before such paths."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[:path.index(inner)] if inner in path else ""


def _entries(folders: DataFrame) -> DataFrame:
    """(path, is_folder, modificationTime, length) of what lies in the folders, listed by the tasks.
    Hidden names are left out, as Spark's own sources do."""
    def run(batches):
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, inner, before = _opened(folder)
                infos = [x for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.base_name[:1] not in "._"]
                for k in range(0, len(infos), LISTED_AT_ONCE):
                    part = infos[k:k + LISTED_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([before + x.path for x in part], pa.string()), pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()),
                        pa.array([x.mtime for x in part], pa.timestamp("us", "UTC")), pa.array([x.size or 0 for x in part], pa.int64())],
                        names=["path", "is_folder", "modificationTime", "length"])

    return folders.mapInArrow(run, "path string, is_folder boolean, modificationTime timestamp, length long")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of the Markdown files in the root folder and one level below
    it. Folders are listed by tasks, one row each; no path comes to the driver."""
    top = _entries(spark.createDataFrame([(root,)], "folder string"))
    folders = top.where("is_folder").select(F.col("path").alias("folder"))
    below = _entries(folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder"))
    return top.union(below).where("NOT is_folder AND path LIKE '%.md'").select(*LISTING.names)


def read_listed(files: DataFrame) -> DataFrame:
    """The listed files with their contents, opened by the tasks that the rows are dealt to. A file
    that has gone since it was listed has null content."""
    spark = files.sparkSession

    def run(batches):
        for batch in batches:
            held, at = [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                system, inner, _ = _opened(path)
                try:
                    with system.open_input_stream(inner) as f:
                        held.append(f.read())
                except FileNotFoundError:
                    held.append(None)
                if i + 1 == batch.num_rows or sum(len(x) for x in held if x) >= READ_AT_ONCE:
                    part = batch.slice(at, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=BINARY_SCHEMA.names)
                    held, at = [], i + 1

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select(*LISTING.names).repartition(parts, "path").mapInArrow(run, BINARY_SCHEMA)


def relative_path(files: DataFrame, root: str) -> DataFrame:
    """Add ``rel``, the path below the root folder."""
    quoted_root = quoted(root.strip("/"))
    return files.withColumn("rel", F.regexp_extract("path", r"\A(?:file:/*|[a-z0-9]+://[^/]*)?/?" + quoted_root + r"/(.*)\z", 1))


def index_files(files: DataFrame, root: str, keywords: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Index rows of binary files: place in the corpus, metadata of the head, status and track.

    Files that are not UTF-8 and files below the first folder level are left out.
    """
    rows = relative_path(files, root).select("rel", "modificationTime", "length", decode_utf8("content").alias("text"))
    rows = rows.where("text IS NOT NULL AND rel <> '' AND size(split(rel, '/')) <= 2")
    name = F.substring_index("rel", "/", -1)
    docs = rows.select(
        F.col("rel").alias("path"), name.alias("name"),
        F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1)).otherwise("").alias("category_key"),
        M.file_type(name).alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        *[c.alias(n) for n, c in M.extract_all("text").items()], F.col("text").alias("content"))
    return docs.withColumn("track", first_keyword(F.concat_ws(" ", "name", "title"), list(keywords), NO_TRACK))


def build_index(spark: SparkSession, root: str, keywords: Sequence[tuple[str, str]] = ()) -> DataFrame:
    return index_files(read_files(spark, root), root, keywords)


def write_index(docs: DataFrame, path: str) -> None:
    """Store the index by category, so category queries read only their folder. The former index
    stays in force until the new one is complete."""
    rows = docs.withColumn("part", F.col("category_key"))
    versions.publish(docs.sparkSession, path, lambda aside: rows.write.partitionBy("part").parquet(aside))


def load_index(spark: SparkSession, root: str, path: str, force: bool = False,
               keywords: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The stored index, built first when no complete one is published or ``force`` is set."""
    if force or versions.latest(spark, path) is None:
        write_index(build_index(spark, root, keywords), path)
    return versions.read(spark, path).drop("part")
