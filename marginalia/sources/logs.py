"""JSON state files and line-delimited logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import is_blank, strip
from . import versions

COST_SCHEMA = ("ts STRING, feature STRING, model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, "
               "cost DOUBLE, estimated BOOLEAN")
CORRUPT = "_corrupt_record"


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file as rows. A missing file is empty, and so is one that is not valid JSON."""
    fields = T._parse_datatype_string(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], fields)
    files = spark.read.text(path, wholetext=True)
    valid = F.try_parse_json("value").isNotNull()
    return files.where(valid).select(F.inline(F.from_json("value", T.ArrayType(fields))))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_cost_lines(lines: DataFrame, schema: str = COST_SCHEMA) -> DataFrame:
    """Parse log lines; blank lines are skipped and broken ones flagged instead of voiding the log."""
    wide = f"{schema}, {CORRUPT} STRING"
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(~is_blank("value")).withColumn("_r", parsed)
    corrupt = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    fields = [f.name for f in T._parse_datatype_string(schema)]
    return rows.select(*[c for c in lines.columns if c != "value"], *[F.col(f"_r.{f}").alias(f) for f in fields],
                       corrupt.alias("corrupt"))


def url_list(lines: DataFrame) -> DataFrame:
    """One address per line; blank lines and lines that begin with ``#`` are dropped."""
    return lines.where(~is_blank("value") & ~F.col("value").startswith("#")).withColumn("value", strip("value"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_state(rows: DataFrame, path: str) -> None:
    """Replace a state table as a whole. The rows may come from the version in force; if the write
    fails, that version stays."""
    versions.publish(rows.sparkSession, path, rows.write.parquet)


def load_state(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The state saved last; with a schema, an empty table before the first."""
    return versions.read(spark, path, schema)
