"""Helpers shared by the training-data operators: tables, staged results, folds, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CHARS = 1_500_000  # code points a Python task works on at once; a longer text is a batch alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, deleted when the application ends.

    Where the setting is absent (tests on one machine) a temporary folder takes its place; on a
    cluster that is an error, because executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="staged-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage, so that
    a lost executor costs a re-read and every later step sees the same rows."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The held-out fold: crc32 of the id as text leaves remainder 1 of 3. A null id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def sampled(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows, or all if there are fewer: those whose key's hash is below a bound.
    The same rows are taken every time, and no row has to meet another one for it."""
    n = df.select(key).count()
    share = 2**30 if n <= rows else int(2**30 * rows / n)
    return df.filter(F.pmod(F.xxhash64(key), F.lit(2**30)) < share)


def text_batches(batches: Iterator[pa.RecordBatch], text: str = "_text",
                 limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts (null: empty) hold about ``limit`` code points."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                if size and size + len(t) > limit:
                    yield batch.slice(start, i - start), texts[start:i]
                    start, size = i, 0
                size += len(t)
            if start < len(texts):
                yield batch.slice(start), texts[start:]


def byte_slices(batches: Iterator[pa.RecordBatch], text: str = "_text",
                limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text (a longer one alone), with the bytes of
    the slice and where each text starts in them (one entry more at the end). Null counts as empty."""
    for whole in batches:
        lengths = np.nan_to_num(pc.binary_length(whole.column(text)).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < whole.num_rows:
            base = ends[start] - lengths[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            batch = whole.slice(start, stop - start)
            column = batch.column(text)
            wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
            _, offsets, data = column.buffers()
            begin = np.frombuffer(offsets, dtype=wide)[column.offset:column.offset + len(column) + 1]
            raw = np.frombuffer(data, dtype=np.uint8)[begin[0]:begin[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
            yield batch, raw, np.concatenate([[0], ends[start:stop] - base])
            start = stop
