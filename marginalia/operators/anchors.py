"""Which of many strings occur in which of many texts: a join on the rarest gram of each string.

A gram is three neighbouring UTF-8 bytes, or a shorter string as a whole, as a number below ``GRAMS``.
A string (needle) can only occur in a text that holds all of its grams, so it is kept under one of
them, its anchor: the gram that the fewest texts of a sample hold. A text emits the distinct anchors
it holds, text and needles meet on the anchor, and ``contains`` decides. Which grams are anchors is a
bit map of ``GRAMS`` bits (2 MB), whatever the number of needles, so it may go to every task, and a
text emits nothing for the grams that are none. Anchors that many texts hold are salted: their texts
are dealt over ``SALTS`` keys and their needles are repeated for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

GRAMS = (1 << 24) + (1 << 16) + (1 << 8)
SAMPLE = 64  # one of so many texts is looked at for the frequency of a gram
SALTS, HOT, HOT_TEXTS = 16, 4096, 1_000_000  # keys of a hot anchor, how many are salted, and the number of texts that makes one hot
BATCH_BYTES = 1 << 18  # bytes of text looked at in one go; numpy takes up to 250 times as many
EMIT_ROWS, EMIT_BYTES = 65536, 1 << 24  # of an emitted batch


def gram_codes(raw: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts laid end to end in ``raw``, and the text of each. With ``wanted``, only grams
    whose bit is set; ``whole`` leaves out the bytes and pairs of texts that are longer."""
    codes, owners = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    length = np.diff(starts)
    for n, base in ((1, (1 << 24) + (1 << 16)), (2, 1 << 24), (3, 0)):
        if len(raw) < n or wanted is not None and not wanted[base >> 3:(base + (1 << 8 * n)) >> 3].any():
            continue
        code = raw[:len(raw) - n + 1].astype(np.int32)
        for k in range(1, n):
            code = code << 8 | raw[k:len(raw) - n + 1 + k]
        if whole and n < 3:
            at = starts[:-1][length == n]
        else:
            inside = np.ones(len(code), dtype=bool)
            for k in range(1, n):  # grams that would run into the next text
                last = starts[1:] - k
                inside[last[(last >= 0) & (last < len(code))]] = False
            if wanted is not None:
                inside &= (wanted[(code + base) >> 3] >> (code & 7).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(inside)
        codes.append(code[at].astype(np.int64) + base)
        owners.append(np.searchsorted(starts, at, side="right") - 1)
    return np.concatenate(codes), np.concatenate(owners)


def distinct_grams(raw: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """``gram_codes`` without repeats, in order of text and gram. What is longer than ``BATCH_BYTES`` is one
    text (see ``_slices``), and is gone through in pieces that overlap by two bytes."""
    if len(raw) <= BATCH_BYTES:
        codes, owner = gram_codes(raw, starts, wanted, whole)
        pair = np.unique(owner * (1 << 25) + codes)
        return pair & ((1 << 25) - 1), pair >> 25
    found, new, held = np.zeros(0, dtype=np.int64), [], 0
    for at in range(0, len(raw) - 2, BATCH_BYTES):
        piece = raw[at:at + BATCH_BYTES + 2]
        new.append(np.unique(gram_codes(piece, np.array([0, len(piece)]), wanted, whole)[0]))
        held += len(new[-1])
        if held > max(len(found), 1 << 20):
            found, new, held = np.unique(np.concatenate([found, *new])), [], 0
    found = np.unique(np.concatenate([found, *new]))
    return found, np.zeros(len(found), dtype=np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of bounded size with the bytes of ``_text`` and where each text starts."""
    for whole in batches:
        column = whole.column("_text").fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        start = 0
        while start < whole.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_BYTES, side="right")) - 1)
            yield whole.slice(start, stop - start), data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
            start = stop


def _grams(texts: DataFrame, text: str, carry: Sequence[str], wanted: np.ndarray | None, hot: np.ndarray | None = None,
           whole: bool = False) -> DataFrame:
    """The carried columns once for every distinct gram of the row's text (that is ``wanted``), with
    the gram as ``_code`` and a salt as ``_salt``."""
    schema = T.StructType([*texts.select(*carry).schema.fields, T.StructField("_code", T.LongType()), T.StructField("_salt", T.IntegerType())])
    hot = np.zeros(0, dtype=np.int64) if hot is None else hot
    names = [f"_c{k}" for k in range(len(carry))]

    def run(batches):
        dealt = 0
        for batch, raw, starts in _slices(batches):
            codes, owner = distinct_grams(raw, starts, wanted, whole)
            salt = np.where(np.isin(codes, hot), (owner + dealt) % SALTS, 0).astype(np.int32)
            dealt += batch.num_rows
            widest = max(int(np.diff(starts).max()), 1) if text in carry else 1
            step = max(1, min(EMIT_ROWS, EMIT_BYTES // widest))
            for i in range(0, len(codes), step):
                rows = batch.select(names).take(pa.array(owner[i:i + step]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(codes[i:i + step]), pa.array(salt[i:i + step])], names=schema.names)

    return texts.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], F.col(text).alias("_text")).mapInArrow(run, schema)


def _bit_map(anchors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit per gram, set for the anchors, and the hot ones: at most 515 rows of 4 KB, with at most
    ``HOT`` numbers each, come to the driver."""
    bits = np.zeros(516 * 4096, dtype=np.uint8)
    often = F.when(F.col("_n") * SAMPLE >= HOT_TEXTS, F.struct("_n", "_code"))
    parts = anchors.groupBy("_code").agg(F.max("_n").alias("_n")).groupBy(F.expr("bitmap_bucket_number(_code + 1)").alias("part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_code + 1))").alias("bits"),
        F.slice(F.sort_array(F.collect_list(often), asc=False), 1, HOT).alias("hot")).collect()
    for r in parts:
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[(r["part"] - 1) * 4096:(r["part"] - 1) * 4096 + len(own)] = own
    hot = sorted(((n, code) for r in parts for n, code in r["hot"]), reverse=True)[:HOT]
    return bits, np.array(sorted(code for _, code in hot), dtype=np.int64)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def candidates(texts: DataFrame, text: str, carry: Sequence[str], needles: DataFrame, needle: str) -> DataFrame:
    """(carried columns, needle) for every text that holds the needle's anchor; a superset of the
    pairs in which the text contains the needle. Needles are distinct and not empty.

    While the plan is built the anchors are staged, and their bit map and the list of hot ones come to
    the driver, both of bounded size. Texts and needles are read twice each, so stage what is dear
    to compute.
    """
    own = _grams(needles.select(F.col(needle).alias("_needle")), "_needle", ["_needle"], None, whole=True).drop("_salt")
    some = texts.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    often = _grams(some, text, [], None).groupBy("_code").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_code").alias("code"))).alias("_a")
    anchors = staged(own.join(often, "_code", "left").groupBy("_needle").agg(rarest).select(
        F.col("_needle").alias(needle), F.col("_a.code").alias("_code"), F.col("_a.n").alias("_n")), "anchors")
    bits, hot = _bit_map(anchors)
    emitted = _grams(texts, text, carry, bits, hot)
    salts = F.when(F.array_contains(F.lit(hot.tolist()).cast("array<bigint>"), F.col("_code")), SALTS).otherwise(1) if len(hot) else F.lit(1)
    keyed = anchors.select("_code", needle, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    return emitted.join(keyed, ["_code", "_salt"]).drop("_code", "_salt")
