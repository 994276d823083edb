"""Fill-in-the-middle: a document's middle is moved behind its end by rotating blocks in place.

A text is cut into units (white space and the word behind it; white space at the end is a unit of
its own). Hashes of the document's id draw the two cuts and the form. The cuts are scanned on the
UTF-8 bytes of a whole Arrow batch at once. Then each document is a bytearray: the sentinels are
inserted before prefix, middle and suffix, and two neighbouring blocks change places by three
reversals. ``restore`` finds the blocks by their sentinels, rotates back and takes the sentinels out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED, SHARE, SPM_SHARE = 42, 50, 80  # per cent of the documents to transform, and of those in the order suffix first


def draws(key: str | Column = "doc_id", seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits drawn by the id; a null id draws like an empty one."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rotate(block: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange ``block[start:middle]`` and ``block[middle:end]`` by three reversals."""
    block[start:middle] = block[start:middle][::-1]
    block[middle:end] = block[middle:end][::-1]
    block[start:end] = block[start:end][::-1]


def transform(text: bytes, cut: int, second: int, form: str) -> bytes:
    """``text`` with its parts ``[:cut]``, ``[cut:second]`` and ``[second:]`` in the order of ``form``."""
    if form == PLAIN:
        return text
    block = bytearray(text)
    block[second:second] = SUFFIX
    block[cut:cut] = MIDDLE
    block[0:0] = PREFIX
    middle = len(PREFIX) + cut
    suffix = len(PREFIX) + len(MIDDLE) + second
    rotate(block, middle if form == PSM else 0, suffix, len(block))
    return bytes(block)


def invert(output: bytes, form: str) -> bytes:
    """The text of which ``transform`` made ``output``. A transformed text holds no sentinel, so each
    is found where it was set: none can arise across the border of a part."""
    if form == PLAIN:
        return output
    block = bytearray(output)
    if form == PSM:
        start = block.index(SUFFIX)
        rotate(block, start, block.index(MIDDLE), len(block))
    else:
        rotate(block, 0, block.index(PREFIX), len(block))
    at = block.index(SUFFIX)
    del block[at:at + len(SUFFIX)]
    at = block.index(MIDDLE)
    del block[at:at + len(MIDDLE)]
    del block[:len(PREFIX)]
    return bytes(block)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of all texts end, and the number of the first of each text (one entry more)."""
    blank = _BLANK[raw]
    ends_here = np.zeros(len(raw), dtype=bool)
    ends_here[:-1] = ~blank[:-1] & blank[1:]
    filled = starts[1:] > starts[:-1]
    ends_here[starts[1:][filled] - 1] = True  # of a last word, or of white space at the end
    ends = np.flatnonzero(ends_here) + 1
    return ends, np.searchsorted(ends, starts, side="right")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: int = SEED,
                   share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The kept columns with ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (code
    points, null for a plain text) and ``output``.

    A null text counts as an empty one. Empty texts and those that contain a sentinel stay plain.
    Repeated rows get equal results, an empty table an empty one. Columns that are not kept play no
    part, whatever their names.
    """
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"),
                       *[d.alias(f"_h{i}") for i, d in enumerate(draws(key, seed))])

    def run(batches):
        for batch, raw, starts in byte_slices(batches, "_text"):
            h = [batch.column(f"_h{i}").to_numpy() for i in range(4)]
            ends, first = unit_ends(raw, starts)
            n = np.diff(first)
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            ends = np.append(ends, 0)
            cuts = [np.where(k == 0, starts[:-1], ends[first[:-1] + k - 1]) - starts[:-1]
                    for k in (np.minimum(one, two), np.maximum(one, two))]
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            wanted = (h[2] % 100 < share) & (n > 0)
            forms, outputs = [], []
            for i, (a, b, cut, second) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), cuts[0].tolist(), cuts[1].tolist())):
                own, form = raw[a:b].tobytes(), PLAIN
                if wanted[i] and PREFIX not in own and SUFFIX not in own and MIDDLE not in own:
                    form = SPM if h[3][i] % 100 < spm_share else PSM
                forms.append(form)
                outputs.append(transform(own, cut, second, form))
            plain = np.array([f == PLAIN for f in forms], dtype=bool)
            at = [starts[:-1], starts[:-1] + cuts[0], starts[:-1] + cuts[1]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f"_k{i}") for i in range(len(keep))], pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(chars[at[1]] - chars[at[0]], pa.int64(), mask=plain), pa.array(chars[at[2]] - chars[at[1]], pa.int64(), mask=plain),
                 pa.array(outputs, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def restore(docs: DataFrame, output: str = "output", form: str = "form", out: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the text rebuilt from output and form alone; a null output gives null."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.StringType())])
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(output).cast("binary").alias("_output"),
                       F.col(form).alias("_form"))

    def run(batches):
        for batch, raw, starts in byte_slices(batches, "_output"):
            absent = batch.column("_output").is_null().to_pylist()
            texts = [None if gone else invert(raw[a:b].tobytes(), f) for gone, a, b, f in zip(
                absent, starts[:-1].tolist(), starts[1:].tolist(), batch.column("_form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_k{i}") for i in range(len(keep))], pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)

