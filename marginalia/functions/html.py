"""Entity decoding beyond the common references."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .expr import col, let
from .text import unescape

# What Python's html module takes for a character reference, with or without its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
RARE = r"&(?!(?:amp|lt|gt|quot|#39|nbsp);)#?[0-9A-Za-z]"


@arrow_udf(T.ArrayType(T.StringType()))
def _decode(references: pa.Array) -> pa.Array:
    """Each reference decoded by itself; repeated ones are decoded once per batch."""
    own = references.flatten().dictionary_encode()
    known = pa.array([html.unescape(r) for r in own.dictionary.to_pylist()], pa.string())
    sizes = references.value_lengths().fill_null(0).to_numpy().cumsum()
    offsets = pa.array([0, *sizes.tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, known.take(own.indices), mask=references.is_null())


def unescape_all(c: str | Column) -> Column:
    """Decode every character reference. Rows that hold only the common ones stay in the JVM; of the others
    only the references leave it, and the text between them is joined with what they stand for."""
    references = let(col(c), lambda t: F.when(t.rlike(RARE), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))))

    def join(v: Column) -> Column:
        pieces = F.zip_with(F.split(v["text"], REFERENCE, -1), v["decoded"], lambda t, r: F.concat(t, F.coalesce(r, F.lit(""))))
        return F.when(v["decoded"].isNotNull(), F.array_join(pieces, "")).otherwise(unescape(v["text"]))

    return let(F.struct(col(c).alias("text"), _decode(references).alias("decoded")), join)
