"""Page-level planning of paged documents; a document carries its pages as an array of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .expr import NON_WS, WS, col, let, strip

PAGES_PER_CHUNK = 10
TEXT_LAYER_CHARS = 100
HEAD_LINES, HEAD_CHARS = 6, 40

# Shapes of chapter headings at the top of a page, and of contents-table lines.
PAGE_HEADINGS = (
    r"(?U)\A(?:第[一二三四五六七八九十百零\d]+[章节篇部分]"
    rf"|#{{1,6}}{WS}+{NON_WS}"
    rf"|[一二三四五六七八九十]+、{NON_WS}"
    rf"|\d+(?:\.\d+){{0,2}}(?:[、.．]|{WS}){WS}*{NON_WS})"
)
DOT_LEADER = rf"(?U)(?:\.{{4,}}|…{{2,}}|·{{4,}}){WS}*\d+{WS}*\z"


def is_break(page_text: str | Column) -> Column:
    """A page starts a chapter when one of its first six lines is a short heading."""
    top = F.split(F.substring_index(F.coalesce(col(page_text), F.lit("")), "\n", HEAD_LINES), "\n")
    return F.exists(F.transform(top, strip), lambda s: (F.length(s) <= HEAD_CHARS)
                    & ~s.rlike(DOT_LEADER) & s.rlike(PAGE_HEADINGS))


@pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def _windows(breaks: pd.Series, limit: pd.Series) -> pd.Series:
    """Greedy page ranges, one pass over the flags; only flags and page numbers leave the engine."""
    def ranges(flags, size):
        start, last = 0, 0
        for page in range(1, len(flags) + 1):
            if page - start >= size:
                cut = last if last > start else page
                yield {"s": start, "e": cut}
                start = cut
            if page < len(flags) and flags[page]:
                last = page
        if start < last < len(flags):  # the last window is cut at its last break, and the rest follows
            yield {"s": start, "e": last}
            start = last
        if start < len(flags):
            yield {"s": start, "e": len(flags)}
    return pd.Series([None if b is None else list(ranges(b, int(n))) for b, n in zip(breaks, limit)], dtype=object)


def plan_chunks(pages: str | Column, limit: int = PAGES_PER_CHUNK) -> Column:
    """Greedy page ranges [start, end): within ``limit`` pages cut at the last break strictly inside
    the window, else at the limit. Linear in the pages."""
    return _windows(F.transform(col(pages), is_break), F.lit(max(1, limit)))


def chunk_text(pages: str | Column, s: Column, e: Column) -> Column:
    return F.array_join(F.slice(col(pages), s + 1, e - s), "\n", "")


def has_text_layer(pages: str | Column, s: Column, e: Column) -> Column:
    """Average characters per page of the range reach the threshold."""
    total = F.aggregate(F.slice(col(pages), s + 1, e - s), F.lit(0),
                        lambda a, t: a + F.length(F.coalesce(t, F.lit(""))))
    return total / F.greatest(e - s, F.lit(1)) >= TEXT_LAYER_CHARS


def first_engine(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first engine with non-blank output, in order of preference; null when all failed."""
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for engine, out in reversed(candidates):
        ok = strip(out) != ""
        name = F.when(ok, F.lit(engine)).otherwise(name)
        text = F.when(ok, out).otherwise(text)
    return name, text
