"""Paged documents: chunk plan, engine fallback, totals. A document is a row with its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions.expr import is_blank, strip


def page_breaks(docs: DataFrame, key: str) -> DataFrame:
    flags = F.transform("pages", P.is_break)
    return docs.select(key, F.posexplode(flags).alias("page", "_b")).where("_b").select(key, "page")


def chunk_plan(docs: DataFrame, key: str, limit: int = P.PAGES_PER_CHUNK) -> DataFrame:
    """Chunks [start, end) of every document, numbered, with the text-layer test."""
    rows = docs.select(key, "pages", F.posexplode(P.plan_chunks("pages", limit)).alias("chunk", "_c"))
    s, e = F.col("_c.s"), F.col("_c.e")
    return rows.select(key, "chunk", s.alias("start"), e.alias("end"),
                       P.has_text_layer("pages", s, e).alias("text_layer"),
                       P.chunk_text("pages", s, e).alias("raw"))


def convert(chunks: DataFrame, engines: dict[str, Column], vision: str | None = None,
            fallback: str = "pypdf") -> DataFrame:
    """Output of the first engine with text per chunk. The vision engine only sees chunks without
    a text layer; when all engines fail the raw text is kept and the chunk is degraded."""
    chain = [(n, F.when(F.col("text_layer"), "").otherwise(c) if n == vision else c) for n, c in engines.items()]
    name, text = P.first_engine(chain)
    return chunks.withColumns({
        "engine": F.coalesce(name, F.lit(fallback)), "text": F.coalesce(text, F.col("raw")),
        "degraded": name.isNull(), "ok": name.isNotNull() | ~is_blank("raw")})


def engine_counts(converted: DataFrame) -> DataFrame:
    return converted.groupBy("engine").agg(F.count(F.lit(1)).alias("chunks"))


def degraded_pages(converted: DataFrame, key: str) -> DataFrame:
    """1-based numbers of the pages in degraded chunks."""
    return converted.where("degraded").select(
        key, F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("page"))


def assemble(converted: DataFrame, key: str) -> DataFrame:
    """Markdown of each document: its chunks in order, each with an anchor comment.

    A group is one document's chunks and the result is one value, so nothing unbounded is collected.
    """
    part = F.concat(F.lit("<!-- p."), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"),
                    F.lit(" · engine:"), F.col("engine"), F.lit(" -->\n\n"), strip("text"))
    return merge_parts(converted.withColumn("_p", part), key, "chunk", "_p", "\n\n").select(
        key, F.concat(strip("merged"), F.lit("\n")).alias("markdown"))


def merge_parts(parts: DataFrame, key: str, pos: str, text: str, sep: str) -> DataFrame:
    """Parts of a document joined in position order, whatever order they arrive in."""
    ordered = F.sort_array(F.collect_list(F.struct(pos, text)))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[text]), sep).alias("merged"))


