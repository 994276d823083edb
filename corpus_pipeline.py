"""Corpus pipeline: quality filter, toxicity filter, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the documents they keep with the columns
they came with; the last returns the pieces of the packed sequences. Labels are learned from only for
documents outside the held-out fold and present in the stage's input; a document's own label never
decides about it. An empty input passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import near_duplicates, packing, quality, toxicity
from marginalia.llm.common import held_out, staged, table

KEEP_FROM = 0.5  # least probability of a grade above the lowest


def whole_rows(docs: DataFrame) -> DataFrame:
    """The text, and the whole document as one value, so that its columns may have any names."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of a grade above the lowest; all if there is nothing to learn from."""
    learn = docs.filter(~held_out()).select("doc_id", "text")
    grader = quality.fit(quality.with_rating(learn, table(spark, sf_dir, "labels")))
    if grader is None:
        return docs
    graded = quality.grade(whole_rows(docs), grader, keep=("row",))
    return graded.filter(F.col("tails")[0] >= KEEP_FROM).select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    lexicon = toxicity.fit(docs.filter(~held_out()).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(whole_rows(docs), lexicon, keep=("row",))
    return scored.filter(F.col("predicted") == 0).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest id. Rows without an id stay."""
    found = near_duplicates.near_duplicates(docs)
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, along the curve of similar wording."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("packing", pack)]
ORACLE_SQL = None  # learned weights and hashed signatures have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
