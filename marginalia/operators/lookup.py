"""Keyword lookups: which of a set of strings is contained in a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import candidates, staged


def first_keyword(text: Column, keywords: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first keyword contained in ``text``; CASE order is keyword order. For configured
    maps; a keyword table goes through ``track_by_table``."""
    out = None
    for keyword, name in keywords:
        hit = F.contains(text, F.lit(keyword))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def contained_in(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs (text row, needle row) where the needle occurs in the text; an empty needle has none.

    A text meets the needles whose anchor it holds (see ``anchors``), and the pair is then verified;
    both sides may be large. The text travels with every pair, so it is meant for titles and labels.
    """
    some = needles.where(F.col(needle) != "")
    pairs = candidates(texts, text, texts.columns, some.select(needle).distinct(), needle)
    return pairs.where(F.contains(text, needle)).join(some, needle)


def track_by_table(docs: DataFrame, keywords: DataFrame, key: str = "path",
                   default: str = "未分类") -> DataFrame:
    """Track of a document from a keyword table (keyword, track, prio) of any size."""
    texts = docs.select(key, F.concat_ws(" ", "name", "title").alias("_text"))
    words = keywords.groupBy("keyword").agg(F.min("prio").alias("prio"), F.min_by("track", "prio").alias("track"))
    hits = contained_in(texts, "_text", words, "keyword").groupBy(key).agg(
        F.min_by("track", "prio").alias("track"))
    return docs.join(hits, key, "left").withColumn("track", F.coalesce("track", F.lit(default)))


def merge_keywords(base: DataFrame, local: DataFrame) -> DataFrame:
    """Local keywords override the built-in ones in place and follow them otherwise."""
    b = base.select("keyword", F.col("track").alias("_bt"), F.col("prio").alias("_bp"))
    n = local.select("keyword", F.col("track").alias("_lt"), F.col("prio").alias("_lp"))
    return b.join(n, "keyword", "full_outer").select(
        "keyword", F.coalesce("_lt", "_bt").alias("track"),
        F.when(F.col("_bp").isNull(), 1).otherwise(0).alias("block"),
        F.coalesce("_bp", "_lp").alias("prio"))


def default_industry(projects: DataFrame, industries: DataFrame) -> DataFrame:
    """Preselected industry document of every project.

    First industry whose title and name contain the project's track; else the first whose
    bracket-free title is contained in the track; else the first of all. Matching is done once per
    distinct track, then joined back. Industries carry their list position ``pos``.
    """
    wanted = F.lower(F.btrim("track"))
    tracks = staged(projects.select(wanted.alias("_t")).where("_t <> ''").distinct(), "tracks")
    shown = F.coalesce(F.nullif("title", F.lit("")), F.col("name"))
    ind = staged(industries.select(
        "pos", F.col("path").alias("industry"),
        F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("name"))).alias("_hay"),
        F.lower(F.btrim(F.regexp_replace(shown, r"（.*?）|\(.*?\)|\.md", ""))).alias("_core")), "industries")
    cores = ind.groupBy("_core").agg(F.min("pos").alias("pos"), F.min_by("industry", "pos").alias("industry"))
    none = F.lit(None)
    # Both ways at once: tracks in industries, and industries in tracks.
    texts = ind.select(F.lit(0).alias("_way"), "_hay", F.col("pos").alias("_pos"), F.col("industry").alias("_industry")).union(
        tracks.select(F.lit(1), "_t", none, none))
    needles = tracks.select(F.col("_t").alias("_needle"), F.lit(0).alias("_phase"), none.cast(ind.schema["pos"].dataType).alias("pos"), none.cast("string").alias("industry")).union(
        cores.select("_core", F.lit(1), "pos", "industry"))
    hits = contained_in(texts, "_hay", needles, "_needle").where("_way = _phase")
    best = hits.groupBy(F.when(F.col("_phase") == 0, F.col("_needle")).otherwise(F.col("_hay")).alias("_t")).agg(
        F.min_by(F.coalesce("_industry", "industry"), F.struct("_phase", F.coalesce("_pos", "pos"))).alias("industry"))
    fallback = ind.agg(F.min_by("industry", "pos")).scalar()
    return (projects.withColumn("_t", wanted).join(best, "_t", "left")
            .withColumn("industry", F.coalesce("industry", fallback)).drop("_t"))
