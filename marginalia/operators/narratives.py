"""Theme narratives: change history, current state, reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import strip
from .ordered import NUMBER_RANGE, keep_last, neighbours, top_per_group
from .signals import in_range, since, theme_distribution

FIRST = "（首次建立）"


def _told(feed: DataFrame) -> DataFrame:
    """Updates with a narrative; a blank one is no update at all."""
    return feed.withColumn("narrative", strip("narrative")).where("narrative <> ''")


def history(feed: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row per change of a theme's narrative.

    ``feed`` holds (theme, seq, date, narrative, trigger) with ``seq`` the append number of an update,
    unique per theme. The first narrative of a theme is a transition; ``current`` gives the narratives
    known before the feed.
    """
    rows = _with_previous(feed)
    if current is not None:
        known = current.select("theme", F.col("narrative").alias("_known"))
        rows = rows.join(known, "theme", "left").withColumn("prev", F.coalesce("prev", "_known"))
    return _changes(rows)


def _with_previous(feed: DataFrame) -> DataFrame:
    feed = _told(feed)
    if "is_transition" not in feed.columns:
        feed = feed.withColumn("is_transition", F.lit(False))
    return neighbours(feed, ["theme"], ["seq"], "narrative", prev="prev", rows=NUMBER_RANGE)


def _is_change() -> Column:
    return F.col("prev").isNull() | (F.col("prev") != F.col("narrative"))


def _changes(rows: DataFrame) -> DataFrame:
    first = F.col("prev").isNull()
    return rows.where(_is_change()).select(
        "theme", "seq", "date", F.coalesce("prev", F.lit(FIRST)).alias("previous"),
        F.col("narrative").alias("new_narrative"),
        F.when(first, "").otherwise(strip("trigger")).alias("trigger"),
        (first | F.col("is_transition")).alias("is_transition"))


def current(feed: DataFrame) -> DataFrame:
    """Latest narrative per theme with its fields; ``updated`` is the date of that update."""
    return keep_last(_told(feed), ["theme"], ["seq"]).withColumnRenamed("date", "updated")


def updated_themes(hist: DataFrame, cur: DataFrame, start: str, end: str) -> DataFrame:
    """Themes with a history row in the range, or updated in it."""
    return (hist.where(in_range("date", start, end)).select("theme")
            .unionByName(cur.where(in_range("updated", start, end)).select("theme")).distinct())


def recent_changes(hist: DataFrame, as_of: str, days: int = 30, n: int = 4) -> DataFrame:
    return since(hist, as_of, days).orderBy(F.desc("date"), "theme", "seq").limit(n)


def history_tail(hist: DataFrame, n: int = 8) -> DataFrame:
    """Last ``n`` history rows of each theme in append order, newest first."""
    return top_per_group(hist, ["theme"], [F.desc("seq")], n)


def week_kpis(signals: DataFrame, hist: DataFrame, cur: DataFrame, variables: DataFrame, as_of: str,
              days: int = 7) -> DataFrame:
    """Signals, changed themes and variables of the last days as one row of scalar counts."""
    themes = (since(hist, as_of, days).select("theme")
              .unionByName(since(cur, as_of, days, "updated").select("theme")).distinct())
    def count(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()
    return signals.sparkSession.range(1).select(
        count(since(signals, as_of, days)).alias("n_signals"), count(themes).alias("n_themes"),
        count(since(variables, as_of, days)).alias("n_variables"))


def weekly_report(signals: DataFrame, feed: DataFrame, variables: DataFrame, start: str, end: str,
                  questions: list[str]) -> DataFrame:
    """The five data sets of the weekly report in long form (section, theme, field, value, n)."""
    told = _with_previous(feed)
    changed = F.coalesce(F.max(_is_change() & in_range("date", start, end)), F.lit(False))
    # The same columns as the changes below need, so that both read one exchange of the feed.
    cur = told.groupBy("theme").agg(F.max_by(F.struct("narrative", "trigger", "date", "is_transition"), "seq").alias("_row"),
                                    changed.alias("_changed"))
    touched = cur.where(F.col("_changed") | in_range(F.col("_row.date"), start, end)).select("theme", "_row.*")

    def rows(df: DataFrame, section: str, theme, fields: dict, n=None) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("—")).alias("value"))
                                    for k, v in fields.items()])).alias("_f")
        count = F.lit(None).cast("long") if n is None else n
        return df.select(F.lit(section).alias("section"), theme.alias("theme"), count.alias("n"), pairs).select(
            "section", "theme", "_f.field", "_f.value", "n")

    spread = theme_distribution(signals, start, end)
    parts = rows(spread, "distribution", F.col("theme"), {"signals": F.col("theme")}, F.col("n"))
    parts = parts.unionByName(rows(touched, "review", F.col("theme"), {
        "narrative": F.col("narrative"), "evidence": F.col("trigger")}))
    moved = _changes(told).where(in_range("date", start, end) & F.col("is_transition"))
    parts = parts.unionByName(rows(moved, "evolution", F.col("theme"), {
        "previous": F.col("previous"), "new": F.col("new_narrative"), "date": F.col("date")}))
    parts = parts.unionByName(rows(variables.where(in_range("date", start, end)), "variables", F.col("theme"), {
        "title": F.col("title"), "var_type": F.col("var_type")}))
    asked = F.explode(F.array(*[F.lit(q) for q in questions]).cast("array<string>")).alias("value")
    return parts.unionByName(signals.sparkSession.range(1).select(
        F.lit("questions").alias("section"), F.lit(None).cast("string").alias("theme"),
        F.lit("question").alias("field"), asked, F.lit(None).cast("long").alias("n")))
