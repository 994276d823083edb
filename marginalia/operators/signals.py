"""Signal pool: tolerant parsing, enum coercion, freshness, de-duplication, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import col, each_present, first_nonempty, let, one_of, or_else, strip
from ..functions.text import norm_title, safe_name, strip_fence
from .ordered import keep_first, top_per_group, with_number_bucket, with_order_bucket

# Themes and enums of the signal schema, with the limits of a run.
THEMES = ["AI Infrastructure", "Foundation Model", "AI Agent", "Robotics", "AI4S",
          "半导体", "光通信", "量子计算", "核聚变", "新能源", "其他"]
SOURCE_TYPES = ["产业信息", "资本信息", "投资人观点"]
EVENT_TYPES = ["Technology", "Market", "Capital", "Competitive", "Policy"]
IMPORTANCES = ["高", "中", "低"]
TEXT_FIELDS = ["title", "source", "summary", "why", "sub_track", "companies", "targets"]
MAX_PER_THEME, MAX_PER_QUERY = 10, 4
MAX_AGE_DAYS, RECENT_DAYS = 10, 7
KEY_POINTS = 6
ARTICLES_PER_CALL, ARTICLE_CHARS = 8, 4000
ARTICLE_RANGE = 4096  # sequence numbers
DOC_LIST = 2000  # documents a request can list
NO_DOCS = "（空，暂无技术文档）"
ISO_DATE = r"\A\d{4}-\d{2}-\d{2}"


# ---- parsing ----------------------------------------------------------------------------------

def _between(text: Column, open_: str, close: str) -> Column:
    """From the first opening to the last closing sign; null unless they are in that order."""
    def cut(t: Column) -> Column:
        first = F.locate(open_, t)
        last = F.length(t) - F.locate(close, F.reverse(t)) + 1
        return F.when((first > 0) & F.contains(t, F.lit(close)) & (last > first),
                      F.substr(t, first, last - first + 1))
    return let(strip_fence(text), cut)


def json_array(text: str | Column) -> Column:
    """The JSON array inside a reply, as array of variants; null when there is none."""
    return F.try_variant_get(F.try_parse_json(_between(col(text), "[", "]")), "$", "array<variant>")


def json_object(text: str | Column) -> Column:
    """The JSON object inside a reply, as a variant; null when it is not an object."""
    v = F.try_parse_json(_between(col(text), "{", "}"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def text_field(v: Column, name: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def text_list(v: Column, name: str, limit: int | None = None) -> Column:
    """String list of a JSON field: trimmed, empties dropped, cut to ``limit``."""
    raw = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    items = F.filter(F.transform(raw, strip), lambda s: s != "")
    return items if limit is None else F.slice(items, 1, limit)


# All fields an item may carry, read from the variant in one go; other fields are ignored.
ITEM = "struct<" + ",".join(f"{f}:string" for f in (
    *TEXT_FIELDS, "date", "source_type", "event_type", "theme", "importance", "importance_reason")) + ">"


def _items(replies: DataFrame, text: str, limit: int) -> DataFrame:
    """Reply rows exploded to items with the fields both parsers share. The limit counts all array
    elements: items without a title, or that are not objects, are dropped after it."""
    items = F.transform(F.slice(json_array(text), 1, limit), lambda v: F.try_variant_get(v, "$", ITEM))
    # The expression itself is exploded: over a named column the optimizer would infer filters on
    # it, push them below the projection and evaluate the expression three times.
    rows = replies.select(*[c for c in replies.columns if c != text], F.posexplode(items).alias("pos", "_it"))

    def clean(name: str) -> Column:
        return strip(F.coalesce(F.col(f"_it.{name}"), F.lit("")))
    return rows.where(clean("title") != "").withColumns({
        "date": F.left(F.coalesce("_it.date", F.lit("")), F.lit(10)),
        "source_type": one_of(F.col("_it.source_type"), SOURCE_TYPES, "产业信息"),
        "event_type": one_of(F.col("_it.event_type"), EVENT_TYPES, "Market"),
        **{f: clean(f) for f in TEXT_FIELDS}})


def parse_items(replies: DataFrame, text: str, theme: str | Column, limit: int = MAX_PER_THEME) -> DataFrame:
    """One row per usable item of a reply; the theme is the one that was asked about."""
    asked = F.lit(theme) if isinstance(theme, str) else theme
    return _items(replies, text, limit).withColumn("theme", asked).drop("_it")


def parse_article_items(replies: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Items of an article analysis: the theme is checked too, and importance is added."""
    return _items(replies, text, limit).withColumns({
        "theme": one_of(F.col("_it.theme"), THEMES, "其他"),
        "importance": one_of(F.col("_it.importance"), IMPORTANCES, "中"),
        "importance_reason": strip(F.coalesce("_it.importance_reason", F.lit(""))),
        "origin": F.lit("wechat"), "auto": F.lit(False)}).drop("_it")


def conform_extraction(replies: DataFrame, text: str) -> DataFrame:
    """Extraction reply to columns: trimmed fields and lists, and the source line."""
    v = F.col("_v")
    rows = replies.select(*[c for c in replies.columns if c != text], each_present(json_object(text)).alias("_v"))
    return rows.withColumns({
        **{f: text_field(v, f) for f in ("target", "new_title", "industry", "one_liner", "principle")},
        "key_points": text_list(v, "key_points", KEY_POINTS),
        **{f: text_list(v, f) for f in ("metrics", "related", "events")},
    }).drop("_v")


def source_line(date: Column, account: Column, title: Column, today: str) -> Column:
    return F.concat(first_nonempty(F.left(date, F.lit(10)), F.lit(today)), F.lit(" "),
                    first_nonempty(strip(account), F.lit("公众号")), F.lit("《"),
                    first_nonempty(strip(title), F.lit("未命名文章")), F.lit("》"))


def route_target(target: Column, new_title: Column, one_liner: Column) -> Column:
    """File name of the document an extraction goes to: the routed one, or a new safe name."""
    keep = (target != "") & (target != "NEW") & target.endswith(".md")
    return F.when(keep, target).otherwise(
        F.concat(safe_name(first_nonempty(new_title, one_liner)), F.lit(".md")))


def article_payload(articles: DataFrame, seq: str) -> DataFrame:
    """Request rows of at most eight articles, whatever gaps or repeats the sequence has. Articles are
    numbered inside ranges of ``ARTICLE_RANGE`` sequence numbers, so no global numbering is needed and
    at most one request per range is not full; each text is cut to what the service accepts."""
    start = F.floor(F.col(seq) / ARTICLE_RANGE) * ARTICLE_RANGE
    item = F.to_json(F.struct(
        strip("title").alias("title"), strip("account").alias("account"),
        F.left("date", F.lit(10)).alias("date"), F.left("text", F.lit(ARTICLE_CHARS)).alias("text")))
    at = F.row_number().over(W.partitionBy("start").orderBy(seq, "_item"))
    return (articles.select(start.alias("start"), seq, item.alias("_item"))
            .withColumn("batch", F.floor((at - 1) / ARTICLES_PER_CALL))
            .groupBy("start", "batch").agg(
                F.count(F.lit(1)).alias("n_articles"),
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, "_item"))),
                                         lambda x: x["_item"]), ",").alias("_items"))
            .select("start", "batch", "n_articles", F.concat(F.lit("["), "_items", F.lit("]")).alias("payload")))


def _request_text(articles: DataFrame) -> Column:
    """An article as the service gets it, each field cut to what it accepts."""
    return F.to_json(F.struct(
        strip("title").alias("title"), strip("account").alias("account"),
        F.left("date", F.lit(10)).alias("date"), F.left("text", F.lit(ARTICLE_CHARS)).alias("text")))


def article_requests(articles: DataFrame, seq: str) -> DataFrame:
    """(batch, n_articles, payload): requests of eight articles in order of the sequence number, of
    which only the last may hold fewer, whatever gaps the numbers have. Articles without a number are
    left out.

    Articles are counted per range of ``ARTICLE_RANGE`` numbers and the counts are summed up in two levels (of
    a million ranges, and one sum for each of those); an article's place is that of its range plus its
    place in it.
    """
    rows = articles.where(F.col(seq).isNotNull()).select(F.floor(F.col(seq) / ARTICLE_RANGE).alias("_range"), F.col(seq).alias("_seq"), _request_text(articles).alias("_item"))
    counts = with_number_bucket(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), "_range")
    sums = counts.groupBy("_bucket").agg(F.sum("_n").alias("n")).agg(F.collect_list(F.struct("_bucket", "n"))).scalar()
    earlier = F.aggregate(F.filter("_sums", lambda x: x["_bucket"] < F.col("_bucket")), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    inside = F.sum("_n").over(W.partitionBy("_bucket").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    before = counts.withColumn("_sums", sums).select("_range", (earlier + F.coalesce(inside, F.lit(0))).alias("_before"))
    at = F.row_number().over(W.partitionBy("_range").orderBy("_seq", "_item"))
    placed = rows.withColumn("_at", at).join(before, "_range").withColumn("_at", F.col("_before") + F.col("_at") - 1)
    return placed.groupBy(F.floor(F.col("_at") / ARTICLES_PER_CALL).alias("batch")).agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_item"))),
                                                      lambda x: x["_item"]), ","), F.lit("]")).alias("payload"))


def doc_lines(docs: DataFrame) -> DataFrame:
    """(name, line): the known documents as lines of the list a request carries. ``docs`` holds
    (name, title, tagline, gist) of one folder."""
    title, tagline, gist = (F.coalesce(c, F.lit("")) for c in ("title", "tagline", "gist"))
    return docs.select("name", F.concat(F.lit("- "), "name", F.lit(" | "), title, F.lit(" — "), F.left(tagline, F.lit(60)),
                                        F.lit(" | 内容："), F.left(gist, F.lit(100))).alias("line"))


def doc_list(docs: DataFrame) -> Column:
    """The list a request carries, a line for each document in order of name, as a scalar subquery. More
    than ``DOC_LIST`` documents are an error, as no request could hold them (see ``filing_requests``)."""
    some = doc_lines(docs).limit(DOC_LIST + 1)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("name", "line"))), lambda x: x["line"])
    text = F.when(F.count(F.lit(1)) > DOC_LIST, F.raise_error(F.lit(f"more than {DOC_LIST} documents in the list"))).otherwise(
        or_else(F.array_join(lines, "\n"), NO_DOCS))
    return some.agg(text).scalar()


def list_parts(docs: DataFrame) -> DataFrame:
    """(part, text): the whole list, however long, cut between lines. Joined by line breaks in order of
    ``part``, the texts are the list."""
    cut = with_order_bucket(doc_lines(docs), [], ["name", "line"])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("name", "line"))), lambda x: x["line"])
    return cut.groupBy(F.col("_bucket").alias("part")).agg(F.array_join(lines, "\n").alias("text"))


def list_digest(docs: DataFrame) -> Column:
    """MD5 of the whole list, as a scalar subquery. A digest is sequential by definition: the parts, of which there
    are at most a few thousand, go through one task in order, which keeps the running hash and no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, some = hashlib.md5(), False
        for batch in batches:
            for text in batch.column(0):
                digest.update(b"\n" if some else b"")
                digest.update(text.as_buffer())
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"md5": [digest.hexdigest()]})

    ordered = list_parts(docs).repartition(1).sortWithinPartitions("part").select("text")
    return ordered.mapInArrow(run, "md5 string").agg(F.coalesce(F.first("md5"), F.md5(F.lit(NO_DOCS)))).scalar()


def extraction_requests(articles: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, doc_list, payload): one request per article, with the list of documents it may be filed in."""
    return articles.select(key, doc_list(docs).alias("doc_list"), _request_text(articles).alias("payload"))


def filing_requests(articles: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, list_md5, payload): one request per article for a folder of any size. The list is the same for
    all of them, so they name it by its digest, and ``list_parts`` gives it once."""
    return articles.select(key, list_digest(docs).alias("list_md5"), _request_text(articles).alias("payload"))


# ---- date predicates --------------------------------------------------------------------------

def days_before(as_of: str, days: int) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), days).cast("string")


def is_fresh(as_of: str, days: int = MAX_AGE_DAYS) -> Column:
    """Not older than ``days``; a missing or unreadable date counts as fresh."""
    d = F.coalesce("date", F.lit(""))
    return ~d.rlike(ISO_DATE) | (F.left(d, F.lit(10)) >= days_before(as_of, days))


def fresh(items: DataFrame, as_of: str, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Drop items older than ``days``; a missing or unreadable date is kept."""
    return items.where(is_fresh(as_of, days))


def since(items: DataFrame, as_of: str, days: int, date: str = "date") -> DataFrame:
    """Plain string comparison: ``本周`` passes, the empty string does not."""
    return items.where(F.left(F.coalesce(date, F.lit("")), F.lit(10)) >= days_before(as_of, days))


def recent_of_theme(items: DataFrame, theme: str, as_of: str, days: int = RECENT_DAYS) -> DataFrame:
    return since(items.where(F.col("theme") == theme), as_of, days)


def in_range(date: str | Column, start: str, end: str) -> Column:
    """Parsed date between both ends; an invalid date is outside every range."""
    d = F.left(col(date), F.lit(10))
    parsed = F.when(d.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_date(d, "yyyy-M-d"))
    return F.coalesce(parsed.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))


# ---- watch list -------------------------------------------------------------------------------

def select_watchlist(watchlist: DataFrame, primary_only: bool = False, only: str | None = None) -> DataFrame:
    out = watchlist.where(F.coalesce("enabled", F.lit(True)))
    if primary_only:
        out = out.where(F.coalesce("primary", F.lit(False)))
    return out.where(F.col("theme") == only) if only else out


def expand_queries(watchlist: DataFrame) -> DataFrame:
    """Sub-queries of each theme, or the query plus three default angles; blanks are dropped."""
    angles = F.array(F.col("query"),
                     F.concat("theme", F.lit(" 产业链 订单 供需 产能 格局")),
                     F.concat("theme", F.lit(" 科研进展 学术会议 论文 技术突破")),
                     F.concat("theme", F.lit(" 融资 并购 IPO 投资人观点 市场预期")))
    given = F.when(F.size(F.coalesce("sub_queries", F.array().cast("array<string>"))) > 0, F.col("sub_queries"))
    return watchlist.select("theme", F.posexplode(F.filter(
        F.coalesce(given, angles), lambda q: F.coalesce(q, F.lit("")) != "")).alias("pos", "sub_query"))


def retry_plan(watchlist: DataFrame, found: DataFrame) -> DataFrame:
    """One fallback query for every theme without a fresh result."""
    got = found.select("theme").distinct()
    return watchlist.join(got, "theme", "left_anti").select(
        "theme", F.concat(F.coalesce("query", F.col("theme")), F.lit(" 最新进展 本周")).alias("sub_query"))


def fetch_stats(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Number of items per theme and sub-query, and whether the query failed: one with an ``error``
    text has failed and counts 0, an empty one has neither items nor an error."""
    counts = items.groupBy("theme", "sub_query").agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("error").isNotNull()
    return queries.join(counts, ["theme", "sub_query"], "left").withColumn(
        "n", F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0)))).withColumn("failed", failed)


# ---- de-duplication ---------------------------------------------------------------------------

def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn("key", norm_title(F.coalesce("title", F.lit("")))).where("key <> ''")


def dedup(items: DataFrame, by: list[str] | None = None, order: str = "seq") -> DataFrame:
    """First item per normalised title (within ``by``); items with an empty key are dropped."""
    return keep_first(with_key(items), [*(by or []), "key"], [order])


def new_items(pool: DataFrame, items: DataFrame, order: str = "seq") -> DataFrame:
    """Items whose title is not in the pool. Both sides are reduced to one row per key before the
    join, so no key is hot in it."""
    known = with_key(pool).select("key").distinct()
    return dedup(items, order=order).join(known, "key", "left_anti")


def append_to_pool(pool: DataFrame, items: DataFrame, order: str = "seq", origin: str = "wechat") -> DataFrame:
    """The rows a run adds, with default origin and auto flag."""
    added = new_items(pool, items, order).drop("key")
    for name, default in (("origin", F.lit(origin)), ("auto", F.lit(False))):
        added = added.withColumn(name, F.coalesce(F.col(name), default) if name in added.columns else default)
    return added


def pool_union(pool: DataFrame, added: DataFrame) -> DataFrame:
    return pool.unionByName(added, allowMissingColumns=True)


def merge_angles(items: DataFrame, order: str = "seq", per_query: int = MAX_PER_QUERY,
                 per_theme: int = MAX_PER_THEME) -> DataFrame:
    """Results of all sub-queries of a theme: capped per query, de-duplicated, capped per theme.

    Every step is reduced before its shuffle: ranked windows with a limit, and a combined min_by.
    """
    capped = top_per_group(items, ["theme", "sub_query"], [F.col(order)], per_query, "_r").drop("_r")
    return top_per_group(dedup(capped, ["theme"], order), ["theme"], [F.col(order)], per_theme)


# ---- lists and counts -------------------------------------------------------------------------

def theme_distribution(items: DataFrame, start: str, end: str) -> DataFrame:
    return (items.where(in_range("date", start, end))
            .groupBy(F.coalesce("theme", F.lit("其他")).alias("theme"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
            .orderBy(F.desc("n"), "first_seq"))


def latest(items: DataFrame, n: int, theme: str | None = None) -> DataFrame:
    """Last ``n`` in append order, newest first."""
    rows = items if theme is None else items.where(F.col("theme") == theme)
    return rows.orderBy(F.desc("seq")).limit(n)


def newest_by_date(items: DataFrame, n: int = 50) -> DataFrame:
    return items.orderBy(F.desc("date"), "seq").limit(n)


def nonblank_lines(text: str) -> list[str]:
    return [line.strip() for line in text.split("\n") if line.strip()]


