"""Corpus queries: filters, search, related documents, categories, browsing.

Document order is (category_key, name); root files have the empty key and therefore come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import metadata as M
from ..functions.expr import let, or_else, quoted
from ..functions.text import words
from .anchors import candidates
from .ordered import neighbours, top_per_group

# Category folders with name, icon and description; unknown ones show as 其他.
OTHER = "其他"
NO_TRACK = "未分类"
CATEGORIES = [
    ("01_industry", "行业认知", "🏭", "二级框架：赛道全景、产业链、投资逻辑"),
    ("02_deals", "项目解剖", "🔬", "一级框架：公司深度、投资假设、风险分析"),
    ("03_frameworks", "方法论", "🛠️", "可复用工具：评估框架、分析模板"),
    ("04_comparables", "横向比较", "📊", "项目矩阵、竞品对照"),
    ("05_tracking", "动态追踪", "📈", "追踪表、里程碑监控"),
    ("06_strategy", "投资策略", "🎯", "产业链图谱、主题策略"),
    ("07_learnings", "经验沉淀", "💡", "方法论总结、案例复盘"),
    ("08_funds", "被投基金", "💼", "机构投资认知：GP 方法论、投资逻辑拆解、回报归因"),
    ("09_tech", "技术沉淀", "🧪", "各行业技术档案：技术图谱/原理详解/路线对比，公众号技术提取直接落入"),
]
# Research framework of a category, as a path below the corpus root.
FRAMEWORKS = {
    "01_industry": "03_frameworks/行业总文档模板.md",
    "02_deals": "03_frameworks/项目解剖模板.md",
    "08_funds": "03_frameworks/机构投资心智模型提取方法论.md",
    "09_tech": "03_frameworks/技术提取框架.md",
}
FRAMEWORK_CHARS = 4000
# Search weights, and how many results a page shows.
WEIGHTS = {"title": 10, "tags": 8, "project": 6, "name": 5, "category": 4, "content": 3}
SEARCH_SHOWN = 40
RELATED_SHOWN = 5
WORD_CHARS = 4
ORDER = ("category_key", "name")


# ---- joins with dimensions --------------------------------------------------------------------

def with_category(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """Category name, icon and description. ``categories`` is a constant relation, hence broadcast."""
    dim = categories.select("category_key", F.col("category_name").alias("category"),
                            F.col("icon").alias("category_icon"), F.col("description").alias("category_desc"))
    return docs.join(F.broadcast(dim), "category_key", "left").withColumns({
        "category": F.coalesce("category", F.lit(OTHER)),
        "category_icon": F.coalesce("category_icon", F.lit("📁")),
        "category_desc": F.coalesce("category_desc", F.lit(""))})


def with_framework(docs: DataFrame, frameworks: dict[str, str], limit: int = FRAMEWORK_CHARS) -> DataFrame:
    """The first characters of the framework document of each document's category.

    At most one row per configured category, each cut to ``limit`` characters, is broadcast.
    """
    path_of = F.create_map(*[F.lit(x) for kv in frameworks.items() for x in kv])
    texts = docs.where(F.col("path").isin(*frameworks.values())).select(
        F.col("path").alias("_fw"), F.left("content", F.lit(limit)).alias("framework")).groupBy("_fw").agg(
        F.min("framework").alias("framework"))
    return (docs.withColumn("_fw", F.try_element_at(path_of, F.col("category_key")))
            .join(F.broadcast(texts), "_fw", "left")
            .withColumn("framework", F.coalesce("framework", F.lit(""))).drop("_fw"))


def existing_links(links: DataFrame, docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Fixed links whose target exists; the link paths are pushed into the document scan."""
    return links.join(docs.where(F.col("path").isin(*paths)).select("path"), "path", "left_semi")


# ---- filters ----------------------------------------------------------------------------------

def by_category(docs: DataFrame, key: str) -> DataFrame:
    return docs.where(F.col("category_key") == key)


def by_tag(docs: DataFrame, tag: str) -> DataFrame:
    return docs.where(F.array_contains("tags", tag))


def by_path(docs: DataFrame, path: str) -> DataFrame:
    return docs.where(F.col("path") == path).limit(1)


def by_keyword(docs: DataFrame, keyword: str, label: Column) -> DataFrame:
    """Case-insensitive substring of label, file name or subtitle; a blank keyword keeps all."""
    k = keyword.strip().lower()
    if not k:
        return docs
    hit = F.lit(False)
    for c in (label, F.col("name"), F.coalesce("subtitle", F.lit(""))):
        hit = hit | F.contains(F.lower(c), F.lit(k))
    return docs.where(hit)


def filter_deals(docs: DataFrame, key: str, track: str | None = None, status: str | None = None,
                 by_name: bool = False) -> DataFrame:
    """Deals by track and status, with the counts ``shown`` and ``total`` of the page head.

    Both counts come from one scalar subquery, not from a global window.
    """
    category = by_category(docs, key)
    wanted = F.lit(True)
    for name, value in (("track", track), ("status", status)):
        wanted = wanted if value is None else wanted & (F.col(name) == value)
    counts = category.agg(F.struct(F.count_if(wanted).alias("shown"), F.count(F.lit(1)).alias("total"))).scalar()
    hits = category.where(wanted)
    order = ([M.display_title("title", "name"), "name"] if by_name else [F.desc("modified"), "name"])
    return hits.withColumn("_n", counts).select(*docs.columns, "_n.shown", "_n.total").orderBy(*order)


def newest(docs: DataFrame, n: int | None = 10) -> DataFrame:
    out = docs.orderBy(F.desc("modified"), *ORDER)
    return out if n is None else out.limit(n)


def reports(docs: DataFrame, key: str, word: str = "周报", n: int = 10) -> DataFrame:
    return newest(by_category(docs, key).where(F.contains("name", F.lit(word))), n)


def with_section(docs: DataFrame, heading: str) -> DataFrame:
    """Documents that have the section ``## heading``, newest first."""
    return newest(docs.where(F.col("content").rlike(rf"(?dm)^## {quoted(heading)}\n")), None)


def nonempty_text(docs: DataFrame) -> DataFrame:
    from ..functions.text import visible_text
    from ..functions.expr import is_blank
    return docs.where(~is_blank(visible_text("content")))


# ---- search -----------------------------------------------------------------------------------

def _contains(c: Column, q: Column) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), q)


def match_score(q: Column, fields: dict[str, Column]) -> Column:
    """Sum of the weights of the fields that contain ``q`` (already lower case)."""
    score = F.lit(0)
    for name, c in fields.items():
        hit = F.exists(c, lambda t: _contains(t, q)) if name == "tags" else _contains(c, q)
        score = score + F.when(hit, WEIGHTS[name]).otherwise(0)
    return score


def _fields(docs: DataFrame) -> dict[str, Column]:
    return {f: F.col(f) for f in WEIGHTS if f in docs.columns}


def search(docs: DataFrame, text: str, limit: int | None = SEARCH_SHOWN) -> DataFrame:
    """Weighted substring search; ties keep document order. A blank text returns all documents."""
    if not text:
        return docs.withColumn("score", F.lit(0)).orderBy(*ORDER)
    scored = docs.withColumn("score", match_score(F.lit(text.lower()), _fields(docs)))
    ranked = scored.orderBy(F.desc("score"), *ORDER)
    # Zero scores go after the cut: a filter below it would be pushed into the scan and make every
    # document be scored twice.
    return (ranked if limit is None else ranked.limit(limit)).where("score > 0")


def search_many(docs: DataFrame, texts: Sequence[str] | DataFrame, limit: int = SEARCH_SHOWN) -> DataFrame:
    """Search for several texts at once; the ranked window keeps at most ``limit`` rows per text before
    the shuffle. ``texts`` is a list, which is scored in place while the corpus is read once, or a table
    of any size whose first column holds the queries. Blank, missing and repeated texts count once or
    not."""
    if isinstance(texts, DataFrame):
        return _search_table(docs, texts, limit)
    columns = [c for c in docs.columns if c != "content"]
    docs = docs.withColumn("_asked", F.array(*[F.lit(t.lower()) for t in texts]))
    f = _fields(docs)
    lowered = F.struct(*[(F.transform(c, F.lower) if n == "tags" else F.lower(F.coalesce(c, F.lit("")))).alias(n)
                         for n, c in f.items()])

    def score(v: Column, q: Column) -> Column:
        total = F.lit(0)
        for n in f:
            hit = F.exists(v[n], lambda t: F.contains(t, q)) if n == "tags" else F.contains(v[n], q)
            total = total + F.when(hit, WEIGHTS[n]).otherwise(0)
        return total

    hits = let(lowered, lambda v: F.filter(
        F.transform("_asked", lambda q: F.struct(q.alias("q"), score(v, q).alias("score"))),
        lambda h: h["score"] > 0))
    flat = docs.select(*columns, F.inline(hits))
    return top_per_group(flat, ["q"], [F.desc("score"), F.col("category_key"), F.col("name")], limit)


def _search_table(docs: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Queries and fields meet on the query's rarest gram (see ``anchors``): a document emits, for each
    field, the anchors it holds, and only those pairs are verified against the field's text. Rows are
    known by a hash of all their columns; equal rows are ranked each."""
    asked = texts.select(F.lower(F.col(texts.columns[0])).alias("q")).where("q <> ''").distinct()
    known = docs.withColumn("_id", F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)))

    def weighted(name: str, c: Column) -> Column:  # the weights tell the fields apart
        own = F.coalesce(c, F.array().cast("array<string>")) if name == "tags" else F.array(c)
        return F.transform(own, lambda t: F.struct(F.lit(WEIGHTS[name]).alias("_w"), F.lower(F.coalesce(t, F.lit(""))).alias("_v")))

    values = [weighted(n, c) for n, c in _fields(docs).items()]
    fields = known.select("_id", *ORDER, F.inline(F.concat(*values))).where("_v <> ''")
    maybe = candidates(fields, "_v", ["_id", "_w"], asked, "q").distinct()
    hit = fields.join(maybe, ["_id", "_w"]).where(F.contains("_v", "q")).groupBy("q", "_id", *ORDER, "_w").agg(F.lit(1))
    scored = hit.groupBy("q", "_id", *ORDER).agg(F.sum("_w").cast("int").alias("score"))
    by = [F.desc("score"), *[F.col(c) for c in ORDER]]
    best = top_per_group(scored, ["q"], by, limit).select("q", "_id", "score")
    columns = [c for c in docs.columns if c != "content"]
    found = known.select("_id", *columns).join(best, "_id").select("q", *columns, "score")
    return top_per_group(found, ["q"], by, limit)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def explain_hits(results: DataFrame, text: str, width: int = 140) -> DataFrame:
    """Which fields matched, and a highlighted snippet around the first hit in the content."""
    q = F.lit(text.lower())
    named = [("标题", M.display_title("title", "name")), ("项目", F.col("project")),
             ("分类", F.col("category")), ("正文", F.col("content"))]
    where = F.filter(F.array(*[F.when(_contains(c, q), F.lit(n)) for n, c in named]), lambda x: x.isNotNull())
    at = F.locate(text.lower(), F.lower("content"))
    half = width // 2
    start = F.greatest(at - 1 - half, F.lit(0))
    piece = F.replace(F.substr("content", start + 1, at - 1 + len(text) + half - start), F.lit("\n"), F.lit(" "))
    escaped_q = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped_q = escaped_q.replace(raw, safe)
    marked = F.regexp_replace(escape_html(piece), "(?iu)" + quoted(escaped_q), "<mark>$0</mark>")
    snippet = F.when(at > 0, F.concat(F.when(start > 0, "…").otherwise(""), marked, F.lit("…"))).otherwise("")
    return results.withColumns({"matched": F.array_join(where, ","), "snippet": snippet})


# ---- related documents ------------------------------------------------------------------------

def long_words(content: str | Column) -> Column:
    return F.filter(words(content), lambda w: F.length(w) > WORD_CHARS)


def related(docs: DataFrame, path: str, limit: int = RELATED_SHOWN) -> DataFrame:
    """Documents most related to one document: same category 2, each common tag 3, same project 5,
    each common word of more than four characters 0.1.

    The seed is one row, taken as a scalar subquery; every other document is scored in place, so
    the corpus is scanned once and nothing but the final top rows is exchanged. Scores are counted
    in integer tenths.
    """
    seed = docs.where(F.col("path") == path).limit(1).select(F.struct(
        "category", "tags", "project", F.array_distinct(long_words("content")).alias("words"))).scalar()
    tenths = (
        F.when(F.col("category") == seed["category"], 20).otherwise(0)
        + 30 * F.size(F.array_intersect("tags", seed["tags"]))
        + F.when((F.col("project") != "") & (F.col("project") == seed["project"]), 50).otherwise(0)
        + F.size(F.array_intersect(long_words("content"), seed["words"])))
    return (docs.where(F.col("path") != path).withColumn("tenths", tenths)
            .orderBy(F.desc("tenths"), *ORDER).limit(limit).where("tenths > 0")
            .withColumn("score", F.col("tenths") / 10).drop("tenths"))


def overlap(docs: DataFrame, path: str) -> DataFrame:
    """Common tags and common words of every document with one document."""
    seed = docs.where(F.col("path") == path).limit(1).select(F.struct(
        "tags", F.array_distinct(words("content")).alias("words"))).scalar()
    return docs.where(F.col("path") != path).withColumns({
        "common_tags": F.size(F.array_intersect("tags", seed["tags"])),
        "common_words": F.size(F.array_intersect(words("content"), seed["words"]))})


# ---- aggregates and browsing ------------------------------------------------------------------

def category_counts(docs: DataFrame) -> DataFrame:
    """Documents per category and in total; root files count only in the total."""
    return (docs.groupBy("category_key").agg(F.count(F.lit(1)).alias("n"))
            .rollup("category_key").agg(F.sum("n").alias("n"), F.grouping("category_key").alias("g"))
            .where("g = 1 OR category_key <> ''")
            .select(F.when(F.col("g") == 1, "(total)").otherwise(F.col("category_key")).alias("category_key"), "n"))


def all_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def distinct_tracks(docs: DataFrame) -> DataFrame:
    return docs.select(or_else(F.coalesce("track", F.lit("")), NO_TRACK).alias("track")).distinct().orderBy("track")


def track_overview(deals: DataFrame) -> DataFrame:
    """Deals grouped by track, newest first, with the size of the group. A global sort on
    (track, modified) splits a large track over many tasks; the counts are joined back."""
    counts = deals.groupBy("track").agg(F.count(F.lit(1)).alias("track_size"))
    return deals.join(counts, "track").orderBy("track", F.desc("modified"), *ORDER)


def category_preview(docs: DataFrame, n: int = 5) -> DataFrame:
    """The first documents of each category, its size, and whether there are more."""
    named = docs.where("category_key <> ''")
    counts = named.groupBy("category_key").agg(F.count(F.lit(1)).alias("total"))
    return (top_per_group(named, ["category_key"], [F.col("name")], n)
            .join(counts, "category_key").withColumn("more", F.col("total") > n))


def prev_next(docs: DataFrame) -> DataFrame:
    """Previous and next document within the category, by name."""
    named = docs.where("category_key <> ''").select("category_key", "name", "path")
    return neighbours(named, ["category_key"], ["name"], "path", prev="prev_path", next_="next_path")


def battle_order(docs: DataFrame, deals_key: str = "02_deals") -> DataFrame:
    return docs.withColumn("is_deal", F.col("category_key") == deals_key).orderBy(
        F.desc("is_deal"), "category", "name")


# ---- view history -----------------------------------------------------------------------------

def view_history(views: DataFrame, limit: int = 50) -> DataFrame:
    """One entry per path with its latest view, newest first, at most ``limit``."""
    return (views.groupBy("path").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
            .orderBy(F.desc("ts"), F.desc("seq")).limit(limit))


def recent_views(views: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """The latest viewed documents that still exist; the history holds at most 50 rows."""
    history = view_history(views)
    return (docs.join(F.broadcast(history), "path").orderBy(F.desc("ts"), F.desc("seq")).limit(n))


# ---- export -----------------------------------------------------------------------------------

def search_export(docs: DataFrame) -> DataFrame:
    return docs.select(
        "name", M.display_title("title", "name").alias("title"),
        F.concat(F.lit("docs/"), M.page_slug("path")).alias("url"), "category", "category_icon",
        "project", "status", "last_updated", "subtitle", "content")


# Quick links of the sidebar.
QUICK_LINKS = [
    ("AI4S项目矩阵", "04_comparables/AI4S项目矩阵.md"),
    ("项目解剖模板", "03_frameworks/项目解剖模板.md"),
    ("科学家创业评估", "03_frameworks/科学家创业评估.md"),
    ("产业链投资图谱", "06_strategy/产业链投资图谱.md"),
]
# Pages every export has.
FIXED_PAGES = ["index.html", "search.html", "compare.html", "battle.html", "radar.html"]


def page_manifest(spark, docs: DataFrame, categories: Sequence[str]) -> DataFrame:
    from ..sources.tables import values
    fixed = values(spark, [("fixed", "", p) for p in FIXED_PAGES], "kind STRING, source STRING, url STRING")
    cats = docs.where(F.col("category_key").isin(*categories)).select("category_key").distinct().select(
        F.lit("category").alias("kind"), F.col("category_key").alias("source"),
        F.concat(F.lit("category/"), F.col("category_key"), F.lit(".html")).alias("url"))
    pages = docs.select(F.lit("doc").alias("kind"), F.col("path").alias("source"),
                        F.concat(F.lit("docs/"), M.page_slug("path")).alias("url"))
    return fixed.unionByName(cats).unionByName(pages)


def provenance(content: Column, title: Column, source: Column, day: str) -> Column:
    """Source line below a leading ``# `` line, else a new title and the source line on top."""
    line = F.concat(F.lit("> 来源文件："), source, F.lit(f" · 归档于 {day}"))
    first = L.head_line(content)
    rest = F.when(F.contains(content, F.lit("\n")), F.concat(F.lit("\n"), L.after_head(content))).otherwise("")
    return F.when(content.startswith("# "), F.concat(first, F.lit("\n"), line, rest)).otherwise(
        F.concat(F.lit("# "), title, F.lit("\n"), line, F.lit("\n\n"), content))
