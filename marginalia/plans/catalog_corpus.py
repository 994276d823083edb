"""Corpus queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..operators import corpus as C
from ..operators import lookup as K
from ..operators import ordered as O
from ..sources import tables as S
from . import oracle_views as V
from .oracle_views import with_
from .registry import query

# The provided sources stand for the category folders.
KEYS = {row[0]: f"src{i}" for i, row in enumerate(C.CATEGORIES)}
DEALS, INDUSTRY, TRACKING = KEYS["02_deals"], KEYS["01_industry"], KEYS["05_tracking"]
KEYWORDS = [("che", "T1"), ("tion", "T2"), ("ent", "T3")]
QUERY, TAG, SEED = "tion", "t3", "src7/d00000007.md"
QUERIES = ["tion", "der", "src1", "p5", "t3"]


def categories(spark):
    rows = [(KEYS[k], n, i, d) for k, n, i, d in C.CATEGORIES]
    return S.values(spark, rows, "category_key STRING, category_name STRING, icon STRING, description STRING")


def docs(spark, sf):
    return C.with_category(S.kb_docs(spark, sf), categories(spark))


def tracked(spark, sf):
    name = F.concat_ws(" ", "name", "title")
    return S.with_status(docs(spark, sf), spark, sf).withColumn("track", K.first_keyword(name, KEYWORDS, C.NO_TRACK))


KT = with_(V.K)

# ---- metadata ---------------------------------------------------------------------------------

MD = with_(V.K, f"D AS (SELECT * REPLACE ({S.FRONT.replace('STRING', 'VARCHAR')} AS content) FROM K)",
           "H AS (SELECT *, array_to_string(list_slice(string_split(content, chr(10)), 1, 30), chr(10)) AS head FROM D)")


def _meta(spark, sf, **cols):
    return S.kb_markdown(spark, sf).select("path", *[c.alias(n) for n, c in cols.items()])


@query("met01_title", MD + rf"""SELECT path, trim(regexp_extract(head, '(?m)^#\s+(.+)$', 1)) AS title FROM H""")
def _(spark, sf):
    return _meta(spark, sf, title=M.title("content"))


@query("met02_subtitle", MD + """SELECT path, array_to_string(list_transform(list_slice(list_filter(string_split(head, chr(10)),
 lambda x: starts_with(x, '> ') AND NOT starts_with(x, '> **')), 1, 2), lambda x: trim(substr(x, 3))), ' ') AS subtitle FROM H""")
def _(spark, sf):
    return _meta(spark, sf, subtitle=M.subtitle("content"))


@query("met03_tags", MD + rf"""SELECT path, unnest(list_filter(list_transform(string_split(
 coalesce(nullif(regexp_extract(head, '(?i)Tags?[:：]\s*([\p{{L}}\p{{N}}_\s,/#]+)', 1), ''),
          regexp_extract(head, '标签[:：]\s*([\p{{L}}\p{{N}}_\s,/#]+)', 1)), ','), lambda x: trim(x, {V.BLANKS})), lambda x: x <> '')) AS tag FROM H""")
def _(spark, sf):
    return S.kb_markdown(spark, sf).select("path", F.explode(M.tags("content")).alias("tag"))


@query("met04_project", MD + r"""SELECT path, trim(coalesce(nullif(regexp_extract(head, '\*\*Deal Type\*\*.*?\|\s*\*\*([^|*]+)\*\*', 1), ''),
 regexp_extract(head, '项目[:：]\s*(\S+)', 1))) AS project FROM H""")
def _(spark, sf):
    return _meta(spark, sf, project=M.project("content"))


STATUS_SQL = r"""trim(coalesce(nullif(regexp_extract(head, '(?i)Status\*{0,2}[:：]\s*([^\n|]+)', 1), ''),
 regexp_extract(head, '状态\*{0,2}[:：]\s*([^\n|]+)', 1)))"""


@query("met05_status_raw", MD + f"SELECT path, {STATUS_SQL} AS status_detail FROM H")
def _(spark, sf):
    return _meta(spark, sf, status_detail=M.status_detail("content"))


@query("met06_last_updated", MD + r"""SELECT path, CASE WHEN regexp_matches(head, 'Last Updated[:：]\s*\d{4}-\d{2}-\d{2}')
 THEN regexp_extract(head, 'Last Updated[:：]\s*(\d{4}-\d{2}-\d{2})', 1)
 ELSE regexp_extract(head, '更新[时日][间期][:：]\s*(\d{4}-\d{2}-\d{2})', 1) END AS last_updated FROM H""")
def _(spark, sf):
    return _meta(spark, sf, last_updated=M.last_updated("content"))


@query("met07_normalize_status", MD + f"""SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE
 WHEN regexp_matches({STATUS_SQL}, '退出') THEN '已退出' WHEN regexp_matches({STATUS_SQL}, '已投') THEN '已投资'
 WHEN regexp_matches({STATUS_SQL}, '放弃|否决|Pass') THEN '已放弃' WHEN regexp_matches({STATUS_SQL}, '推进|DD|尽调') THEN '推进中'
 ELSE '跟踪中' END AS status FROM H) GROUP BY status""")
def _(spark, sf):
    return _meta(spark, sf, status=M.normalize_status(M.status_detail("content"))).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


@query("met08_file_type", KT + """SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'markdown' WHEN doc_id % 3 = 1 THEN 'text'
 ELSE 'unknown' END AS type FROM K""")
def _(spark, sf):
    name = F.concat(F.replace("name", F.lit(".md"), F.lit("")), F.element_at(
        F.array(F.lit(".MD"), F.lit(".txt"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")))
    return S.kb_docs(spark, sf).select("path", M.file_type(name).alias("type"))


@query("met09_display_cols", KT + """SELECT path, CASE WHEN title = '' THEN replace(name, '.md', '') ELSE title END AS title,
 CASE WHEN last_updated = '' THEN substr(modified, 1, 10) ELSE last_updated END AS date FROM K""")
def _(spark, sf):
    return S.kb_docs(spark, sf).select("path", M.display_title("title", "name").alias("title"),
                                       M.display_date("last_updated", "modified").alias("date"))


@query("met10_doc_profile", MD + r""", X AS (SELECT path, name, left(content, 5000) AS t FROM D),
X2 AS (SELECT path, name, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM X),
X3 AS (SELECT path, name, min(CASE WHEN line = '## 技术原理' THEN pos END) AS h_at,
 min(CASE WHEN regexp_matches(line, '^#\s') THEN pos END) AS t_at, min(CASE WHEN regexp_matches(line, '^>\s') THEN pos END) AS q_at
 FROM X2 GROUP BY path, name)
SELECT X3.path, coalesce(max(CASE WHEN pos = t_at THEN trim(substr(line, 2)) END), replace(X3.name, '.md', '')) AS title,
 max(CASE WHEN pos = q_at THEN trim(substr(line, 2)) END) AS tagline,
 left(trim(regexp_replace(string_agg(CASE WHEN pos > h_at THEN line END, ' ' ORDER BY pos), '\s+', ' ', 'g')), 150) AS gist
FROM X2 JOIN X3 ON X2.path = X3.path GROUP BY X3.path, X3.name""")
def _(spark, sf):
    d = S.kb_markdown(spark, sf)
    return d.select("path", *[c.alias(n) for n, c in M.doc_profile("content", "name").items()])


@query("met11_safe_name", r"""SELECT doc_id, left(coalesce(nullif(trim(regexp_replace(trim(text, """ + V.BLANKS + r"""),
 '[\\/:*?"<>|\s]+', '_', 'g'), '_'), ''), 'none'), 60) AS safe_name FROM documents""")
def _(spark, sf):
    return S.spread(S.table(spark, sf, "documents"), "doc_id").select("doc_id", T.safe_name("text", "none").alias("safe_name"))


@query("met11_slug", r"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(concat('a/b/', text, '.md'), '(?s)^.*/', ''),
 '(?s)^(\.*[^.].*)\.[^.]*$', '\1'), '[^\p{L}\p{M}\p{Nd}\p{Pc}.-]', '_', 'g'), 60), ''), 'doc') AS slug FROM documents""")
def _(spark, sf):
    return S.spread(S.table(spark, sf, "documents"), "doc_id").select(
        "doc_id", T.slug(F.concat(F.lit("a/b/"), F.col("text"), F.lit(".md"))).alias("slug"))


@query("met12_route_target", with_(V.S) + r"""SELECT seq, CASE WHEN seq % 3 = 0 THEN concat('t', CAST(sub_query AS VARCHAR), '.md')
 ELSE concat(left(coalesce(nullif(trim(regexp_replace(trim(coalesce(nullif(CASE WHEN seq % 7 = 1 THEN '' ELSE title END, ''), theme)),
   '[\\/:*?"<>|\s]+', '_', 'g'), '_'), ''), '未命名技术'), 60), '.md') END AS target FROM S""")
def _(spark, sf):
    from ..operators.signals import route_target
    s = S.signals(spark, sf)
    target = F.expr("CASE seq % 3 WHEN 0 THEN concat('t', CAST(sub_query AS STRING), '.md') WHEN 1 THEN 'NEW' ELSE 'old' END")
    return s.select("seq", route_target(target, F.expr("CASE WHEN seq % 7 = 1 THEN '' ELSE title END"),
                                        F.col("theme")).alias("target"))


# ---- filters ----------------------------------------------------------------------------------

@query("fil01_by_category", KT + f"SELECT path, name, modified FROM K WHERE category_key = '{INDUSTRY}'")
def _(spark, sf):
    return C.by_category(S.kb_docs(spark, sf), INDUSTRY).select("path", "name", "modified")


@query("fil02_by_tag", KT + f"SELECT path FROM K WHERE list_contains(tags, '{TAG}')")
def _(spark, sf):
    return C.by_tag(S.kb_docs(spark, sf), TAG).select("path")


@query("fil03_by_path", KT + f"SELECT path, title, content FROM K WHERE path = '{SEED}'")
def _(spark, sf):
    return C.by_path(S.kb_docs(spark, sf), SEED).select("path", "title", "content")


@query("fil04_deals_filter", KT + f"""SELECT path, title, modified, count(*) OVER () AS shown,
 (SELECT count(*) FROM KT WHERE category_key = '{DEALS}') AS total
 FROM KT WHERE category_key = '{DEALS}' AND track = 'T2' AND status = '跟踪中'""")
def _(spark, sf):
    return C.filter_deals(tracked(spark, sf).drop("content"), DEALS, "T2", "跟踪中").select(
        "path", "title", "modified", "shown", "total")


@query("fil05_keyword_filter", KT + """SELECT path FROM KT WHERE lower(concat('[', category, '] ', title)) LIKE '%tion%'
 OR lower(name) LIKE '%tion%' OR lower(subtitle) LIKE '%tion%'""")
def _(spark, sf):
    d = docs(spark, sf)
    shown = F.concat(F.lit("["), F.col("category"), F.lit("] "), M.display_title("title", "name"))
    return C.by_keyword(d, " TION ", shown).select("path")


@query("fil10_report_docs", KT + f"""SELECT path, modified FROM K WHERE category_key = '{TRACKING}' AND name LIKE '%4%'
 ORDER BY modified DESC, category_key, name LIMIT 10""")
def _(spark, sf):
    return C.reports(S.kb_docs(spark, sf), TRACKING, "4").select("path", "modified")


@query("fil11_docs_with_section", with_(V.lines(S.HEADED)) + """SELECT DISTINCT doc_id FROM L
 WHERE line = '## The' AND pos < (SELECT max(pos) FROM L l2 WHERE l2.doc_id = L.doc_id)""")
def _(spark, sf):
    d = S.doc_lines(spark, sf).selectExpr("doc_id", "content", "'' AS modified", "source AS category_key",
                                          "CAST(doc_id AS STRING) AS name")
    return C.with_section(d, "The").select("doc_id")


@query("fil14_nonempty_text", KT + r"""SELECT path FROM K WHERE trim(regexp_replace(concat('<!-- p.', path, ' -->',
 CASE WHEN doc_id % 9 = 0 THEN '' ELSE content END, '<!--x', chr(10), 'y-->'), '(?s)<!--.*?-->', '', 'g'), """ + V.BLANKS + """) <> ''""")
def _(spark, sf):
    text = F.concat(F.lit("<!-- p."), F.col("path"), F.lit(" -->"),
                    F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("content")), F.lit("<!--x\ny-->"))
    return C.nonempty_text(S.kb_docs(spark, sf).withColumn("content", text)).select("path")


# ---- joins ------------------------------------------------------------------------------------

@query("joi01_category_dim", KT + "SELECT path, category FROM K")
def _(spark, sf):
    return docs(spark, sf).select("path", "category")


@query("joi02_track_assign", KT + "SELECT path, track FROM KT")
def _(spark, sf):
    return S.kb_docs(spark, sf).select("path", K.first_keyword(
        F.concat_ws(" ", "name", "title"), KEYWORDS, C.NO_TRACK).alias("track"))


@query("joi02_track_by_table", KT + """, D AS (SELECT DISTINCT left(c_name, 8) AS kw FROM customer),
 W AS (SELECT n_name AS keyword, lower(left(n_name, 2)) AS needle, n_nationkey AS prio FROM nation)
 SELECT path, coalesce((SELECT arg_min(keyword, prio) FROM W WHERE contains(concat(name, ' ', title), needle)), '未分类') AS track FROM K""")
def _(spark, sf):
    words = S.table(spark, sf, "nation").selectExpr("lower(left(n_name, 2)) AS keyword", "n_name AS track",
                                                    "n_nationkey AS prio")
    return K.track_by_table(S.kb_docs(spark, sf).select("path", "name", "title"), words).select("path", "track")


@query("joi03_local_override", """WITH B AS (SELECT lower(n_name) AS keyword, concat('R', CAST(n_regionkey AS VARCHAR)) AS track, n_nationkey AS prio FROM nation),
 X AS (SELECT lower(n_name) AS keyword, 'local' AS track, n_nationkey AS prio FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT lower(r_name), 'region', 100 + r_regionkey FROM region)
 SELECT keyword, track, CAST(block AS BIGINT) AS block, CAST(prio AS BIGINT) AS prio FROM (
  SELECT keyword, coalesce((SELECT track FROM X WHERE X.keyword = B.keyword), track) AS track, 0 AS block, prio FROM B
  UNION ALL SELECT keyword, track, 1, prio FROM X WHERE keyword NOT IN (SELECT keyword FROM B))""")
def _(spark, sf):
    nation, region = S.table(spark, sf, "nation"), S.table(spark, sf, "region")
    base = nation.selectExpr("lower(n_name) AS keyword", "concat('R', n_regionkey) AS track", "n_nationkey AS prio")
    local = nation.where("n_nationkey % 3 = 0").selectExpr("lower(n_name) AS keyword", "'local' AS track",
                                                           "n_nationkey AS prio").unionByName(
        region.selectExpr("lower(r_name) AS keyword", "'region' AS track", "100 + r_regionkey AS prio"))
    return K.merge_keywords(base, local).orderBy("block", "prio")


VIEWS_SQL = """V AS (SELECT event_id AS seq, CAST(ts AS VARCHAR) AS ts, (user_id * 13) % 1500 AS id FROM events),
 VP AS (SELECT seq, ts, concat(CASE WHEN id % 50 = 0 THEN '' ELSE concat('src', CAST(id % 20 AS VARCHAR), '/') END, 'd',
  lpad(CAST(id AS VARCHAR), 8, '0'), '.md') AS path FROM V),
 VH AS (SELECT path, max(seq) AS seq FROM VP GROUP BY path ORDER BY seq DESC LIMIT 50)"""


def views(spark, sf):
    return S.table(spark, sf, "events").selectExpr(
        "event_id AS seq", "CAST(ts AS STRING) AS ts", "(user_id * 13) % 1500 AS id").selectExpr(
        "seq", "ts", "concat(CASE WHEN id % 50 = 0 THEN '' ELSE concat('src', CAST(id % 20 AS STRING), '/') END, 'd', "
        "lpad(CAST(id AS STRING), 8, '0'), '.md') AS path")


@query("joi04_recent_views", with_(V.K, VIEWS_SQL) + """SELECT K.path, K.title FROM VH JOIN K USING (path) ORDER BY seq DESC LIMIT 5""")
def _(spark, sf):
    return C.recent_views(views(spark, sf), S.kb_docs(spark, sf).select("path", "title")).select("path", "title")


@query("win12_view_history_upsert", with_(VIEWS_SQL) + "SELECT path, seq FROM VH")
def _(spark, sf):
    return C.view_history(views(spark, sf)).select("path", "seq")


WORDS_SQL = "string_split_regex(lower(content), '\\s+')"


@query("joi05_related_docs", KT + f""", D AS (SELECT *, list_filter(list_distinct({WORDS_SQL}), lambda w: len(w) > 4) AS ws FROM K),
 Q AS (SELECT * FROM D WHERE path = '{SEED}'),
 R AS (SELECT D.path, D.category_key, D.name, CASE WHEN D.category = Q.category THEN 20 ELSE 0 END
   + 30 * len(list_intersect(D.tags, Q.tags)) + CASE WHEN D.project <> '' AND D.project = Q.project THEN 50 ELSE 0 END
   + len(list_intersect(D.ws, Q.ws)) AS s FROM D, Q WHERE D.path <> Q.path)
 SELECT path, s / 10 AS score FROM (SELECT * FROM R WHERE s > 0 ORDER BY s DESC, category_key, name LIMIT 5)""")
def _(spark, sf):
    return C.related(docs(spark, sf), SEED).select("path", "score")


@query("set03_token_intersect", KT + f""", Q AS (SELECT tags, {WORDS_SQL} AS ws FROM K WHERE path = '{SEED}')
 SELECT K.path, CAST(len(list_intersect(K.tags, Q.tags)) AS BIGINT) AS common_tags,
  CAST(len(list_filter(list_distinct({WORDS_SQL}), lambda w: w <> '' AND list_contains(Q.ws, w))) AS BIGINT) AS common_words
 FROM K, Q WHERE K.path <> '{SEED}'""")
def _(spark, sf):
    return C.overlap(S.kb_docs(spark, sf), SEED).select("path", "common_tags", "common_words")


@query("joi07_default_industry", KT + f""", P AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'Zz tail'
   ELSE split_part(title, ' ', 1) END AS track FROM K),
 I AS (SELECT path AS industry, row_number() OVER (ORDER BY name) AS pos, lower(concat(title, ' ', name)) AS hay,
   lower(trim(regexp_replace(CASE WHEN doc_id % 40 = 20 THEN 'Zz' ELSE coalesce(nullif(title, ''), name) END, '（.*?）|\\(.*?\\)|\\.md', '', 'g'))) AS core
   FROM (SELECT * REPLACE (CASE WHEN doc_id % 40 = 20 THEN 'Zz' ELSE title END AS title) FROM K WHERE category_key = '{INDUSTRY}')),
 T AS (SELECT DISTINCT lower(trim(track)) AS t FROM P WHERE track <> ''),
 B AS (SELECT t, coalesce((SELECT arg_min(industry, pos) FROM I WHERE contains(hay, t)),
   (SELECT arg_min(industry, pos) FROM I WHERE core <> '' AND contains(t, core))) AS industry FROM T)
 SELECT path, coalesce(B.industry, (SELECT arg_min(industry, pos) FROM I)) AS industry FROM P LEFT JOIN B ON lower(trim(P.track)) = B.t""")
def _(spark, sf):
    d = S.kb_docs(spark, sf)
    projects = d.selectExpr("path", "CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'Zz tail' "
                            "ELSE split_part(title, ' ', 1) END AS track")
    industries = C.by_category(d, INDUSTRY).selectExpr(
        "path", "name", "CASE WHEN doc_id % 40 = 20 THEN 'Zz' ELSE title END AS title", "name AS pos")
    return K.default_industry(projects, industries).select("path", "industry")


FRAMEWORK = {INDUSTRY: "src2/d00000002.md", DEALS: "src2/d00000022.md"}


@query("joi12_framework_join", KT + f"""SELECT path, coalesce((SELECT left(f.content, 4000) FROM K f WHERE f.path = CASE K.category_key
 WHEN '{INDUSTRY}' THEN 'src2/d00000002.md' WHEN '{DEALS}' THEN 'src2/d00000022.md' END), '') AS framework FROM K""")
def _(spark, sf):
    return C.with_framework(S.kb_docs(spark, sf), FRAMEWORK).select("path", "framework")


LINKS = [("a", "src2/d00000002.md"), ("b", "src2/missing.md"), ("c", "d00000050.md")]


@query("joi15_quick_links", KT + """SELECT label, path FROM (VALUES ('a','src2/d00000002.md'),('b','src2/missing.md'),
 ('c','d00000050.md')) t(label, path) WHERE path IN (SELECT path FROM K)""")
def _(spark, sf):
    return C.existing_links(S.values(spark, LINKS, "label STRING, path STRING"), S.kb_docs(spark, sf),
                            [p for _, p in LINKS]).select("label", "path")


# ---- aggregates -------------------------------------------------------------------------------

@query("agg01_category_counts", KT + """SELECT category_key, CAST(count(*) AS BIGINT) AS n FROM K WHERE category_key <> '' GROUP BY 1
 UNION ALL SELECT '(total)', CAST(count(*) AS BIGINT) FROM K""")
def _(spark, sf):
    return C.category_counts(S.kb_docs(spark, sf))


@query("agg02_all_tags", KT + "SELECT DISTINCT unnest(tags) AS tag FROM K")
def _(spark, sf):
    return C.all_tags(S.kb_docs(spark, sf))


@query("agg03_distinct_tracks", KT + "SELECT DISTINCT track FROM KT")
def _(spark, sf):
    d = S.kb_docs(spark, sf).withColumn("track", K.first_keyword(F.concat_ws(" ", "name", "title"), KEYWORDS, C.NO_TRACK))
    return C.distinct_tracks(d)


@query("agg04_track_overview", KT + f"""SELECT track, path, status, modified, CASE WHEN subtitle = '' THEN '—' WHEN length(subtitle) > 20
 THEN concat(left(subtitle, 20), '…') ELSE subtitle END AS brief, CAST(count(*) OVER (PARTITION BY track) AS BIGINT) AS track_size
 FROM KT WHERE category_key = '{DEALS}'""")
def _(spark, sf):
    deals = C.by_category(tracked(spark, sf).drop("content"), DEALS)
    brief = T.truncate(F.coalesce(F.nullif("subtitle", F.lit("")), F.lit("—")), 20, "…")
    return C.track_overview(deals).select("track", "path", "status", "modified", brief.alias("brief"), "track_size")


# ---- windows ----------------------------------------------------------------------------------

@query("win03_prev_next", KT + """SELECT path, lag(path) OVER w AS prev_path, lead(path) OVER w AS next_path FROM K
 WHERE category_key <> '' WINDOW w AS (PARTITION BY category_key ORDER BY name)""")
def _(spark, sf):
    return C.prev_next(S.kb_docs(spark, sf)).select("path", "prev_path", "next_path")


# ---- search and top lists ---------------------------------------------------------------------

SCORE_SQL = """CASE WHEN contains(lower(title), q) THEN 10 ELSE 0 END + CASE WHEN contains(lower(name), q) THEN 5 ELSE 0 END
 + CASE WHEN contains(lower(content), q) THEN 3 ELSE 0 END + CASE WHEN contains(lower(project), q) THEN 6 ELSE 0 END
 + CASE WHEN contains(lower(category), q) THEN 4 ELSE 0 END
 + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), q))) > 0 THEN 8 ELSE 0 END"""


@query("top01_search", KT + f""", Q AS (SELECT *, '{QUERY}' AS q FROM K)
 SELECT path, CAST(score AS BIGINT) AS score FROM (SELECT *, {SCORE_SQL} AS score FROM Q) WHERE score > 0
 ORDER BY score DESC, category_key, name LIMIT 40""")
def search(spark, sf):
    return C.search(docs(spark, sf), QUERY.upper()).select("path", "score")


@query("top01_search_blank", KT + "SELECT path FROM K")
def _(spark, sf):
    return C.search(docs(spark, sf), "").select("path")


@query("top02_search_multi", KT + f""", Q AS (SELECT K.*, q FROM K, (VALUES {', '.join(f"('{q}')" for q in QUERIES)}) t(q))
 SELECT q, path, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, category_key, name) AS BIGINT) AS rank
 FROM (SELECT *, {SCORE_SQL} AS score FROM Q) WHERE score > 0
 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, category_key, name) <= 40""")
def _(spark, sf):
    return C.search_many(docs(spark, sf), QUERIES).select("q", "path", "score", "rank")


@query("top02_search_table", KT + f""", Q AS (SELECT K.*, q FROM K, (SELECT DISTINCT lower(left(n_name, 2)) AS q FROM nation))
 SELECT q, path, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, category_key, name) AS BIGINT) AS rank
 FROM (SELECT *, {SCORE_SQL} AS score FROM Q) WHERE score > 0
 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, category_key, name) <= 40""")
def _(spark, sf):
    asked = S.table(spark, sf, "nation").selectExpr("left(n_name, 2) AS asked")
    return C.search_many(docs(spark, sf), asked).select("q", "path", "score", "rank")


ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("top03_hit_explain", KT + f""", Q AS (SELECT *, '{QUERY}' AS q FROM K),
 R AS (SELECT * FROM (SELECT *, {SCORE_SQL} AS score FROM Q) WHERE score > 0 ORDER BY score DESC, category_key, name LIMIT 40),
 A AS (SELECT *, position(q IN lower(content)) AS p0 FROM R),
 B AS (SELECT *, greatest(p0 - 71, 0) AS st FROM A)
 SELECT path, array_to_string(list_filter([CASE WHEN contains(lower(coalesce(nullif(title, ''), replace(name, '.md', ''))), q) THEN '标题' END,
  CASE WHEN contains(lower(project), q) THEN '项目' END, CASE WHEN contains(lower(category), q) THEN '分类' END,
  CASE WHEN contains(lower(content), q) THEN '正文' END], lambda x: x IS NOT NULL), ',') AS matched,
  CASE WHEN p0 > 0 THEN concat(CASE WHEN st > 0 THEN '…' ELSE '' END, regexp_replace({ESC.format(
      "replace(substr(content, CAST(st + 1 AS BIGINT), CAST(p0 - 1 + length(q) + 70 - st AS BIGINT)), chr(10), ' ')")},
      '(?i)({QUERY})', '<mark>\\1</mark>', 'g'), '…') ELSE '' END AS snippet FROM B""")
def _(spark, sf):
    return C.explain_hits(C.search(docs(spark, sf), QUERY), QUERY).select("path", "matched", "snippet")


@query("top04_recent_changes", KT + "SELECT path, modified FROM K ORDER BY modified DESC, category_key, name LIMIT 10")
def _(spark, sf):
    return C.newest(S.kb_docs(spark, sf)).select("path", "modified")


@query("top10_battle_order", KT + f"""SELECT category_key = '{DEALS}' AS is_deal, category, name FROM K""")
def _(spark, sf):
    return C.battle_order(docs(spark, sf), DEALS).select("is_deal", "category", "name")


@query("top11_per_category_preview", KT + """, R AS (SELECT category_key, name, row_number() OVER (PARTITION BY category_key ORDER BY name) AS rank,
  count(*) OVER (PARTITION BY category_key) AS total FROM K WHERE category_key <> '')
 SELECT category_key, name, CAST(rank AS BIGINT) AS rank, CAST(total AS BIGINT) AS total, total > 5 AS more FROM R WHERE rank <= 5""")
def _(spark, sf):
    return C.category_preview(S.kb_docs(spark, sf)).select("category_key", "name", "rank", "total", "more")


# ---- set operations, export, names ------------------------------------------------------------

@query("set02_corpus_union", KT + "SELECT path, size FROM K")
def _(spark, sf):
    d = S.kb_docs(spark, sf).select("path", "size", "category_key")
    return d.where("category_key = ''").unionByName(d.where("category_key <> ''")).select("path", "size")


SLUG = "concat('docs/', replace(replace(path, '/', '__'), '.md', ''), '.html')"


@query("src08_search_export", KT + f"""SELECT name, coalesce(nullif(title, ''), replace(name, '.md', '')) AS title, {SLUG} AS url,
 category, project, status, last_updated, subtitle, content FROM KT""")
def _(spark, sf):
    return C.search_export(tracked(spark, sf)).drop("category_icon")


@query("src09_page_manifest", KT + f"""SELECT 'fixed' AS kind, '' AS source, unnest(['index.html','search.html','compare.html','battle.html','radar.html']) AS url
 UNION ALL SELECT DISTINCT 'category', category_key, concat('category/', category_key, '.html') FROM K WHERE category <> '其他'
 UNION ALL SELECT 'doc', path, {SLUG} FROM K""")
def _(spark, sf):
    return C.page_manifest(spark, S.kb_docs(spark, sf), list(KEYS.values()))


NAMES_SQL = """B AS (SELECT doc_id AS seq, concat('n', CAST(doc_id % 17 AS VARCHAR)) AS base, doc_id % 4 = 0 AS old,
  1 + (doc_id * 7) % 23 AS suffix FROM documents),
 U AS (SELECT base, list(DISTINCT suffix) AS used FROM B WHERE old GROUP BY base),
 R AS (SELECT seq, base, row_number() OVER (PARTITION BY base ORDER BY seq) AS k, count(*) OVER (PARTITION BY base) AS m FROM B WHERE NOT old),
 F AS (SELECT seq, base, list_filter(range(1, m + 25), lambda x: NOT list_contains(coalesce(used, []), x))[k] AS n FROM R LEFT JOIN U USING (base))"""


@query("snk05_unique_names", with_(NAMES_SQL) + """SELECT seq, base, CASE WHEN n = 1 THEN base ELSE concat(base, '_', CAST(n AS VARCHAR)) END AS name FROM F""")
def _(spark, sf):
    d = S.table(spark, sf, "documents").selectExpr(
        "doc_id AS seq", "concat('n', CAST(doc_id % 17 AS STRING)) AS base", "doc_id % 4 = 0 AS old",
        "1 + (doc_id * 7) % 23 AS suffix")
    return O.unique_names(d.where("NOT old").select("seq", "base"), d.where("old").select("base", "suffix"))


@query("snk06_provenance_line", KT + """, D AS (SELECT path, name, title, CASE WHEN doc_id % 2 = 0 THEN concat('# ', content) ELSE content END AS c FROM K)
 SELECT path, md5(CASE WHEN starts_with(c, '# ') THEN array_to_string(list_concat(list_concat([split_part(c, chr(10), 1)],
  [concat('> 来源文件：', name, ' · 归档于 2024-01-31')]), string_split(c, chr(10))[2:]), chr(10))
  ELSE concat('# ', title, chr(10), '> 来源文件：', name, ' · 归档于 2024-01-31', chr(10), chr(10), c) END) AS h FROM D""")
def _(spark, sf):
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), F.col("content"))).otherwise(F.col("content"))
    return S.kb_docs(spark, sf).select("path", F.md5(C.provenance(c, F.col("title"), F.col("name"), "2024-01-31")).alias("h"))


# ---- scalar functions over documents ----------------------------------------------------------

@query("sca08_truncate", KT + """SELECT path, CASE WHEN length(content) > 800 THEN concat(left(content, 800), chr(10), '……（文档过长，已截断）')
 ELSE coalesce(nullif(content, ''), '（文档为空）') END AS prompt FROM K""")
def _(spark, sf):
    return S.kb_docs(spark, sf).select("path", T.prompt_text("content", 800).alias("prompt"))


@query("sca09_session_key", KT + "SELECT path, left(md5(path), 12) AS session_key FROM K")
def _(spark, sf):
    return S.kb_docs(spark, sf).select("path", T.session_key("path").alias("session_key"))


@query("sca10_md_cell", KT + f"""SELECT path, coalesce(nullif(trim(replace(replace(replace(content, 't', '|'), '|', '\\|'), chr(10), ' '), {V.BLANKS}), ''), '—') AS cell FROM K""")
def _(spark, sf):
    return S.kb_docs(spark, sf).select("path", T.md_cell(F.replace("content", F.lit("t"), F.lit("|"))).alias("cell"))
