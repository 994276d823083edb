"""Signal, narrative and cost queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import costs as C
from ..operators import narratives as N
from ..operators import signals as G
from ..sources import logs
from ..sources import tables as S
from . import oracle_views as V
from .oracle_views import with_
from .registry import query

AS_OF = "2024-01-31"
START, END = "2024-01-08", "2024-01-14"
Q = with_(V.S)

# ---- replies: JSON texts built from the events ------------------------------------------------

REPLY = """concat('说明文字 ```json', chr(10), '[', CASE WHEN event_id % 7 = 3 THEN '5,' ELSE '' END,
 '{{"title": "', event_type, ' 1.', CAST(user_id AS {s}), '", "date": "', CAST(CAST(ts AS DATE) AS {s}), 'T08:00", "source_type": "',
 CASE event_id % 3 WHEN 0 THEN '资本信息' WHEN 1 THEN '小道消息' ELSE '投资人观点' END, '", "event_type": "',
 CASE event_id % 4 WHEN 0 THEN 'Capital' WHEN 1 THEN '八卦' ELSE 'Policy' END, '", "theme": "',
 CASE event_id % 2 WHEN 0 THEN '光通信' ELSE '火星产业' END, '", "importance": "', CASE event_id % 5 WHEN 0 THEN '高' ELSE '爆表' END,
 '", "why": " w ", "key_points": ["a ", "", "b', CAST(user_id AS {s}), '"]}},',
 '{{"title": "', CASE WHEN event_id % 11 = 0 THEN '  ' ELSE concat('second ', event_type) END, '"}},',
 '{{"title": "third"', CASE WHEN event_id % 13 = 0 THEN '' ELSE '}}' END, ']', chr(10), '``` 完')"""
SPARK_REPLY = REPLY.format(s="STRING")
DUCK_REPLY = REPLY.format(s="VARCHAR")
ITEMS = f"""R AS (SELECT event_id, {DUCK_REPLY} AS t FROM events),
 A AS (SELECT event_id, substr(t, instr(t, '['), length(t) - instr(reverse(t), ']') + 2 - instr(t, '[')) AS js FROM R),
 I AS (SELECT event_id, json_extract(js, concat('$[', CAST(i AS VARCHAR), ']')) AS it, i AS pos FROM A, range(0, 5) g(i)
  WHERE json_valid(js) AND i < json_array_length(js)),
 IT AS (SELECT *, trim(coalesce(json_extract_string(it, '$.title'), '')) AS title FROM I WHERE json_type(it) = 'OBJECT')"""


def replies(spark, sf):
    return S.spread(S.table(spark, sf, "events"), "event_id").select("event_id", F.expr(SPARK_REPLY).alias("reply"))


@query("sca04_json_array_parse", with_(ITEMS) + "SELECT event_id, CAST(pos AS BIGINT) AS pos, title FROM IT WHERE title <> '' AND pos < 2")
def _(spark, sf):
    return G.parse_items(replies(spark, sf), "reply", "光通信", 2).select("event_id", "pos", "title")


@query("sca06_conform_signal", with_(ITEMS) + """SELECT event_id, CAST(pos AS BIGINT) AS pos, title, left(coalesce(json_extract_string(it, '$.date'), ''), 10) AS date,
 CASE WHEN json_extract_string(it, '$.source_type') IN ('产业信息', '资本信息', '投资人观点') THEN json_extract_string(it, '$.source_type') ELSE '产业信息' END AS source_type,
 CASE WHEN json_extract_string(it, '$.event_type') IN ('Capital', 'Policy') THEN json_extract_string(it, '$.event_type') ELSE 'Market' END AS event_type,
 CASE WHEN json_extract_string(it, '$.theme') = '光通信' THEN '光通信' ELSE '其他' END AS theme,
 CASE WHEN json_extract_string(it, '$.importance') = '高' THEN '高' ELSE '中' END AS importance,
 trim(coalesce(json_extract_string(it, '$.why'), '')) AS why, 'wechat' AS origin FROM IT WHERE title <> ''""")
def _(spark, sf):
    return G.parse_article_items(replies(spark, sf), "reply").select(
        "event_id", "pos", "title", "date", "source_type", "event_type", "theme", "importance", "why", "origin")


OBJECT = """concat(CASE event_id % 5 WHEN 0 THEN '[1,2,3]' WHEN 1 THEN 'no json here' ELSE concat('前缀 {{"target": " t', CAST(user_id AS {s}),
 ' ", "n": ', CAST(event_id AS {s}), ', "key_points": ["a ", "", " b", "c", "d", "e", "f", "g"], "metrics": "x"',
 CASE WHEN event_id % 11 = 0 THEN '' ELSE '}}' END, ' 后缀') END)"""
OBJ = f"""R AS (SELECT event_id, {OBJECT.format(s='VARCHAR')} AS t FROM events),
 A AS (SELECT event_id, CASE WHEN instr(t, '{{') > 0 AND instr(t, '}}') > 0 THEN
  substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) END AS js FROM R)"""


def objects(spark, sf):
    return S.spread(S.table(spark, sf, "events"), "event_id").select("event_id", F.expr(OBJECT.format(s="STRING")).alias("reply"))


@query("sca05_json_object_parse", with_(OBJ) + """SELECT event_id, CASE WHEN js IS NOT NULL THEN CAST(json_extract_string(js, '$.n') AS BIGINT) END AS n FROM A""")
def _(spark, sf):
    return objects(spark, sf).select("event_id", F.try_variant_get(G.json_object("reply"), "$.n", "bigint").alias("n"))


@query("sca07_conform_extraction", with_(OBJ) + """SELECT event_id, trim(json_extract_string(js, '$.target')) AS target, 'a|b|c|d|e|f' AS key_points,
 '' AS metrics FROM A WHERE js IS NOT NULL""")
def _(spark, sf):
    return G.conform_extraction(objects(spark, sf), "reply").select(
        "event_id", "target", F.array_join("key_points", "|").alias("key_points"), F.array_join("metrics", "|").alias("metrics"))


@query("sca07_source_line", """SELECT doc_id, concat('2024-02-01 ', CASE WHEN doc_id % 4 = 0 THEN '公众号' ELSE source END, '《',
 coalesce(nullif(trim(text, """ + V.BLANKS + """), ''), '未命名文章'), '》') AS line FROM documents""")
def _(spark, sf):
    account = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    date = F.when(F.col("doc_id") % 3 == 0, "").otherwise("2024-02-01T09:00")
    return S.table(spark, sf, "documents").select(
        "doc_id", G.source_line(date, account, F.col("text"), "2024-02-01").alias("line"))


@query("sca03_strip_fence", f"SELECT event_id, trim(regexp_replace({DUCK_REPLY}, '```\\w*', '', 'g'), {V.BLANKS}) AS t FROM events")
def _(spark, sf):
    return replies(spark, sf).select("event_id", T.strip_fence("reply").alias("t"))


@query("sca03_strip_outer_fence", """SELECT event_id, concat('a', chr(10), '```', chr(10), event_type) AS t FROM events""")
def _(spark, sf):
    text = F.concat(F.lit(" ```markdown \na\n```\n"), F.col("event_type"), F.lit("\n```  \n"))
    return S.table(spark, sf, "events").select("event_id", T.strip_outer_fence(text).alias("t"))


@query("sca01_norm_title", with_(V.S) + "SELECT seq, key FROM SK")
def _(spark, sf):
    return S.signals(spark, sf).select("seq", T.norm_title("title").alias("key"))


@query("sca20_enum_labels", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '资本' WHEN 1 THEN '技术' WHEN 2 THEN '政策' ELSE 'rumour' END AS label,
 CASE user_id % 3 WHEN 0 THEN '投资雷达' WHEN 1 THEN '其他' ELSE event_type END AS feature FROM events""")
def _(spark, sf):
    kind = F.expr("element_at(array('Capital', 'Technology', 'Policy', 'rumour'), CAST(event_id % 4 + 1 AS INT))")
    feature = F.expr("CASE user_id % 3 WHEN 0 THEN 'radar' WHEN 1 THEN 'unknown' ELSE event_type END")
    return S.table(spark, sf, "events").select("event_id", T.label(kind, T.EVENT_LABELS).alias("label"),
                                               T.label(feature, T.FEATURE_LABELS).alias("feature"))


# ---- filters ----------------------------------------------------------------------------------

@query("fil06_fresh", Q + """SELECT seq, date FROM S WHERE NOT regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}')
 OR CAST(left(date, 10) AS DATE) >= DATE '2024-01-31' - 10""")
def _(spark, sf):
    return G.fresh(S.signals(spark, sf), AS_OF).select("seq", "date")


@query("fil07_recent_theme", Q + "SELECT seq, date FROM S WHERE theme = 'click' AND date >= '2024-01-24'")
def _(spark, sf):
    return G.recent_of_theme(S.signals(spark, sf), "click", AS_OF).select("seq", "date")


@query("fil08_in_range", Q + f"SELECT seq, date FROM S WHERE TRY_CAST(left(date, 10) AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'")
def _(spark, sf):
    return S.signals(spark, sf).where(G.in_range("date", START, END)).select("seq", "date")


@query("fil09_watchlist_select", with_(V.WL) + "SELECT theme FROM WL WHERE enabled IS NOT FALSE AND is_primary")
def _(spark, sf):
    return G.select_watchlist(S.watchlist(spark, sf), primary_only=True).select("theme")


# ---- windows, sets ----------------------------------------------------------------------------

FIRSTS = "SELECT min(seq) AS seq, key FROM SK WHERE key <> '' GROUP BY key"


@query("win01_dedup_keep_first", Q + f"SELECT SK.seq, SK.key, SK.title FROM SK JOIN ({FIRSTS}) f ON SK.seq = f.seq")
def _(spark, sf):
    return G.dedup(S.signals(spark, sf)).select("seq", "key", "title")


@query("win02_cap_per_group", Q + """SELECT seq, theme, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY seq) AS rk FROM
 (SELECT *, row_number() OVER (PARTITION BY theme, sub_query ORDER BY seq) AS rq FROM SK) WHERE rq <= 4) WHERE rk <= 10""")
def _(spark, sf):
    from ..operators.ordered import top_per_group
    capped = top_per_group(S.signals(spark, sf), ["theme", "sub_query"], [F.col("seq")], G.MAX_PER_QUERY, "rq")
    return top_per_group(capped, ["theme"], [F.col("seq")], G.MAX_PER_THEME).select("seq", "theme", "rank")


@query("set05_multi_angle_merge", Q + """SELECT seq, theme, key, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY seq) AS rk FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme, sub_query ORDER BY seq) AS rq FROM SK) WHERE rq <= 4 AND key <> ''
  QUALIFY row_number() OVER (PARTITION BY theme, key ORDER BY seq) = 1)) WHERE rk <= 10""")
def _(spark, sf):
    return G.merge_angles(S.signals(spark, sf)).select("seq", "theme", "key", "rank")


POOL = """OLD AS (SELECT DISTINCT key FROM SK WHERE seq % 40 = 0),
 ADDED AS (SELECT min(seq) AS seq, key FROM SK WHERE seq % 40 <> 0 AND key <> '' AND key NOT IN (SELECT key FROM OLD) GROUP BY key)"""


def pool_split(spark, sf):
    s = S.signals(spark, sf)
    return s.where("seq % 40 = 0"), s.where("seq % 40 <> 0")


@query("joi06_dedup_against_pool", with_(V.S, POOL) + "SELECT seq, key FROM ADDED")
def _(spark, sf):
    return G.new_items(*pool_split(spark, sf)).select("seq", "key")


@query("snk04_pool_append", with_(V.S, POOL) + "SELECT seq, title, 'wechat' AS origin, false AS auto FROM S JOIN ADDED USING (seq)")
def _(spark, sf):
    return G.append_to_pool(*pool_split(spark, sf)).select("seq", "title", "origin", "auto")


@query("set01_pool_union", with_(V.S, POOL) + """SELECT seq, title, CASE WHEN seq % 40 <> 0 THEN 'wechat' END AS origin FROM S
 WHERE seq % 40 = 0 OR seq IN (SELECT seq FROM ADDED)""")
def _(spark, sf):
    pool, new = pool_split(spark, sf)
    return G.pool_union(pool, G.append_to_pool(pool, new)).select("seq", "title", "origin")


@query("win17_sub_query_expand", with_(V.WL) + """SELECT theme, sub_query, CAST(row_number() OVER (PARTITION BY theme ORDER BY i) - 1 AS BIGINT) AS pos FROM (
 SELECT theme, unnest(coalesce(sub_queries, [query, concat(theme, ' 产业链 订单 供需 产能 格局'), concat(theme, ' 科研进展 学术会议 论文 技术突破'),
  concat(theme, ' 融资 并购 IPO 投资人观点 市场预期')])) AS sub_query, generate_subscripts(coalesce(sub_queries, ['','','','']), 1) AS i FROM WL) WHERE sub_query <> ''""")
def _(spark, sf):
    return G.expand_queries(S.watchlist(spark, sf)).select("theme", "pos", "sub_query")


@query("win18_empty_retry_plan", with_(V.WL) + """SELECT theme, concat(query, ' 最新进展 本周') AS sub_query FROM WL
 WHERE theme NOT IN (SELECT concat('c', CAST(user_id AS VARCHAR)) FROM events WHERE event_id % 41 = 0 OR event_id % 43 = 0 OR ts >= TIMESTAMP '2024-01-21')""")
def _(spark, sf):
    found = G.fresh(S.signals(spark, sf), AS_OF).selectExpr("concat('c', CAST(sub_query AS STRING)) AS theme")
    return G.retry_plan(S.watchlist(spark, sf), found)


@query("agg21_fetch_stats", """WITH U AS (SELECT DISTINCT user_id FROM events), T AS (SELECT DISTINCT event_type FROM events)
 SELECT event_type AS theme, U.user_id AS sub_query, (SELECT CAST(count(*) AS BIGINT) FROM events e WHERE e.event_type = T.event_type
  AND e.user_id = U.user_id AND e.event_id % 3 <> 0) * CAST(U.user_id % 11 <> 0 AS BIGINT) AS n, U.user_id % 11 = 0 AS failed,
  CASE WHEN U.user_id % 11 = 0 THEN 'HTTP 503' END AS error FROM U, T
 WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = T.event_type AND e.user_id = U.user_id)""")
def _(spark, sf):
    s = S.signals(spark, sf)
    asked = s.select("theme", "sub_query", F.expr("CASE WHEN sub_query % 11 = 0 THEN 'HTTP 503' END AS error")).distinct()
    return G.fetch_stats(asked, s.where("seq % 3 <> 0"))


@query("udf02_request_build", """WITH X AS (SELECT doc_id // 4096 * 4096 AS start, doc_id, to_json({title: trim(split_part(text, chr(10), 1), """ + V.BLANKS + """),
  account: source, date: '2024-02-01', text: left(text, 4000)}) AS item FROM documents),
 Y AS (SELECT *, (row_number() OVER (PARTITION BY start ORDER BY doc_id) - 1) // 8 AS batch FROM X)
 SELECT CAST(start AS BIGINT) AS start, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_articles,
  concat('[', string_agg(item, ',' ORDER BY doc_id), ']') AS payload FROM Y GROUP BY start, batch""")
def _(spark, sf):
    a = S.table(spark, sf, "documents").selectExpr(
        "doc_id AS seq", "substring_index(text, '\n', 1) AS title", "source AS account",
        "'2024-02-01T09:00' AS date", "text")
    return G.article_payload(a, "seq")


ARTICLES = f"""A AS (SELECT doc_id, to_json({{title: trim(split_part(text, chr(10), 1), {V.BLANKS}), account: source, date: '2024-02-01', text: left(text, 4000)}}) AS item FROM documents)"""


def articles(spark, sf):
    return S.table(spark, sf, "documents").selectExpr(
        "doc_id AS seq", "substring_index(text, '\n', 1) AS title", "source AS account", "'2024-02-01T09:00' AS date", "text")


@query("udf02_full_requests", with_(ARTICLES, "B AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM A)") + """
 SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_articles, concat('[', string_agg(item, ',' ORDER BY doc_id), ']') AS payload FROM B GROUP BY batch""")
def _(spark, sf):
    return G.article_requests(articles(spark, sf), "seq")


@query("udf02_extraction_requests", with_(V.K, ARTICLES, """T AS (SELECT string_agg(concat('- ', name, ' | ', title, ' — ', left(subtitle, 60), ' | 内容：', left(content, 100)), chr(10) ORDER BY name) AS docs
  FROM K WHERE category_key = 'src8')""") + """ SELECT doc_id AS seq, md5(docs) AS docs, CAST(item AS VARCHAR) AS payload FROM A, T""")
def _(spark, sf):
    known = S.kb_docs(spark, sf).where("category_key = 'src8'").select("name", "title", F.col("subtitle").alias("tagline"), F.col("content").alias("gist"))
    asked = G.filing_requests(articles(spark, sf), known, "seq")
    return asked.select("seq", F.col("list_md5").alias("docs"), "payload")


# ---- lists and counts -------------------------------------------------------------------------

@query("agg05_theme_distribution", Q + f"""SELECT theme, CAST(count(*) AS BIGINT) AS n, min(seq) AS first_seq FROM S
 WHERE TRY_CAST(date AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY theme""")
def _(spark, sf):
    return G.theme_distribution(S.signals(spark, sf), START, END)


@query("top05_latest_signals", Q + "SELECT seq, title FROM S WHERE theme = 'view' ORDER BY seq DESC LIMIT 50")
def _(spark, sf):
    return G.latest(S.signals(spark, sf), 50, "view").select("seq", "title")


@query("top06_signals_by_date", Q + "SELECT seq, date FROM S ORDER BY date DESC, seq LIMIT 50")
def _(spark, sf):
    return G.newest_by_date(S.signals(spark, sf)).select("seq", "date")


# ---- narratives -------------------------------------------------------------------------------

NQ = with_(V.N)
CUR = """CUR AS (SELECT theme, narrative, date AS updated, trig FROM N WHERE trim(narrative) <> ''
 QUALIFY row_number() OVER (PARTITION BY theme ORDER BY seq DESC) = 1)"""


def hist(spark, sf):
    return N.history(S.narratives(spark, sf))


@query("win04_narrative_history", NQ + "SELECT theme, seq, date, previous, new_narrative, trig AS trigger, is_transition FROM NH")
def _(spark, sf):
    return hist(spark, sf)


@query("win05_theme_current", with_(V.N, CUR) + "SELECT theme, narrative, updated FROM CUR")
def _(spark, sf):
    return N.current(S.narratives(spark, sf)).select("theme", "narrative", "updated")


@query("joi17_theme_updates", with_(V.N, CUR) + f"""SELECT theme FROM NH WHERE date BETWEEN '{START}' AND '{END}'
 UNION SELECT theme FROM CUR WHERE updated BETWEEN '{START}' AND '{END}'""")
def _(spark, sf):
    return N.updated_themes(hist(spark, sf), N.current(S.narratives(spark, sf)), START, END)


@query("agg06_week_kpis", with_(V.S, V.N, V.NV, CUR) + """SELECT (SELECT count(*) FROM S WHERE date >= '2024-01-24') AS n_signals,
 (SELECT count(DISTINCT theme) FROM (SELECT theme FROM NH WHERE date >= '2024-01-24' UNION ALL SELECT theme FROM CUR WHERE updated >= '2024-01-24')) AS n_themes,
 (SELECT count(*) FROM NV WHERE date >= '2024-01-24') AS n_variables""")
def _(spark, sf):
    feed = S.narratives(spark, sf)
    return N.week_kpis(S.signals(spark, sf), N.history(feed), N.current(feed), S.variables(spark, sf), AS_OF)


@query("top07_narrative_changes", NQ + """SELECT theme, seq, date, new_narrative FROM NH WHERE date >= '2024-01-01' ORDER BY date DESC, theme, seq LIMIT 4""")
def _(spark, sf):
    return N.recent_changes(hist(spark, sf), AS_OF).select("theme", "seq", "date", "new_narrative")


@query("top08_theme_history_tail", NQ + """SELECT theme, seq, previous, new_narrative, CAST(row_number() OVER w AS BIGINT) AS rank FROM NH
 WINDOW w AS (PARTITION BY theme ORDER BY seq DESC) QUALIFY row_number() OVER w <= 8""")
def _(spark, sf):
    return N.history_tail(hist(spark, sf)).select("theme", "seq", "previous", "new_narrative", "rank")


QUESTIONS = "  是否采用 CPO\n\n价格战是否传导 \n"


@query("agg22_weekly_report_sections", with_(V.S, V.N, V.NV, CUR, f"""UP AS (SELECT theme FROM NH WHERE date BETWEEN '{START}' AND '{END}'
  UNION SELECT theme FROM CUR WHERE updated BETWEEN '{START}' AND '{END}')""") + f"""
 SELECT 'distribution' AS section, theme, 'signals' AS field, theme AS value, CAST(count(*) AS BIGINT) AS n FROM S
  WHERE TRY_CAST(date AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY theme
 UNION ALL SELECT 'review', theme, f, CASE f WHEN 'narrative' THEN narrative ELSE trig END, NULL FROM CUR, (VALUES ('narrative'), ('evidence')) t(f) WHERE theme IN (SELECT theme FROM UP)
 UNION ALL SELECT 'evolution', theme, f, CASE f WHEN 'previous' THEN previous WHEN 'new' THEN new_narrative ELSE date END, NULL FROM NH, (VALUES ('previous'), ('new'), ('date')) t(f)
  WHERE is_transition AND date BETWEEN '{START}' AND '{END}'
 UNION ALL SELECT 'variables', theme, f, CASE f WHEN 'title' THEN title ELSE var_type END, NULL FROM NV, (VALUES ('title'), ('var_type')) t(f) WHERE date BETWEEN '{START}' AND '{END}'
 UNION ALL SELECT 'questions', NULL, 'question', unnest(['是否采用 CPO', '价格战是否传导']), NULL""")
def _(spark, sf):
    return N.weekly_report(S.signals(spark, sf), S.narratives(spark, sf), S.variables(spark, sf), START, END,
                           G.nonblank_lines(QUESTIONS))


@query("agg20_unresolved_count", """SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS theme,
 CAST(sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) AS BIGINT) AS unresolved,
 CASE WHEN arg_max(o_orderkey % 100, o_orderkey) >= 70 THEN '高' WHEN arg_max(o_orderkey % 100, o_orderkey) >= 40 THEN '中' ELSE '低' END AS level
 FROM orders GROUP BY 1""")
def _(spark, sf):
    from ..operators.sections import confidence_level, unresolved
    o = S.table(spark, sf, "orders").selectExpr(
        "concat('c', CAST(o_custkey AS STRING)) AS theme", "o_orderkey AS seq", "o_orderkey % 100 AS confidence",
        "CASE o_orderstatus WHEN 'F' THEN '未验证' WHEN 'P' THEN '部分验证' ELSE '已验证' END AS verification")
    return unresolved(o, "theme", "verification").join(
        o.groupBy("theme").agg(F.max_by("confidence", "seq").alias("c")), "theme").select(
        "theme", "unresolved", confidence_level(F.col("c")).alias("level"))


@query("sca19_multi_line_list", """SELECT o_orderkey AS seq, [o_orderstatus, o_orderpriority, 'x • y'][i] AS item, CAST(i - 1 AS BIGINT) AS pos FROM orders, range(1, 4) g(i)""")
def _(spark, sf):
    field = F.concat(F.lit("\n- "), F.col("o_orderstatus"), F.lit("\n\n · "), F.col("o_orderpriority"), F.lit("\n  •• x • y \n"))
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"),
                                               F.posexplode(T.bullet_items(field)).alias("pos", "item"))


# ---- cost log ---------------------------------------------------------------------------------

CQ = with_(V.C)


def costed(spark, sf):
    return C.with_cost(S.cost_log(spark, sf), spark)


@query("joi08_price_join", CQ + "SELECT seq, model, CAST(cost AS DOUBLE) AS cost FROM CP")
def _(spark, sf):
    return costed(spark, sf).select("seq", "model", "cost")


@query("agg07_cost_today", CQ + """SELECT CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(cost AS DECIMAL(18,4))) AS DOUBLE) AS cost FROM CP WHERE day = '2024-01-30'""")
def _(spark, sf):
    return C.cost_of_day(costed(spark, sf), "2024-01-30")


@query("agg08_cost_week_by_feature", CQ + """SELECT coalesce(feature, '(total)') AS feature, CAST(count(*) AS BIGINT) AS calls,
 CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(CAST(cost AS DECIMAL(18,4))) AS DOUBLE) AS cost
 FROM CP WHERE day >= '2024-01-24' GROUP BY ROLLUP (feature)""")
def _(spark, sf):
    return C.cost_by_feature(costed(spark, sf), AS_OF)


@query("joi09_provider_match", """SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'moonshot' WHEN 1 THEN 'deepseek' WHEN 2 THEN 'openai' WHEN 3 THEN 'gemini'
 WHEN 4 THEN 'dashscope' ELSE NULL END AS provider FROM events""")
def _(spark, sf):
    e = S.table(spark, sf, "events")
    model = F.expr("element_at(array('KIMI-k2.6', 'gpt-4o', 'o1-mini', 'x', 'qwen-plus', 'mystery'), CAST(user_id % 6 + 1 AS INT))")
    url = F.expr("element_at(array('https://proxy', 'https://api.deepseek.com/v1/', '', "
                 "'https://generativelanguage.googleapis.com/v1beta/openai', NULL, 'https://api.unknown'), CAST(user_id % 6 + 1 AS INT))")
    return e.select("event_id", C.match_provider(model, url).alias("provider"))


@query("agg10_run_totals", """SELECT event_id, user_id + CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_signals,
 user_id % 5 + 2 AS n_variables FROM events""")
def _(spark, sf):
    runs = S.table(spark, sf, "events").selectExpr(
        "event_id", "map(event_type, user_id, 'other', CAST(get_json_object(props, '$.k') AS BIGINT)) AS results",
        "map('a', named_struct('updated', true, 'variables', user_id % 5), 'b', named_struct('updated', false, 'variables', 2L)) AS cognition")
    return C.run_totals(runs).select("event_id", "n_signals", "n_variables")


LOG_LINES = """CASE WHEN event_id % 17 = 0 THEN '  ' WHEN event_id % 19 = 0 THEN '{{bad' ELSE concat('{{"ts": "', CAST(CAST(ts AS DATE) AS {s}),
 '", "feature": "', event_type, '", "prompt_tokens": ', CAST(user_id AS {s}), '}}') END"""


@query("src04_jsonl_log_read", """SELECT event_id AS seq, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS feature,
 CASE WHEN event_id % 19 = 0 THEN NULL ELSE user_id END AS prompt_tokens, event_id % 19 = 0 AS corrupt FROM events WHERE event_id % 17 <> 0""")
def _(spark, sf):
    lines = S.table(spark, sf, "events").select(F.col("event_id").alias("seq"),
                                                F.expr(LOG_LINES.format(s="STRING")).alias("value"))
    return logs.parse_cost_lines(lines).select("seq", "feature", "prompt_tokens", "corrupt")


@query("src05_last_log_entry", """SELECT CAST(arg_max(CAST(ts AS DATE), event_id) AS VARCHAR) AS ts,
 concat(CAST(arg_max(CAST(ts AS DATE), event_id) AS VARCHAR), '（', arg_max(event_type, event_id), '）') AS label FROM events""")
def _(spark, sf):
    log = S.table(spark, sf, "events").selectExpr("event_id AS seq", "CAST(CAST(ts AS DATE) AS STRING) AS ts", "event_type AS mode")
    return C.last_entry(log)


