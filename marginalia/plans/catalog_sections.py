"""Queries over lines, sections, pages and web pages, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as T
from ..operators import pages as G
from ..operators import sections as U
from ..sources import articles as A
from ..sources import logs
from ..sources import tables as S
from . import oracle_views as V
from .oracle_views import with_
from .registry import query

NL = "chr(10)"


def lines_sql(rewrite, *more):
    return with_(V.lines(rewrite.replace("STRING", "VARCHAR")), *more)


def text(spark, sf, rewrite):
    return S.doc_lines(spark, sf, rewrite)


# ---- repeated lines and legal tail ------------------------------------------------------------

W6 = f"""W AS (SELECT *, trim(line, {V.BLANKS}) AS s FROM L),
 W2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c, row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) AS r FROM W),
 KEPT AS (SELECT * FROM W2 WHERE NOT (c >= 4 AND length(s) BETWEEN 8 AND 80 AND r > 1)),
 O AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS off,
   sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM KEPT),
 CUT AS (SELECT doc_id, min(off) AS cut FROM O WHERE off >= floor(total * 0.75)
   AND regexp_matches(line, '^(#{{1,6}}\\s*)?.{{0,20}}(免责声明|法律声明|分析师声明|版权声明|公司声明).{{0,20}}$') GROUP BY doc_id),
 FULL_T AS (SELECT doc_id, string_agg(line, {NL} ORDER BY pos) AS t FROM KEPT GROUP BY doc_id)"""


@query("agg16_repeated_lines", lines_sql(S.BOILER, W6) + "SELECT DISTINCT doc_id, s AS line, CAST(c AS BIGINT) AS n FROM W2 WHERE c >= 4 AND length(s) BETWEEN 8 AND 80")
def _(spark, sf):
    return text(spark, sf, S.BOILER).select("doc_id", F.inline(L.repeated_lines("content")))


@query("win06_drop_repeated_lines", lines_sql(S.BOILER, W6) + f"""SELECT doc_id, CASE WHEN cut IS NULL THEN t
 ELSE concat(rtrim(left(t, CAST(cut AS BIGINT)), {V.BLANKS}), {NL}) END AS trimmed FROM FULL_T LEFT JOIN CUT USING (doc_id)""")
def trimmed(spark, sf):
    return text(spark, sf, S.BOILER).select("doc_id", L.trim_boilerplate("content").alias("trimmed"))


# ---- section merge ----------------------------------------------------------------------------

SECS = f"""X AS (SELECT *, regexp_matches(line, '^##\\s') AS is_head,
  sum(CASE WHEN regexp_matches(line, '^##\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM L),
 SEC AS (SELECT doc_id, sec, max(CASE WHEN is_head THEN line END) AS head,
  coalesce(string_agg(CASE WHEN NOT is_head THEN line END, {NL} ORDER BY pos), '') AS body FROM X GROUP BY doc_id, sec),
 KEYED AS (SELECT *, lower(replace(replace(regexp_replace(trim(head, {V.BLANKS}), '^#{{1,6}}\\s*', ''), '：', ':'), ' ', '')) AS key FROM SEC WHERE sec > 0),
 BEST AS (SELECT *, min(sec) OVER (PARTITION BY doc_id, key) AS first FROM KEYED
  QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY length(body) DESC, sec) = 1)"""


@query("win07_sections_keep_longest", lines_sql(S.HEADED, SECS) + "SELECT doc_id, CAST(first - 1 AS BIGINT) AS ord, head, key, body FROM BEST")
def merged(spark, sf):
    return text(spark, sf, S.HEADED).select("doc_id", F.inline(L.merged_sections("content")))


WHITELIST = ["## 1. The", "### 附录 A：ion", "## 2、 Is", "# an", "## zzz"]
NORMS = "(VALUES (0, 'the'), (1, 'ion'), (2, 'is'), (3, 'an'), (4, 'zzz')) w(p, w)"


@query("joi13_section_whitelist", lines_sql(S.HEADED, SECS, f"""HIT AS (SELECT BEST.*, (SELECT coalesce(min(CASE WHEN w = key THEN p END), min(p)) FROM {NORMS}
   WHERE key <> '' AND (contains(key, w) OR contains(w, key))) AS p FROM BEST),
 HIT2 AS (SELECT *, count(p) OVER (PARTITION BY doc_id) AS hits FROM HIT)""") + """
 SELECT doc_id, head, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN hits > 0 THEN p ELSE 0 END, first) - 1 AS BIGINT) AS pos
 FROM HIT2 WHERE hits = 0 OR p IS NOT NULL""")
def _(spark, sf):
    return text(spark, sf, S.HEADED).select(
        "doc_id", F.posexplode(L.merged_sections("content", WHITELIST)).alias("pos", "s")).select("doc_id", "s.head", "pos")


FRAMEWORK = 3  # doc_id of the framework document
UNNUMBERED = "regexp_replace({}, '^(?:\\d+[.、]|[一二三四五六七八九十]+[、.]|模块\\d+[:：]|附录[a-z][:：])', '')"


@query("joi13_framework_whitelist", lines_sql(S.HEADED, SECS, f"""FW AS (SELECT row_number() OVER (ORDER BY pos) AS p, {UNNUMBERED.format(
   "lower(replace(replace(regexp_replace(trim(line, " + V.BLANKS + "), '^#{1,6}\\s*', ''), '：', ':'), ' ', ''))")} AS w
  FROM L WHERE doc_id = {FRAMEWORK} AND regexp_matches(trim(line, {V.BLANKS}), '^#{{1,6}}\\s')),
 BARE AS (SELECT *, {UNNUMBERED.format("key")} AS k FROM BEST),
 HIT AS (SELECT BARE.*, (SELECT coalesce(min(CASE WHEN w = k THEN p END), min(p)) FROM FW WHERE k <> '' AND w <> '' AND (contains(k, w) OR contains(w, k))) AS p FROM BARE),
 HIT2 AS (SELECT *, count(p) OVER (PARTITION BY doc_id) AS hits FROM HIT)""") + """
 SELECT doc_id, head, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN hits > 0 THEN p ELSE 0 END, first) - 1 AS BIGINT) AS pos
 FROM HIT2 WHERE hits = 0 OR p IS NOT NULL""")
def _(spark, sf):
    docs = text(spark, sf, S.HEADED)
    framework = docs.where(F.col("doc_id") == FRAMEWORK).select(U.headings("content")).scalar()
    docs = docs.withColumn("names", framework)
    return docs.select("doc_id", F.posexplode(L.merged_sections("content", F.col("names"))).alias("pos", "s")).select("doc_id", "s.head", "pos")


@query("win07_merged_text", lines_sql(S.HEADED, SECS) + f"""SELECT doc_id, md5(string_agg(concat(head, {NL}, trim(body, {NL})), concat({NL}, {NL}) ORDER BY first)) AS h FROM BEST GROUP BY doc_id""")
def _(spark, sf):
    return text(spark, sf, S.HEADED).select("doc_id", F.md5(L.dedupe_sections("content")).alias("h"))


@query("win08_cap_section_items", lines_sql(S.DIGEST, f"""X AS (SELECT *, regexp_matches(line, '^##\\s') AS is_head,
  sum(CASE WHEN regexp_matches(line, '^##\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM L),
 Y AS (SELECT *, max(CASE WHEN line = '## 背景速览' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec) AS digest,
  trim(line, {V.BLANKS}) <> '' AND NOT is_head AS filled FROM X),
 Z AS (SELECT *, sum(CASE WHEN filled THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM Y)""")
 + f"SELECT doc_id, string_agg(line, {NL} ORDER BY pos) AS capped FROM Z WHERE digest = 0 OR is_head OR (filled AND nth <= 3) GROUP BY doc_id")
def _(spark, sf):
    return text(spark, sf, S.DIGEST).select("doc_id", L.cap_digest("content").alias("capped"))


# ---- fences and box tables --------------------------------------------------------------------

FENCE = "sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"


@query("win10_fence_aware_sections", lines_sql(S.FENCED, f"""X AS (SELECT *, {FENCE} AS f FROM L),
 Y AS (SELECT *, f % 2 = 0 AND regexp_matches(line, '^#{{2,3}}\\s+.') AS is_head FROM X),
 Z AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS idx FROM Y)""") + f"""
 SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(coalesce(max(CASE WHEN is_head THEN length(regexp_extract(line, '^#+')) END), 0) AS BIGINT) AS level,
 coalesce(max(CASE WHEN is_head THEN regexp_replace(trim(regexp_replace(line, '^#+', '')), '[*`]', '', 'g') END), '') AS toc_text,
 md5(string_agg(line, {NL} ORDER BY pos)) AS h FROM Z GROUP BY doc_id, idx""")
def _(spark, sf):
    rows = text(spark, sf, S.FENCED).select("doc_id", F.inline(L.toc_sections("content")))
    return rows.select("doc_id", "idx", "level", "toc_text", F.md5("text").alias("h"))


@query("win11_box_table_runs", lines_sql(S.BOXED, f"""X AS (SELECT *, {FENCE} AS f FROM L),
 Y AS (SELECT *, f % 2 = 0 AND NOT starts_with(trim(line), '```') AND length(regexp_replace(line, '[^│┼├┤┬┴┃╋╂╞╡╪]', '', 'g')) >= 2 AS box FROM X),
 Z AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, box ORDER BY pos) AS isl FROM Y),
 R AS (SELECT *, count(*) OVER (PARTITION BY doc_id, box, isl) AS len, min(pos) OVER (PARTITION BY doc_id, box, isl) AS lo, max(pos) OVER (PARTITION BY doc_id, box, isl) AS hi FROM Z)""") + f"""
 SELECT doc_id, CAST(count(*) FILTER (box AND len >= 3 AND pos = lo) AS BIGINT) AS tables, string_agg(concat(
  CASE WHEN box AND len >= 3 AND pos = lo THEN concat('```text', {NL}) ELSE '' END, line,
  CASE WHEN box AND len >= 3 AND pos = hi THEN concat({NL}, '```') ELSE '' END), {NL} ORDER BY pos) AS wrapped FROM R GROUP BY doc_id""")
def _(spark, sf):
    return text(spark, sf, S.BOXED).select("doc_id", F.inline(F.array(L.box_tables("content"))))


# The packing once more, as a recursion over sections (kind S) and the paragraphs of sections that
# are too long (kind P); ``buf`` is the open chunk.
CHUNK_CHARS = 600
PACK = f"""X AS (SELECT *, sum(CASE WHEN pos > 0 AND regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM L),
 ST AS (SELECT doc_id, sec, string_agg(line, {NL} ORDER BY pos) AS t FROM X GROUP BY doc_id, sec),
 TOK AS (SELECT doc_id, sec, 1 AS j, 'S' AS kind, t FROM ST WHERE length(t) <= {CHUNK_CHARS} UNION ALL
  SELECT doc_id, sec, generate_subscripts(string_split(t, concat({NL}, {NL})), 1), 'P', unnest(string_split(t, concat({NL}, {NL}))) FROM ST WHERE length(t) > {CHUNK_CHARS}),
 NUM AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, j) AS k, lag(kind) OVER (PARTITION BY doc_id ORDER BY sec, j) AS before FROM TOK),
 RUN AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, '' AS buf, CAST([] AS VARCHAR[]) AS out FROM documents UNION ALL
  SELECT doc_id, k, substr(joined, CAST(cuts * {CHUNK_CHARS} + 1 AS BIGINT)), list_concat(list_concat(out, CASE WHEN emit THEN [buf] ELSE CAST([] AS VARCHAR[]) END),
   list_transform(range(0, cuts), lambda i: substr(joined, i * {CHUNK_CHARS} + 1, {CHUNK_CHARS}))) FROM (
   SELECT *, CASE WHEN kind = 'P' AND length(joined) > {CHUNK_CHARS} THEN (length(joined) - 1) // {CHUNK_CHARS} ELSE 0 END AS cuts FROM (
    SELECT *, CASE WHEN emit OR buf = '' THEN t ELSE concat(buf, CASE kind WHEN 'S' THEN {NL} ELSE concat({NL}, {NL}) END, t) END AS joined FROM (
     SELECT RUN.doc_id, NUM.k, NUM.kind, NUM.t, RUN.buf, RUN.out, RUN.buf <> '' AND ((kind = 'S' AND (before = 'P' OR length(buf) + length(t) + 1 > {CHUNK_CHARS}))
      OR (kind = 'P' AND (j = 1 OR length(buf) + length(t) + 2 > {CHUNK_CHARS}))) AS emit
     FROM RUN JOIN NUM ON NUM.doc_id = RUN.doc_id AND NUM.k = RUN.k + 1)))),
 LAST AS (SELECT doc_id, list_filter(list_append(out, buf), lambda c: trim(c, {V.BLANKS}) <> '') AS cs FROM RUN QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)"""


@query("win16_chunk_by_heading", with_(V.lines(S.HEADED), PACK, recursive=True) + """SELECT doc_id, CAST(chunk - 1 AS BIGINT) AS chunk, CAST(length(c) AS BIGINT) AS chars, md5(c) AS h
 FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS chunk FROM LAST)""")
def _(spark, sf):
    return text(spark, sf, S.HEADED).select(
        "doc_id", F.posexplode(L.chunks("content", CHUNK_CHARS)).alias("chunk", "t")).select(
        "doc_id", "chunk", F.length("t").alias("chars"), F.md5("t").alias("h"))


# ---- scalar functions over lines --------------------------------------------------------------

@query("sca02_norm_heading", lines_sql(S.HEADED) + f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, lower(replace(replace(regexp_replace(trim(line, {V.BLANKS}), '^#+\\s*', ''), '：', ':'), ' ', '')) AS key
 FROM L WHERE regexp_matches(line, '^#{{1,6}} ')""")
def _(spark, sf):
    rows = text(spark, sf, S.HEADED).select("doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike("^#{1,6} ")).select("doc_id", "pos", T.norm_heading("line").alias("key"))


@query("sca02_unnumbered", lines_sql(S.HEADED) + f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, lower(replace(replace(trim(substr(line, 4), {V.BLANKS}), '：', ':'), ' ', '')) AS bare FROM L WHERE length(line) > 3""")
def _(spark, sf):
    rows = text(spark, sf, S.HEADED).select("doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    key = T.norm_heading(F.concat(F.lit("##  模块"), F.col("pos").cast("string"), F.lit("："), F.substr("line", F.lit(4))))
    return rows.where(F.length("line") > 3).select("doc_id", "pos", T.unnumbered(key).alias("bare"))


@query("src06_url_list_read", """WITH X AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN concat('#', line) WHEN pos % 4 = 1 THEN concat('  # ', line) WHEN pos % 4 = 2 THEN '  ' ELSE line END AS v
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))
 SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(v) AS value FROM X WHERE trim(v) <> '' AND NOT starts_with(v, '#')""")
def _(spark, sf):
    rows = S.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.selectExpr("doc_id", "pos", "CASE pos % 4 WHEN 0 THEN concat('#', line) WHEN 1 THEN concat('  # ', line) WHEN 2 THEN '  ' ELSE line END AS value")
    return logs.url_list(rows)


@query("sca11_details_split", lines_sql(S.FOLDED) + r"""SELECT doc_id, regexp_replace(content, '(?s)\n?<details>.*?</details>\s*', chr(10), 'g') AS main,
 CAST(len(regexp_extract_all(content, '(?s)\n?<details>.*?</details>\s*')) AS BIGINT) AS n_blocks,
 array_to_string(list_transform(regexp_extract_all(content, '(?s)\n?<details>.*?</details>\s*'), lambda x: trim(x, """ + V.BLANKS + """)), '|') AS blocks FROM LT""")
def _(spark, sf):
    parts = L.split_details("content")
    return text(spark, sf, S.FOLDED).select("doc_id", parts["main"].alias("main"), F.size(parts["blocks"]).alias("n_blocks"),
                                            F.array_join(parts["blocks"], "|").alias("blocks"))


@query("agg17_ordered_merge", with_(V.lines(S.HEADED)) + "SELECT doc_id, md5(content) AS h FROM LT")
def _(spark, sf):
    parts = text(spark, sf, S.HEADED).select("doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return G.merge_parts(parts, "doc_id", "pos", "line", "\n").select("doc_id", F.md5("merged").alias("h"))


# ---- state panel and section bodies -----------------------------------------------------------

def section_sql(head: str, stop: str = "^## ") -> str:
    return f"""H AS (SELECT doc_id, min(pos) AS h FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS top FROM L) WHERE line = '{head}' AND pos < top GROUP BY doc_id),
 E AS (SELECT H.doc_id, h, coalesce(min(pos), 1000000) AS e FROM H LEFT JOIN L ON L.doc_id = H.doc_id AND pos > h AND regexp_matches(line, '{stop}') GROUP BY H.doc_id, h),
 B AS (SELECT L.doc_id, pos, line, h, e FROM L JOIN E ON L.doc_id = E.doc_id AND pos >= h AND pos < e)"""


HEAD = "## ⚔️ Battle 记录"


@query("sca12_md_table_rows", lines_sql(S.BATTLED, section_sql(HEAD)) + """SELECT doc_id, trim(split_part(line, '|', 2)) AS assumption, trim(split_part(line, '|', 3)) AS verification, trim(split_part(line, '|', 4)) AS risk
 FROM B WHERE pos = h + 5 AND starts_with(line, '|')""")
def _(spark, sf):
    rows = text(spark, sf, S.BATTLED).select("doc_id", F.explode(U.table_rows(U.section_text("content", U.BATTLE), "关键假设")).alias("r"))
    return rows.select("doc_id", F.get("r", F.lit(0)).alias("assumption"), F.get("r", F.lit(1)).alias("verification"), F.get("r", F.lit(2)).alias("risk"))


@query("sca13_state_panel", lines_sql(S.BATTLED, section_sql(HEAD)) + """SELECT doc_id, coalesce(max(CASE WHEN starts_with(line, '**观点状态') THEN 'Monitoring' END), '') AS status,
 max(CASE WHEN starts_with(line, '**观点状态') THEN CAST(regexp_extract(line, '置信度 (\\d+)%', 1) AS BIGINT) END) AS conf_from,
 max(CASE WHEN starts_with(line, '**观点状态') THEN CAST(regexp_extract(line, '→ (\\d+)%', 1) AS BIGINT) END) AS conf_to,
 coalesce(max(CASE WHEN starts_with(line, '**Core Belief**：') THEN trim(substr(line, 17)) END), '') AS core_belief,
 coalesce(max(CASE WHEN starts_with(line, '**反向世界**：') THEN trim(regexp_extract(line, '：(.*?)（当前', 1)) END), '') AS counter_world,
 CAST(count(*) FILTER (pos = h + 5) AS BIGINT) AS n_assumptions FROM B GROUP BY doc_id""")
def _(spark, sf):
    rows = U.state_panels(text(spark, sf, S.BATTLED), "doc_id")
    return rows.select("doc_id", "panel.status", "panel.conf_from", "panel.conf_to", "panel.core_belief",
                       "panel.counter_world", F.size("panel.assumptions").alias("n_assumptions"))


def body_sql(name: str, head: str) -> str:
    return f"""{name}1 AS (SELECT doc_id, min(pos) AS h FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS top FROM L) WHERE regexp_matches(line, '{head}') AND pos < top GROUP BY doc_id),
 {name}2 AS (SELECT x.doc_id, h, coalesce(min(pos), 1000000) AS e FROM {name}1 x LEFT JOIN L ON L.doc_id = x.doc_id AND pos > h AND regexp_matches(line, '^#{{2,4}} ') GROUP BY x.doc_id, h),
 {name} AS (SELECT L.doc_id, left(trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), '\\s+', ' ', 'g')), 400) AS body,
   list(regexp_extract(line, '^\\| \\*\\*(v\\d+)', 1) ORDER BY pos) AS names FROM L JOIN {name}2 x ON L.doc_id = x.doc_id AND pos > h AND pos < e GROUP BY L.doc_id)"""


@query("sca14_section_body", lines_sql(S.FILED, body_sql("ST", "^#{2,4}.*行业阶段"), body_sql("CO", "^#{2,4}.*行业坐标"), body_sql("VA", "^#{2,4}.*(核心变量|关键变量)"),
 "VN AS (SELECT doc_id, list_filter(names, lambda x: x <> '') AS n FROM VA)") + """
 SELECT d.doc_id, coalesce(ST.body, '') AS stage, coalesce(CO.body, '') AS position,
  coalesce(array_to_string(CASE WHEN len(n) > 1 THEN n[2:6] ELSE n END, ','), '') AS variables
 FROM documents d LEFT JOIN ST ON ST.doc_id = d.doc_id LEFT JOIN CO ON CO.doc_id = d.doc_id LEFT JOIN VN ON VN.doc_id = d.doc_id""")
def _(spark, sf):
    snap = U.industry_snapshot("content")
    return text(spark, sf, S.FILED).select("doc_id", snap["stage"].alias("stage"), snap["position"].alias("position"),
                                           F.array_join(snap["variables"], ",").alias("variables"))


# ---- updates ----------------------------------------------------------------------------------

def updates(spark, sf):
    return S.table(spark, sf, "labels").selectExpr(
        "doc_id", "concat('## ⚔️ Battle 记录', chr(10), chr(10), 'quality ', CAST(quality AS STRING), chr(10), chr(10)) AS section",
        "concat('#### 2024-02-01', chr(10), '- toxic ', CAST(toxic AS STRING)) AS entry", "toxic", "quality")


UP = f"""UPD AS (SELECT doc_id, concat('## ⚔️ Battle 记录', {NL}, {NL}, 'quality ', CAST(quality AS VARCHAR), {NL}, {NL}) AS section,
 concat('#### 2024-02-01', {NL}, '- toxic ', CAST(toxic AS VARCHAR)) AS entry, toxic, quality FROM labels),
 PARTS AS (SELECT L.doc_id, max(h) AS h, coalesce(string_agg(CASE WHEN pos < h THEN concat(line, {NL}) END, '' ORDER BY pos), '') AS pre,
  coalesce(string_agg(CASE WHEN pos >= e THEN line END, {NL} ORDER BY pos), '') AS post,
  string_agg(line, {NL} ORDER BY pos) AS whole FROM L LEFT JOIN E ON E.doc_id = L.doc_id GROUP BY L.doc_id)"""


@query("upd01_section_upsert", lines_sql(S.BATTLED, section_sql(HEAD), UP) + f"""SELECT doc_id, md5(CASE WHEN h IS NULL THEN concat(rtrim(whole, {V.BLANKS}), {NL}, {NL}, '---', {NL}, {NL}, section, {NL})
 ELSE concat(pre, rtrim(section, {V.BLANKS}), {NL}, {NL}, ltrim(post, {NL})) END) AS h FROM PARTS JOIN UPD USING (doc_id)""")
def _(spark, sf):
    out = U.update_docs(text(spark, sf, S.BATTLED), updates(spark, sf), "doc_id",
                        lambda c: U.upsert(c, U.BATTLE, F.col("section")))
    return out.select("doc_id", F.md5("content").alias("h"))


@query("upd02_log_prepend", lines_sql(S.BATTLED, section_sql(HEAD), UP, f"""LOGS AS (SELECT *, sum(CASE WHEN starts_with(line, '#### ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM B),
 OLD1 AS (SELECT doc_id, g, trim(string_agg(line, {NL} ORDER BY pos), {V.BLANKS}) AS t FROM LOGS WHERE g > 0 GROUP BY doc_id, g),
 OLD AS (SELECT doc_id, string_agg(t, concat({NL}, {NL}) ORDER BY g) AS old FROM OLD1 GROUP BY doc_id)""") + f"""
 SELECT doc_id, CASE WHEN h IS NULL THEN concat(rtrim(whole, {V.BLANKS}), {NL}, {NL}, '---', {NL}, {NL}, section, entry, {NL})
 ELSE concat(pre, rtrim(concat(section, entry, {NL}, {NL}, coalesce(old, '')), {V.BLANKS}), {NL}, {NL}, ltrim(post, {NL})) END AS content
 FROM PARTS JOIN UPD USING (doc_id) LEFT JOIN OLD USING (doc_id)""")
def _(spark, sf):
    return U.update_docs(text(spark, sf, S.BATTLED), updates(spark, sf), "doc_id", lambda c: U.prepend_log(
        c, U.BATTLE, F.col("section"), F.col("entry"))).select("doc_id", "content")


POS_ROW = "concat('| d', CAST(doc_id AS {s}), ' | q', CAST(quality AS {s}), ' |')"


@query("upd03_table_row_append", lines_sql(S.FILED, """G AS (SELECT L.*, labels.quality FROM L JOIN labels ON L.doc_id = labels.doc_id),
 T AS (SELECT doc_id, max(pos) AS top FROM G GROUP BY doc_id)""") + f"""SELECT doc_id, md5(string_agg(CASE
  WHEN pos = 6 AND doc_id % 2 = 0 THEN {POS_ROW.format(s='VARCHAR')}
  WHEN pos = least(6, top) AND doc_id % 2 = 1 OR pos = least(5, top) AND top < 6 THEN concat(line, {NL}, {POS_ROW.format(s='VARCHAR')}) ELSE line END, {NL} ORDER BY pos)) AS h
 FROM G JOIN T USING (doc_id) WHERE top >= 4 GROUP BY doc_id""")
def _(spark, sf):
    out = U.update_docs(text(spark, sf, S.FILED), updates(spark, sf), "doc_id", lambda c: U.append_row(
        c, "行业坐标", F.expr(POS_ROW.format(s="STRING"))))
    return out.select("doc_id", F.md5("content").alias("h"))


@query("upd04_archive_prepend", lines_sql(S.FILED, f"""G AS (SELECT L.*, entry, max(pos) OVER (PARTITION BY L.doc_id) AS top FROM L JOIN (SELECT doc_id,
  concat('#### 2024-02-01', {NL}, '- toxic ', CAST(toxic AS VARCHAR)) AS entry FROM labels) u ON u.doc_id = L.doc_id),
 N AS (SELECT doc_id, min(CASE WHEN pos > 8 AND regexp_matches(line, '^#{{2,3}} ') THEN pos END) AS nxt,
  coalesce(bool_or(contains(line, '####')) FILTER (pos > 8 AND pos < 11), false) AS logs FROM G GROUP BY doc_id)""") + f"""
 SELECT doc_id, md5(CASE WHEN max(top) < 8 THEN concat(rtrim(string_agg(line, {NL} ORDER BY pos), {V.BLANKS}), {NL}, {NL}, '### 新项目评审留档', {NL}, {NL}, any_value(entry), {NL})
  WHEN bool_or(logs) THEN string_agg(CASE WHEN pos = 8 THEN concat(line, {NL}, {NL}, entry, {NL}) ELSE line END, {NL} ORDER BY pos)
  ELSE concat(string_agg(CASE WHEN pos <= 8 THEN line END, {NL} ORDER BY pos), {NL}, {NL}, any_value(entry), {NL}, {NL},
   coalesce(string_agg(CASE WHEN pos >= nxt THEN line END, {NL} ORDER BY pos), '')) END) AS h
 FROM G JOIN N USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    return U.update_docs(text(spark, sf, S.FILED), updates(spark, sf), "doc_id", lambda c: U.prepend_archive(
        c, F.col("entry"))).select("doc_id", F.md5("content").alias("h"))


@query("upd05_header_date", lines_sql(S.FILED) + f"""SELECT doc_id, max(pos) >= 1 AS found, md5(string_agg(CASE WHEN pos = 1 THEN '> **更新日期**：2024-02-01' ELSE line END, {NL} ORDER BY pos)) AS h FROM L GROUP BY doc_id""")
def _(spark, sf):
    dated = text(spark, sf, S.FILED).withColumn("dated", U.set_header_date(F.col("content"), "2024-02-01"))
    return dated.select("doc_id", F.col("dated").isNotNull().alias("found"), F.md5(F.coalesce("dated", "content")).alias("h"))


@query("upd06_update_report", lines_sql(S.FILED, "T AS (SELECT doc_id, max(pos) AS top FROM L GROUP BY doc_id)") + """SELECT doc_id, top >= 1 AS ok_date, top >= 4 AS ok_position,
 false AS ok_variables, top >= 8 AS ok_archive FROM T JOIN labels USING (doc_id)""")
def _(spark, sf):
    done = U.update_industries(text(spark, sf, S.FILED), updates(spark, sf), "doc_id", "2024-02-01",
                               F.expr(POS_ROW.format(s="STRING")), [F.lit("| v | w |")], F.col("entry"))
    return done.select("doc_id", "ok_date", "ok_position", "ok_variables", "ok_archive")


@query("upd06_change_preview", lines_sql(S.BATTLED, section_sql(HEAD)) + """SELECT l.doc_id, target, CASE WHEN target = 'date' OR (target = 'section' AND h IS NOT NULL) THEN 'mod' ELSE 'add' END AS action,
 CAST(CASE WHEN target = 'variables' THEN toxic + quality ELSE 1 END AS BIGINT) AS n
 FROM labels l LEFT JOIN H ON H.doc_id = l.doc_id, (VALUES ('section'), ('position'), ('variables'), ('archive'), ('date')) t(target)
 WHERE target <> 'variables' OR toxic + quality > 0""")
def _(spark, sf):
    u = updates(spark, sf).withColumn("n_variables", F.col("toxic") + F.col("quality")).select("doc_id", "n_variables")
    return U.change_preview(text(spark, sf, S.BATTLED), u, "doc_id", U.BATTLE).select("doc_id", "target", "action", "n")


# ---- images -----------------------------------------------------------------------------------

IMAGES = "array('p1_1.png', 'x2.png', 'p9_9.png', 'x0.png')"
REFS = """REF AS (SELECT DISTINCT doc_id, unnest(CASE WHEN pos % 3 = 1 THEN [concat('p', CAST(pos % 4 AS VARCHAR), '_1.png'), concat('x', CAST(pos % 5 AS VARCHAR), '.png')] ELSE [] END) AS img FROM L)"""


def imaged(spark, sf):
    return text(spark, sf, S.IMAGED).withColumn("images", F.expr(IMAGES))


@query("joi14_asset_refs", lines_sql(S.IMAGED) + """SELECT doc_id, string_agg(CASE WHEN pos % 3 = 1 THEN concat(orig, CASE WHEN pos % 4 = 1 THEN '![p.1 图表](img/p1_1.png)' ELSE concat('[[图:p', CAST(pos % 4 AS VARCHAR), '_1.png]]') END, ' tail ',
 CASE WHEN pos % 5 IN (0, 2) THEN concat('![ 图表](img/x', CAST(pos % 5 AS VARCHAR), '.png)') ELSE concat('[[图： x', CAST(pos % 5 AS VARCHAR), '.png ]]') END) ELSE line END, chr(10) ORDER BY pos) AS content
 FROM (SELECT *, CASE WHEN pos % 3 = 1 THEN left(line, length(line) - length(concat('[[图:p', CAST(pos % 4 AS VARCHAR), '_1.png]] tail [[图： x', CAST(pos % 5 AS VARCHAR), '.png ]]'))) END AS orig FROM L) GROUP BY doc_id""")
def _(spark, sf):
    return imaged(spark, sf).select("doc_id", U.inline_images(F.col("content"), F.col("images"), F.lit("img")).alias("content"))


@query("set04_unused_assets", lines_sql(S.IMAGED, REFS) + """SELECT doc_id, img FROM documents, (VALUES ('p1_1.png'), ('x2.png'), ('p9_9.png'), ('x0.png')) t(img)
 WHERE NOT EXISTS (SELECT 1 FROM REF WHERE REF.doc_id = documents.doc_id AND REF.img = t.img)""")
def _(spark, sf):
    return imaged(spark, sf).select("doc_id", F.explode(U.unused_images("content", "images")).alias("img"))


# ---- pages ------------------------------------------------------------------------------------

PQ = with_(V.P)
LIMIT = 5
BREAK = """BR AS (SELECT doc_id, page FROM (SELECT doc_id, page, unnest(string_split(page_text, chr(10))) AS s, generate_subscripts(string_split(page_text, chr(10)), 1) AS i FROM P)
 WHERE i <= 6 AND length(trim(s)) BETWEEN 1 AND 40 AND NOT regexp_matches(trim(s), '(\\.{4,}|…{2,}|·{4,})\\s*\\d+\\s*$')
 AND (regexp_matches(trim(s), '^第[一二三四五六七八九十百零\\d]+[章节篇部分]') OR regexp_matches(trim(s), '^#{1,6}\\s+\\S')
  OR regexp_matches(trim(s), '^[一二三四五六七八九十]+、\\S') OR regexp_matches(trim(s), '^\\d+(\\.\\d+){0,2}[、.．\\s]\\s*\\S')) GROUP BY doc_id, page)"""
PLAN = f"""NP AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM P GROUP BY doc_id),
 PLAN AS (SELECT doc_id, n, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS s, coalesce((SELECT max(page) FROM BR WHERE BR.doc_id = NP.doc_id AND page > 0 AND page < least({LIMIT}, n)), least({LIMIT}, n)) AS e FROM NP
  UNION ALL SELECT doc_id, n, chunk + 1, e, coalesce((SELECT max(page) FROM BR WHERE BR.doc_id = PLAN.doc_id AND page > PLAN.e AND page < least(PLAN.e + {LIMIT}, n)), least(e + {LIMIT}, n)) FROM PLAN WHERE e < n)"""
CHUNK = "CH AS (SELECT PLAN.doc_id, chunk, s, e, sum(length(page_text)) / (e - s) >= 100 AS text_layer, string_agg(page_text, chr(10) ORDER BY page) AS raw FROM PLAN JOIN P ON P.doc_id = PLAN.doc_id AND page >= s AND page < e GROUP BY PLAN.doc_id, chunk, s, e)"
CQ = with_(V.P, BREAK, PLAN, CHUNK, recursive=True)


@query("win14_page_breaks", with_(V.P, BREAK) + "SELECT doc_id, page FROM BR")
def _(spark, sf):
    return G.page_breaks(S.doc_pages(spark, sf), "doc_id")


@query("win15_plan_page_chunks", CQ + 'SELECT doc_id, chunk, s AS "start", e AS "end" FROM PLAN')
def chunk_plan(spark, sf):
    return G.chunk_plan(S.doc_pages(spark, sf), "doc_id", LIMIT).select("doc_id", "chunk", "start", "end")


@query("agg18_text_density", CQ + "SELECT doc_id, chunk, text_layer FROM CH")
def _(spark, sf):
    return G.chunk_plan(S.doc_pages(spark, sf), "doc_id", LIMIT).select("doc_id", "chunk", "text_layer")


CONV = """CV AS (SELECT *, CASE WHEN NOT text_layer AND doc_id % 3 = 0 THEN 'vlm' WHEN (doc_id + chunk) % 4 = 0 THEN 'pymupdf4llm' WHEN (doc_id + chunk) % 4 = 1 THEN 'pdfplumber' END AS eng FROM CH)"""
VQ = with_(V.P, BREAK, PLAN, CHUNK, CONV, recursive=True)


def converted(spark, sf):
    """Engines as columns: each yields text for some chunks and blanks for others."""
    plan = G.chunk_plan(S.doc_pages(spark, sf), "doc_id", LIMIT)
    n = (F.col("doc_id") + F.col("chunk")) % 4
    return G.convert(plan, {
        "vlm": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("v "), F.col("doc_id").cast("string"))).otherwise(""),
        "pymupdf4llm": F.when(n == 0, "m text").otherwise(" \n"),
        "pdfplumber": F.when(n == 1, "p text")}, vision="vlm")


@query("udf03_tiered_fallback", VQ + """SELECT doc_id, chunk, coalesce(eng, 'pypdf') AS engine, md5(CASE eng WHEN 'vlm' THEN concat('v ', CAST(doc_id AS VARCHAR)) WHEN 'pymupdf4llm' THEN 'm text'
 WHEN 'pdfplumber' THEN 'p text' ELSE raw END) AS h, eng IS NULL AS degraded FROM CV""")
def _(spark, sf):
    return converted(spark, sf).select("doc_id", "chunk", "engine", F.md5("text").alias("h"), "degraded")


@query("agg15_engine_counts", VQ + "SELECT coalesce(eng, 'pypdf') AS engine, CAST(count(*) AS BIGINT) AS chunks FROM CV GROUP BY 1")
def _(spark, sf):
    return G.engine_counts(converted(spark, sf))


@query("agg15_degraded_pages", VQ + "SELECT doc_id, unnest(range(s + 1, e + 1)) AS page FROM CV WHERE eng IS NULL")
def _(spark, sf):
    return G.degraded_pages(converted(spark, sf), "doc_id")


@query("agg17_assemble_chunks", VQ + f"""SELECT doc_id, md5(concat(trim(string_agg(concat('<!-- p.', CAST(s + 1 AS VARCHAR), '-', CAST(e AS VARCHAR), ' · engine:', coalesce(eng, 'pypdf'), ' -->', {NL}, {NL},
 trim(CASE eng WHEN 'vlm' THEN concat('v ', CAST(doc_id AS VARCHAR)) WHEN 'pymupdf4llm' THEN 'm text' WHEN 'pdfplumber' THEN 'p text' ELSE raw END, {V.BLANKS})), concat({NL}, {NL}) ORDER BY chunk), {V.BLANKS}), {NL})) AS h FROM CV GROUP BY doc_id""")
def _(spark, sf):
    return G.assemble(converted(spark, sf), "doc_id").select("doc_id", F.md5("markdown").alias("h"))


# ---- web pages --------------------------------------------------------------------------------

HTML = """concat(CASE page_id % 3 WHEN 0 THEN concat('<meta property="og:title" content=" T&amp;T ', CAST(page_id AS {s}), ' ">') WHEN 1 THEN concat('<meta content="A', CAST(page_id AS {s}), '" name="author">') ELSE '' END,
 CASE WHEN page_id % 4 = 0 THEN concat('<script>var nickname = htmlDecode("N ', CAST(page_id AS {s}), '"); var ct = "', CAST(1700000000 + page_id * 86400 AS {s}), '";</script>') ELSE '' END, html)"""


def unescape_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def strip_sql(x: str, sep: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({unescape_sql(f'regexp_replace({x}, $$<[^>]+>$$, {NL}, $$g$$)')}, {NL}), "
            f"lambda s: trim(s, {V.BLANKS})), lambda s: s <> ''), {sep})")


@query("src07_html_article_extract", f"""WITH X AS (SELECT page_id, {HTML.format(s='VARCHAR')} AS p FROM pages),
 Y AS (SELECT *, regexp_extract(p, '(?s)<article>(.*?)</article>', 1) AS frag, regexp_extract(p, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM X)
 SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('T&T ', CAST(page_id AS VARCHAR)) ELSE {strip_sql('h1', "' '")} END AS title,
 CASE WHEN page_id % 4 = 0 THEN concat('N ', CAST(page_id AS VARCHAR)) WHEN page_id % 3 = 1 THEN concat('A', CAST(page_id AS VARCHAR)) ELSE '' END AS account,
 CASE WHEN page_id % 4 = 0 THEN CAST(CAST(to_timestamp(1700000000 + page_id * 86400) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) ELSE '' END AS date,
 {strip_sql("regexp_replace(regexp_replace(frag, $$(?s)<script.*?</script>$$, '', 'g'), $$(?s)<style.*?</style>$$, '', 'g')", NL)} AS text FROM Y""")
def _(spark, sf):
    page = F.expr(HTML.format(s="STRING"))
    parts = A.article(page, heading=r"<h1[^>]*>", body_start=r"<article>", body_end=r"</article>")
    return S.web_pages(spark, sf).select("page_id", *[c.alias(n) for n, c in parts.items()])
