"""The derived tables once more, as SQL text for the oracle engine."""

KEY = "CASE WHEN doc_id % 50 = 0 THEN '' ELSE source END"

CATEGORY_ROWS = [
    ("src0", "行业认知"), ("src1", "项目解剖"), ("src2", "方法论"), ("src3", "横向比较"), ("src4", "动态追踪"),
    ("src5", "投资策略"), ("src6", "经验沉淀"), ("src7", "被投基金"), ("src8", "技术沉淀"),
]
_CATS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_ROWS)

K = f"""K AS (SELECT d.doc_id, {KEY} AS category_key,
 concat('d', lpad(CAST(d.doc_id AS VARCHAR), 8, '0'), '.md') AS name,
 concat(CASE WHEN doc_id % 50 = 0 THEN '' ELSE concat(source, '/') END, 'd', lpad(CAST(d.doc_id AS VARCHAR), 8, '0'), '.md') AS path,
 left(split_part(d.text, chr(10), 1), 60) AS title,
 concat('2024-', lpad(CAST(1 + (d.doc_id * 31) % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + (d.doc_id * 17) % 28 AS VARCHAR), 2, '0'), 'T00:00:00') AS modified,
 d.n_chars AS size, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE concat('P', CAST(d.doc_id % 97 AS VARCHAR)) END AS project,
 [d.lang, concat('t', CAST(d.doc_id % 7 AS VARCHAR))] AS tags,
 left(split_part(d.text, chr(10), 2), 40) AS subtitle,
 CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE concat('2024-0', CAST(1 + d.doc_id % 9 AS VARCHAR), '-11') END AS last_updated,
 d.lang, d.text AS content,
 CASE {KEY} {_CATS} ELSE '其他' END AS category,
 (SELECT CASE WHEN l.toxic = 1 THEN '推进中' WHEN l.quality = 1 THEN '已投资' WHEN l.quality = 0 THEN '已放弃' END
    FROM labels l WHERE l.doc_id = d.doc_id) AS label_status
FROM documents d),
KT AS (SELECT *, coalesce(label_status, '跟踪中') AS status,
 CASE WHEN contains(concat(name, ' ', title), 'che') THEN 'T1' WHEN contains(concat(name, ' ', title), 'tion') THEN 'T2'
      WHEN contains(concat(name, ' ', title), 'ent') THEN 'T3' ELSE '未分类' END AS track FROM K)"""

S = """S AS (SELECT event_id AS seq,
 CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 43 = 0 THEN '本周' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
 event_type AS theme,
 CASE event_id % 3 WHEN 0 THEN upper(concat(event_type, ' user ', CAST(user_id AS VARCHAR)))
      WHEN 1 THEN concat(event_type, '  user_', CAST(user_id AS VARCHAR), '！')
      ELSE concat(event_type, '-user-', CAST(user_id AS VARCHAR)) END AS title,
 CASE event_id % 5 WHEN 0 THEN '产业信息' WHEN 1 THEN '资本信息' WHEN 2 THEN '投资人观点' ELSE '小道消息' END AS source_type,
 user_id AS sub_query FROM events),
SK AS (SELECT *, lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g')) AS key FROM S)"""

C = """C AS (SELECT event_id AS seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS feature,
 CASE user_id % 4 WHEN 0 THEN 'kimi-k2.6' WHEN 1 THEN 'deepseek-chat' WHEN 2 THEN 'qwen-plus' ELSE 'mystery-1' END AS model,
 CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens
FROM events),
CP AS (SELECT *, round(CAST(CASE model WHEN 'kimi-k2.6' THEN prompt_tokens * 4.0 + completion_tokens * 21.0
  WHEN 'deepseek-chat' THEN prompt_tokens * 2.0 + completion_tokens * 8.0
  WHEN 'qwen-plus' THEN prompt_tokens * 0.8 + completion_tokens * 2.0 ELSE 0 END AS DECIMAL(28,4)) * 0.000001, 4) AS cost FROM C)"""

N = """N AS (SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS theme, o_orderkey AS seq,
 CAST(CAST(DATE '2024-01-01' + CAST(o_orderkey % 45 AS INTEGER) AS DATE) AS VARCHAR) AS date,
 CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderstatus END AS narrative, o_orderpriority AS trig FROM orders),
NH AS (SELECT theme, seq, date, coalesce(prev, '（首次建立）') AS previous, narrative AS new_narrative,
  CASE WHEN prev IS NULL THEN '' ELSE trig END AS trig, prev IS NULL AS is_transition
 FROM (SELECT *, lag(narrative) OVER (PARTITION BY theme ORDER BY seq) AS prev FROM N WHERE trim(narrative) <> '')
 WHERE prev IS NULL OR prev <> narrative)"""

NV = """NV AS (SELECT l_orderkey AS seq, CAST(CAST(DATE '2024-01-01' + CAST(l_orderkey % 45 AS INTEGER) AS DATE) AS VARCHAR) AS date,
 concat('p', CAST(l_partkey AS VARCHAR)) AS title, l_linestatus AS theme,
 CASE l_returnflag WHEN 'A' THEN 'Demand' WHEN 'R' THEN 'Capital' ELSE 'Technology' END AS var_type FROM lineitem)"""

WL = """WL AS (SELECT c_custkey AS pos, concat('c', CAST(c_custkey AS VARCHAR)) AS theme,
 CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled, c_custkey % 2 = 0 AS is_primary,
 concat(c_mktsegment, ' news') AS query, CASE WHEN c_custkey % 3 = 0 THEN [c_name, '', c_mktsegment] END AS sub_queries FROM customer)"""

J = """J AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
 CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS started,
 CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS DATE) AS VARCHAR) END AS finished,
 o_orderkey % 1200 AS idle_secs, o_orderkey % 29 = 0 AS cancel, ['radar', 'tech', 'review', 'ingest', 'battle'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS kind FROM orders),
JS AS (SELECT l_orderkey AS job, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS label,
 CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'error' ELSE 'running' END AS step_status,
 CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_quantity / 32 END AS frac,
 CAST(l_quantity AS BIGINT) AS total, CAST(floor(l_quantity * (0.5 + l_tax * 10)) AS BIGINT) AS done FROM lineitem)"""

M = """M AS (SELECT conv_id, turn, role,
 CASE WHEN role = 'assistant' AND turn % 5 <> 0 THEN concat(text, '【Step ', CAST(turn % 6 + 1 AS VARCHAR), ' · x】')
      WHEN role = 'user' AND (conv_id + turn) % 7 = 0 THEN concat(text, ' 今天先到这里') ELSE text END AS content
 FROM conversations)"""


def lines(rewrite: str) -> str:
    """Lines (doc_id, pos, line) of the documents after a rewrite over (line, pos)."""
    return f"""L AS (SELECT doc_id, source, lang, pos, {rewrite} AS line FROM (
 SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
LT AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM L GROUP BY doc_id)"""


P = """P AS (SELECT doc_id, CAST(pos // 2 AS BIGINT) AS page, CASE WHEN (pos // 2) % 9 = 8 THEN '' ELSE concat(
  CASE WHEN (pos // 2) % 7 = 2 THEN concat('第', CAST(pos // 2 AS VARCHAR), '章 x', chr(10))
       WHEN (pos // 2) % 7 = 5 THEN concat('1. Industry ...... ', CAST(pos // 2 AS VARCHAR), chr(10)) ELSE '' END,
  string_agg(line, chr(10) ORDER BY pos)) END AS page_text
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) GROUP BY doc_id, pos // 2)"""

# Characters str.strip() removes, as far as they occur in the data.
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(12288), chr(160))"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
