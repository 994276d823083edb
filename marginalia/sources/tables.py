"""The project's tables, derived from the provided parquet files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out by a unique key into as many parts as ``marginalia.input.partitions`` says;
    without the setting the input keeps its own splits. It is meant for runs on one file of a single
    row group, such as the benchmark's, and never depends on the data."""
    parts = df.sparkSession.conf.get("marginalia.input.partitions", None)
    return df.repartition(int(parts), key) if parts else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant dimension as a local relation: it is part of the plan, so its size is known."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(lit(x) for x in v)})"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = [part.strip().split(None, 1) for part in re.split(r",(?![^(<]*[)>])", schema)]
    names, types = [p[0] for p in parts], [p[1] for p in parts]
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    cols = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True))
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(names)})")


# ---- K: corpus --------------------------------------------------------------------------------

def kb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus table without the status; root files have the empty category key."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 50 = 0 THEN '' ELSE source END AS category_key",
        "concat('d', lpad(CAST(doc_id AS STRING), 8, '0'), '.md') AS name",
        "concat(CASE WHEN doc_id % 50 = 0 THEN '' ELSE concat(source, '/') END, 'd', "
        "lpad(CAST(doc_id AS STRING), 8, '0'), '.md') AS path",
        "left(substring_index(text, '\\n', 1), 60) AS title",
        "concat('2024-', lpad(CAST(1 + (doc_id * 31) % 12 AS STRING), 2, '0'), '-', "
        "lpad(CAST(1 + (doc_id * 17) % 28 AS STRING), 2, '0'), 'T00:00:00') AS modified",
        "n_chars AS size",
        "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('P', CAST(doc_id % 97 AS STRING)) END AS project",
        "array(lang, concat('t', CAST(doc_id % 7 AS STRING))) AS tags",
        "left(split_part(text, '\\n', 2), 40) AS subtitle",
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('2024-0', CAST(1 + doc_id % 9 AS STRING), '-11') END"
        " AS last_updated",
        "lang",
        "text AS content",
    )


def with_status(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add raw and normalised status from the labels, joined on the unique document id."""
    raw = table(spark, sf_dir, "labels").selectExpr(
        "doc_id",
        "CASE WHEN toxic = 1 THEN '尽调中' WHEN quality = 1 THEN '已投资' WHEN quality = 0 THEN 'Pass' END AS raw")
    joined = docs.join(raw, "doc_id", "left").withColumn("status_raw", F.coalesce("raw", F.lit(""))).drop("raw")
    return joined.withColumn("status", M.normalize_status("status_raw"))


FRONT = """concat(
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('# ', title, chr(10)) END,
 '> ', category_key, ' brief', chr(10), '> **note** skip', chr(10), '> ', lang, ' second', chr(10), '> third', chr(10),
 CASE doc_id % 3 WHEN 0 THEN '**Status**: 尽调中 | x' WHEN 1 THEN concat('状态：', CASE doc_id % 4
   WHEN 0 THEN '已投资' WHEN 1 THEN 'Pass 否决' WHEN 2 THEN '已退出' ELSE '观察' END) ELSE '' END, chr(10),
 CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('| **Deal Type** | **', project, '** |')
   ELSE concat('项目：', project, ' tail') END, chr(10),
 CASE doc_id % 4 WHEN 0 THEN 'Last Updated: ' WHEN 1 THEN '更新时间：' WHEN 2 THEN '更新日期: ' ELSE 'none ' END,
 left(modified, 10), chr(10),
 CASE doc_id % 3 WHEN 0 THEN concat('Tags: ', lang, ',t', CAST(doc_id % 7 AS STRING), ' |')
   WHEN 1 THEN concat('标签：', lang, ' , t1,, x |') ELSE 'no labels' END, chr(10),
 '## 技术原理', chr(10), content)"""


def kb_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus whose content starts with a block of metadata lines in the accepted spellings."""
    return kb_docs(spark, sf_dir).withColumn("content", F.expr(FRONT))


# ---- S, C: signals and cost log (events) ------------------------------------------------------

def signals(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = events if events is not None else table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id AS seq",
        "CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 43 = 0 THEN '本周' "
        "ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date",
        "event_type AS theme",
        "CASE event_id % 3 WHEN 0 THEN upper(concat(event_type, ' user ', CAST(user_id AS STRING))) "
        "WHEN 1 THEN concat(event_type, '  user_', CAST(user_id AS STRING), '！') "
        "ELSE concat(event_type, '-user-', CAST(user_id AS STRING)) END AS title",
        "CASE event_id % 5 WHEN 0 THEN '产业信息' WHEN 1 THEN '资本信息' WHEN 2 THEN '投资人观点' "
        "ELSE '小道消息' END AS source_type",
        "user_id AS sub_query")


def cost_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = events if events is not None else table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id AS seq", "CAST(CAST(ts AS DATE) AS STRING) AS day", "event_type AS feature",
        "CASE user_id % 4 WHEN 0 THEN 'kimi-k2.6' WHEN 1 THEN 'deepseek-chat' WHEN 2 THEN 'qwen-plus' "
        "ELSE 'mystery-1' END AS model",
        "CAST(floor(value * 10) AS BIGINT) AS prompt_tokens",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS completion_tokens")


# ---- N, J: narratives and jobs (orders, lineitem) ---------------------------------------------

def narratives(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Narrative feed: the order key is the append order; dates are not in that order."""
    o = orders if orders is not None else spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return o.selectExpr(
        "concat('c', CAST(o_custkey AS STRING)) AS theme", "o_orderkey AS seq",
        "CAST(date_add(DATE '2024-01-01', CAST(o_orderkey % 45 AS INT)) AS STRING) AS date",
        "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderstatus END AS narrative",
        "o_orderpriority AS trigger")


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS seq", "CAST(date_add(DATE '2024-01-01', CAST(l_orderkey % 45 AS INT)) AS STRING) AS date",
        "concat('p', CAST(l_partkey AS STRING)) AS title", "l_linestatus AS theme",
        "CASE l_returnflag WHEN 'A' THEN 'Demand' WHEN 'R' THEN 'Capital' ELSE 'Technology' END AS var_type")


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS pos", "concat('c', CAST(c_custkey AS STRING)) AS theme",
        "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled",
        "c_custkey % 2 = 0 AS primary", "concat(c_mktsegment, ' news') AS query",
        "CASE WHEN c_custkey % 3 = 0 THEN array(c_name, '', c_mktsegment) END AS sub_queries")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job",
        "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS started",
        "CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(date_add(CAST(o_orderdate AS DATE), "
        "CAST(o_orderkey % 3 AS INT)) AS STRING) END AS finished",
        "CAST(o_orderkey % 1200 AS BIGINT) AS idle_secs",
        "o_orderkey % 29 = 0 AS cancel",
        "element_at(array('radar', 'tech', 'review', 'ingest', 'battle'), CAST(left(o_orderpriority, 1) AS INT)) AS kind")


def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS job", "CAST(l_linenumber AS BIGINT) AS pos", "l_partkey AS label",
        "CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'R' THEN 'error' ELSE 'running' END"
        " AS step_status",
        "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_quantity / 32 END AS frac",
        "CAST(l_quantity AS BIGINT) AS total", "CAST(floor(l_quantity * (0.5 + l_tax * 10)) AS BIGINT) AS done")


# ---- M, L, P, H: messages, lines, pages, web pages --------------------------------------------

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role",
        "CASE WHEN role = 'assistant' AND turn % 5 <> 0 THEN concat(text, '【Step ', "
        "CAST(turn % 6 + 1 AS STRING), ' · x】') WHEN role = 'user' AND (conv_id + turn) % 7 = 0 "
        "THEN concat(text, ' 今天先到这里') ELSE text END AS content")


def _lines(spark: SparkSession, sf_dir: str, line: str, extra: str = "") -> DataFrame:
    """Documents whose lines are rewritten by a SQL expression over (line, pos)."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr("doc_id", "source", "lang", "split(text, '\\n') AS ls")
    return d.selectExpr(
        "doc_id", "source", "lang", f"array_join(transform(ls, (line, pos) -> {line}), '\\n') AS content")


# Line rewrites that give the plain prose its headings, fences, tables and boilerplate. The same
# text is valid in both engines.
HEADED = "CASE WHEN pos % 5 = 0 THEN concat('## ', split_part(line, ' ', 1)) ELSE line END"
BOILER = ("CASE WHEN pos % 3 = 1 THEN 'Confidential - do not distribute' "
          "WHEN pos % 17 = 15 THEN concat('## 法律声明 ', CAST(pos AS STRING)) ELSE line END")
FENCED = ("CASE WHEN pos % 13 IN (4, 6) THEN '```' WHEN pos % 7 = 0 THEN concat('## *', split_part(line, ' ', 1), '*') "
          "WHEN pos % 11 = 5 THEN concat('### ', split_part(line, ' ', 1)) ELSE line END")
BOXED = ("CASE WHEN pos % 19 IN (2, 9) THEN '```' WHEN pos % 10 IN (3, 4, 5, 6) THEN "
         "concat('│ ', split_part(line, ' ', 1), ' ┼') ELSE line END")
DIGEST = ("CASE WHEN pos % 12 = 2 THEN '## 背景速览' WHEN pos % 12 = 9 THEN concat('## ', split_part(line, ' ', 1)) "
          "WHEN pos % 4 = 3 THEN '  ' ELSE line END")
BATTLED = ("CASE WHEN pos % 16 = 2 THEN '## ⚔️ Battle 记录' WHEN pos % 16 = 3 THEN concat('**观点状态：Monitoring**（观望） · 置信度 ', "
           "pos, '% → ', pos % 7 * 15, '%') WHEN pos % 16 = 4 THEN concat('**Core Belief**：', line) "
           "WHEN pos % 16 = 5 THEN '| 关键假设 | 验证程度 | 风险 |' WHEN pos % 16 = 6 THEN '|---|---|---|' "
           "WHEN pos % 16 = 7 THEN concat('| ', split_part(line, ' ', 1), ' | 未验证 | — |') WHEN pos % 16 = 8 THEN '| — | — | |' "
           "WHEN pos % 16 = 9 THEN concat('**反向世界**：', split_part(line, ' ', 1), ' 崩（当前现实更接近：原世界）') "
           "WHEN pos % 16 IN (11, 13) THEN concat('#### 2024-01-', pos % 16) WHEN pos % 16 = 15 THEN '## Next' ELSE line END")
FILED = ("CASE WHEN pos % 24 = 1 THEN '> **更新日期**：2020-01-01' WHEN pos % 24 = 3 THEN '### 1.1 行业坐标' "
         "WHEN pos % 24 = 4 THEN '| 项目 | A |' WHEN pos % 24 = 5 THEN '|---|---|' WHEN pos % 24 = 6 THEN "
         "CASE WHEN doc_id % 2 = 0 THEN '| （待填） | |' ELSE concat('| ', split_part(line, ' ', 1), ' | b |') END "
         "WHEN pos % 24 = 8 THEN '### 1.3 新项目评审留档' WHEN pos % 24 = 9 THEN CASE WHEN doc_id % 3 = 0 THEN '占位' "
         "ELSE '#### 2020 old' END WHEN pos % 24 = 11 THEN '## 行业阶段' WHEN pos % 24 = 14 THEN '## 关键变量' "
         "WHEN pos % 24 IN (15, 16, 18) THEN concat('| **v', pos, '** | x |') WHEN pos % 24 = 20 THEN '## Next' ELSE line END")
IMAGED = ("CASE WHEN pos % 3 = 1 THEN concat(line, '[[图:p', pos % 4, '_1.png]] tail [[图： x', pos % 5, '.png ]]') ELSE line END")
FOLDED = ("CASE WHEN pos % 8 = 3 THEN '<details>' WHEN pos % 8 = 5 THEN concat('</details>', '  ') ELSE line END")


def doc_lines(spark: SparkSession, sf_dir: str, rewrite: str = HEADED) -> DataFrame:
    return _lines(spark, sf_dir, rewrite)


PAGE_LINES = 2


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged documents: two lines per page, some pages start a chapter, some are blank."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr("doc_id", """transform(array(split(text, '\\n')), ls ->
        transform(sequence(0, CAST((size(ls) - 1) div 2 AS INT)), p ->
        CASE WHEN p % 9 = 8 THEN '' ELSE concat(
          CASE WHEN p % 7 = 2 THEN concat('第', CAST(p AS STRING), '章 x', chr(10))
               WHEN p % 7 = 5 THEN concat('1. Industry ...... ', CAST(p AS STRING), chr(10)) ELSE '' END,
          array_join(slice(ls, p * 2 + 1, 2), chr(10))) END))[0] AS pages""")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")
