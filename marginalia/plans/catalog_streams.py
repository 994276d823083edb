"""Streaming queries over the provided tables, run over what is available, with batch oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import unescape_all
from ..operators import enrich as E
from ..operators import signals as G
from ..session import shared_dir
from ..sources import corpus_files, logs, versions
from ..sources import tables as S
from ..streaming import costs, jobs, narratives, signals
from ..streaming.sinks import run_to_table, stream_table
from . import oracle_views as V
from .catalog_signals import AS_OF, FIRSTS
from .oracle_views import with_
from .registry import query


def signal_stream(spark, sf):
    return S.signals(spark, sf, stream_table(spark, sf, "events"))


@query("str01_stream_dedup_append", with_(V.S) + FIRSTS)
def _(spark, sf):
    return signals.dedup_append(signal_stream(spark, sf)).select("seq", "key")


@query("str02_late_data_drop", with_(V.S) + """SELECT min(seq) AS seq, key FROM SK WHERE key <> ''
 AND (NOT regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}') OR date >= '2024-01-21') GROUP BY key""")
def _(spark, sf):
    return signals.dedup_append(signal_stream(spark, sf), as_of=AS_OF).select("seq", "key")


@query("str03_narrative_state", with_(V.N) + "SELECT theme, seq, date, previous, new_narrative, trig AS trigger, is_transition FROM NH")
def _(spark, sf):
    feed = S.narratives(spark, sf, stream_table(spark, sf, "orders"))
    return narratives.narrative_history(feed)


def theme_stream(spark, sf):
    return stream_table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("theme"))


def by_start(windows, name):
    return windows.select(F.date_format("start", "yyyy-MM-dd").alias(name), "theme", "n")


@query("str04_rolling_7d", """SELECT CAST(CAST(CAST(ts AS DATE) - CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS from_day, event_type AS theme, CAST(count(*) AS BIGINT) AS n
 FROM events, range(0, 7) g(i) GROUP BY 1, 2""")
def _(spark, sf):
    return by_start(signals.run_windows(signals.rolling_counts(theme_stream(spark, sf), "ts"), "rolling"), "from_day")


@query("str05_weekly_tumbling", """SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday, event_type AS theme, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return by_start(signals.run_windows(signals.weekly_counts(theme_stream(spark, sf), "ts"), "weekly"), "monday")


@query("str06_stale_detection", """SELECT user_id AS job, CASE WHEN arg_max(event_type, ts) = 'view' THEN CASE WHEN max(ts) < TIMESTAMP '2024-01-30 23:59:00' - INTERVAL 600 SECOND
 THEN 'interrupted' ELSE 'running' END ELSE arg_max(event_type, ts) END AS status FROM events GROUP BY user_id""")
def _(spark, sf):
    beats = stream_table(spark, sf, "events").select(
        F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"))
    return jobs.run_statuses(beats, until="2024-01-30 23:59:00").select("job", "status")


@query("str07_cost_stream", with_(V.C) + """SELECT day, feature, CAST(count(*) AS BIGINT) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
 CAST(sum(CAST(cost AS DECIMAL(18,4))) AS DOUBLE) AS cost FROM CP GROUP BY day, feature""")
def _(spark, sf):
    log = S.cost_log(spark, sf, stream_table(spark, sf, "events"))
    return run_to_table(costs.cost_totals(log), "costs", ["day", "feature"])


@query("udf01_enrich_hook", """SELECT doc_id, md5(concat('reply: ', text)) AS h, false AS failed FROM documents""")
def _(spark, sf):
    requests = S.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    answered = E.enrich(requests, "prompt", lambda prompts: [f"reply: {p}" for p in prompts])
    return answered.select("doc_id", F.md5("reply").alias("h"), "failed")


# ---- sinks and decoders: write to the shared folder, read back --------------------------------

@query("snk01_index_write", with_(V.K) + "SELECT path, name, size, content FROM K")
def _(spark, sf):
    path = shared_dir(spark, "index")
    corpus_files.write_index(S.kb_docs(spark, sf), path)
    return versions.read(spark, path).select("path", "name", "size", "content")


@query("snk02_atomic_overwrite", with_(V.S) + "SELECT seq, title FROM SK WHERE seq IN (SELECT min(seq) FROM SK WHERE key <> '' GROUP BY key)")
def _(spark, sf):
    path, items = shared_dir(spark, "state"), S.signals(spark, sf)
    logs.save_state(items, path)
    logs.save_state(G.dedup(items), path)
    return logs.load_state(spark, path).select("seq", "title")


@query("snk03_log_append", with_(V.C) + "SELECT day AS ts, feature, model, prompt_tokens, completion_tokens FROM C")
def _(spark, sf):
    path, log = shared_dir(spark, "log"), S.cost_log(spark, sf).withColumnRenamed("day", "ts").drop("seq")
    logs.append_log(log.where("prompt_tokens % 2 = 0"), path)
    logs.append_log(log.where("prompt_tokens % 2 <> 0"), path)
    return logs.parse_cost_lines(logs.read_lines(spark, path)).where("NOT corrupt").select(
        "ts", "feature", "model", "prompt_tokens", "completion_tokens")


# A third of the texts as they are, a third in GBK (whole, other signs than ASCII as one that GBK has),
# a third with a byte behind them that neither encoding has.
WIDE = "regexp_replace(text, '[^ -~\\n]', '测'{g})"


@query("src02_text_decode", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat({WIDE.format(g=", 'g'")}, '测')
 ELSE concat(text, chr(65533)) END AS text FROM documents""".replace("\\\\n", "\\n"))
def _(spark, sf):
    gbk = f"unhex(replace(hex(CAST(concat({WIDE.format(g='')}, '测') AS BINARY)), 'E6B58B', 'B2E2'))"
    files = S.spread(S.table(spark, sf, "documents"), "doc_id").selectExpr(
        "doc_id", f"CASE doc_id % 3 WHEN 0 THEN CAST(text AS BINARY) WHEN 1 THEN {gbk} ELSE concat(CAST(text AS BINARY), X'FF') END AS content")
    return corpus_files.decode_text(files).select("doc_id", "text")


@query("udf04_unescape", """SELECT doc_id, concat(text, CASE WHEN doc_id % 4 = 0 THEN 'é中…' ELSE '<&amp;"' END) AS text FROM documents""")
def _(spark, sf):
    escaped = F.col("text")
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("é", "&eacute;"), ("ñ", "&#xf1;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(reference))
    tail = F.when(F.col("doc_id") % 4 == 0, "&eacute;&#x4e2d;&hellip;").otherwise("&lt;&amp;amp;&quot;")
    return S.spread(S.table(spark, sf, "documents"), "doc_id").select(
        "doc_id", unescape_all(F.concat(escaped, tail)).alias("text"))
