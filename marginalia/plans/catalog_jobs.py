"""Job and chat queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as H
from ..operators import jobs as B
from ..sources import tables as S
from . import oracle_views as V
from .oracle_views import with_
from .registry import query

NOW = "2001-08-02 06:00:00"
Q = with_(V.J)
STATUS = """CASE WHEN cancel THEN 'interrupted' WHEN status = 'running' AND idle_secs > 600 THEN 'interrupted' ELSE status END"""


def normed(spark, sf):
    return S.jobs(spark, sf).withColumn("status", B.norm_status(F.col("status"), F.col("idle_secs"), F.col("cancel")))


@query("sca15_norm_job_status", Q + f"SELECT job, {STATUS} AS status FROM J")
def _(spark, sf):
    return normed(spark, sf).select("job", "status")


@query("sca15_kind_staleness", Q + """SELECT job, CASE WHEN status = 'running' AND idle_secs > CASE WHEN kind IN ('battle', 'review') THEN 120 ELSE 600 END
 THEN 'interrupted' ELSE status END AS status FROM J""")
def _(spark, sf):
    status = B.norm_status(F.col("status"), F.col("idle_secs"), stale_secs=B.stale_after(F.col("kind")))
    return S.jobs(spark, sf).select("job", status.alias("status"))


@query("sca16_elapsed", Q + f"""SELECT job, CAST(greatest(0, epoch(CASE WHEN finished = '' THEN TIMESTAMP '{NOW}' ELSE CAST(finished AS TIMESTAMP) END)
 - epoch(CAST(started AS TIMESTAMP))) AS BIGINT) AS secs FROM J WHERE job % 11 <> 0 UNION ALL SELECT job, NULL FROM J WHERE job % 11 = 0""")
def _(spark, sf):
    started = F.when(F.col("job") % 11 == 0, "soon").otherwise(F.col("started"))
    return S.jobs(spark, sf).select("job", B.elapsed_secs(started, F.col("finished"), NOW).alias("secs"))


@query("fil12_visible_jobs", Q + f"""SELECT job FROM J WHERE {STATUS} IN ('running', 'interrupted')
 OR epoch(TIMESTAMP '2001-08-01 05:00:00') - epoch(CAST(CASE WHEN finished = '' THEN started ELSE finished END AS TIMESTAMP)) <= 21600 OR job % 11 = 0""")
def _(spark, sf):
    started = F.when(F.col("job") % 11 == 0, "soon").otherwise(F.col("started"))
    finished = F.when(F.col("job") % 11 == 0, "").otherwise(F.col("finished"))
    return normed(spark, sf).where(B.visible(F.col("status"), started, finished, "2001-08-01 05:00:00")).select("job")


PROGRESS = """PR AS (SELECT job, CAST(sum(CASE WHEN step_status IN ('done', 'error') THEN 1 ELSE 0 END) AS BIGINT) AS done,
 CAST(count(*) AS BIGINT) AS total FROM JS GROUP BY job),
 RUNNING AS (SELECT job, label FROM JS WHERE step_status = 'running' QUALIFY row_number() OVER (PARTITION BY job ORDER BY pos, label) = 1)"""


@query("agg11_job_progress", with_(V.J, PROGRESS) + """SELECT job, done, total, CAST(floor(100 * done / total) AS BIGINT) AS pct, label AS current
 FROM PR LEFT JOIN RUNNING USING (job)""")
def _(spark, sf):
    return B.progress(S.job_steps(spark, sf))


@query("agg12_frac_progress", Q + """SELECT job, sum(least(greatest(coalesce(frac, CASE WHEN step_status = 'running' THEN 0.0 ELSE 1.0 END), 0), 1)) / count(*) AS fraction FROM JS GROUP BY job""")
def _(spark, sf):
    return B.fraction(S.job_steps(spark, sf))


BLOCKS = "BL AS (SELECT job, CAST(sum(total) AS BIGINT) AS total, CAST(sum(least(done, total)) AS BIGINT) AS done FROM JS GROUP BY job)"


@query("agg13_block_totals", with_(V.J, BLOCKS) + "SELECT job, total, done FROM BL")
def _(spark, sf):
    return B.block_totals(S.job_steps(spark, sf))


ETA = "CASE WHEN {d} > 0 AND {t} > {d} THEN greatest(0, epoch(TIMESTAMP '%s') - epoch(CAST(started AS TIMESTAMP))) / {d} * ({t} - {d}) END" % NOW


@query("agg14_eta", with_(V.J, PROGRESS, BLOCKS) + f"""SELECT job, round(coalesce({ETA.format(d='BL.done', t='BL.total')}, {ETA.format(d='PR.done', t='PR.total')}), 3) AS eta_secs
 FROM J LEFT JOIN BL USING (job) LEFT JOIN PR USING (job)""")
def _(spark, sf):
    return B.with_eta(S.jobs(spark, sf), S.job_steps(spark, sf), NOW).select("job", F.round("eta_secs", 3).alias("eta_secs"))


@query("sca17_norm_steps", """SELECT l_orderkey AS job, l_linenumber::BIGINT AS pos, l_partkey AS part,
 concat(CASE l_returnflag WHEN 'R' THEN '抓取' WHEN 'A' THEN '认知' ELSE 'N' END, ' · ', l_linestatus) AS label, CASE WHEN l_suppkey % 2 = 0 THEN 'done' ELSE '' END AS status FROM lineitem""")
def _(spark, sf):
    steps = F.expr("array(named_struct('stage', CASE l_returnflag WHEN 'R' THEN 'fetch' WHEN 'A' THEN 'cognition' ELSE 'N' END, "
                   "'theme', l_linestatus, 'status', CASE WHEN l_suppkey % 2 = 0 THEN 'done' END), NULL)")
    return S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"),
        F.inline(B.norm_steps(steps, "stage")))


@query("sca18_job_summary", with_(V.J, PROGRESS, f"X AS (SELECT job, kind, {STATUS} AS status, done, total, CASE WHEN job % 5 = 0 THEN '' ELSE repeat('boom ', 30) END AS err, CASE WHEN job % 3 = 0 THEN '' ELSE concat('doc', CAST(job AS VARCHAR)) END AS proj FROM J JOIN PR USING (job))") + """
 SELECT job, CASE kind
  WHEN 'radar' THEN CASE status WHEN 'done' THEN concat('新增信号 ', CAST(done AS VARCHAR), ' 条 · 边际变量 ', CAST(total AS VARCHAR), ' 个')
    WHEN 'error' THEN left(CASE WHEN err = '' THEN '任务失败' ELSE err END, 120) WHEN 'running' THEN '模式 full · 进度实时落盘' ELSE '' END
  WHEN 'tech' THEN CASE status WHEN 'done' THEN concat('已合并 ', CAST(done AS VARCHAR), ' 篇进技术档案', CASE WHEN total > done THEN concat(' · ', CAST(total - done AS VARCHAR), ' 篇失败') ELSE '' END)
    WHEN 'running' THEN '阶段：full' WHEN 'error' THEN left(CASE WHEN err = '' THEN '任务失败' ELSE err END, 120) ELSE '' END
  WHEN 'review' THEN CASE status WHEN 'done' THEN CASE WHEN proj = '' THEN '评审草稿已生成' ELSE concat(proj, ' · 评审草稿已生成，等待人工确认') END
    WHEN 'error' THEN trim(concat(proj, ' · ', left(CASE WHEN err = '' THEN '任务失败' ELSE err END, 100)), ' ·')
    ELSE CASE WHEN proj = '' THEN 'AI 生成中…' ELSE concat(proj, ' · AI 生成中…') END END
  WHEN 'ingest' THEN CASE status WHEN 'error' THEN left(CASE WHEN err = '' THEN '任务失败' ELSE err END, 120)
    ELSE concat(CAST(done AS VARCHAR), '/', CAST(total AS VARCHAR), CASE status WHEN 'running' THEN ' 已处理' ELSE ' 完成' END) END
  ELSE CASE status WHEN 'running' THEN concat('AI 回复中… ', right(concat(repeat('z', 70), CAST(job AS VARCHAR)), 60))
    WHEN 'error' THEN left(CASE WHEN err = '' THEN '任务失败' ELSE err END, 120) ELSE '回复已完成' END END AS summary FROM X""")
def _(spark, sf):
    rows = normed(spark, sf).join(B.progress(S.job_steps(spark, sf)), "job")
    job = F.col("job").cast("string")
    fields = {
        "kind": F.col("kind"), "status": F.col("status"), "done": F.col("done"), "total": F.col("total"),
        "n_signals": F.col("done"), "n_variables": F.col("total"), "n_failed": F.col("total") - F.col("done"),
        "mode": F.lit("full"), "error": F.expr("CASE WHEN job % 5 = 0 THEN '' ELSE repeat('boom ', 30) END"),
        "key": F.when(F.col("job") % 3 == 0, "").otherwise(F.concat(F.lit("a/doc"), job, F.lit(".md|b/c.md"))),
        "partial": F.concat(F.repeat(F.lit("z"), 70), job)}
    return rows.select("job", B.summary(fields).alias("summary"))


@query("top09_job_list", Q + f"""SELECT job, status, started, CAST(CASE status WHEN 'running' THEN 0 WHEN 'interrupted' THEN 1 WHEN 'error' THEN 2 WHEN 'done' THEN 3 ELSE 4 END AS BIGINT) AS rank
 FROM (SELECT job, {STATUS} AS status, started FROM J)""")
def _(spark, sf):
    return B.job_list(normed(spark, sf)).select("job", "status", "started", "rank")


# ---- review pairs: drafts keyed by project and industry ---------------------------------------

@query("joi16_review_pairs", """SELECT o_orderkey AS job, concat('p', CAST(o_custkey AS VARCHAR), '|i', CAST(c_nationkey AS VARCHAR)) AS pair_key
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 25 = c_nationkey""")
def _(spark, sf):
    drafts = S.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS job", "concat('p', CAST(o_custkey AS STRING), '|i', CAST(o_orderkey % 25 AS STRING)) AS pair_key")
    chosen = S.table(spark, sf, "customer").selectExpr(
        "concat('p', CAST(c_custkey AS STRING)) AS project", "concat('i', CAST(c_nationkey AS STRING)) AS industry")
    return B.of_pairs(drafts, chosen, "project", "industry").select("job", "pair_key")


# ---- chat -------------------------------------------------------------------------------------

MQ = with_(V.M)


@query("win09_last_n", MQ + """SELECT conv_id, turn, role FROM M QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def _(spark, sf):
    return H.last_messages(S.messages(spark, sf), 3).select("conv_id", "turn", "role")


@query("fil13_closing_intent", MQ + """SELECT conv_id, regexp_matches(arg_max(content, turn), '(今天|今日).{0,4}(到|先).{0,2}这|到此为止|收工|先聊到这|就到这') AS closing
 FROM M WHERE role = 'user' GROUP BY conv_id""")
def _(spark, sf):
    return H.closing_intent(S.messages(spark, sf))


@query("win13_current_phase", MQ + """SELECT conv_id, CASE WHEN t IS NULL OR t % 5 = 0 THEN '假设攻击' WHEN t % 6 + 1 <= 4 THEN ['假设攻击', '证伪检验', '反向世界', '论点评估'][t % 6 + 1] ELSE 'X' END AS phase
 FROM (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS t FROM M GROUP BY conv_id)""")
def _(spark, sf):
    return H.current_phase(S.messages(spark, sf))


@query("agg19_session_stats", MQ + """SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS user_rounds,
 CAST(greatest(1, count(*) FILTER (role = 'user') + CASE WHEN arg_max(role, turn) = 'user' THEN 0 ELSE 1 END) AS BIGINT) AS round_no FROM M GROUP BY conv_id""")
def _(spark, sf):
    return H.session_stats(S.messages(spark, sf))


@query("agg09_est_tokens", MQ + """SELECT conv_id, CAST((sum(length(content)) - arg_max(length(content), turn)) // 2 AS BIGINT) AS prompt_tokens,
 CAST(arg_max(length(content), turn) // 2 AS BIGINT) AS completion_tokens FROM M GROUP BY conv_id""")
def _(spark, sf):
    return H.estimated_usage(S.messages(spark, sf))


def sessions(spark, sf):
    """One session per conversation, keyed by the hash of its document path."""
    path = F.expr("CASE WHEN conv_id % 9 = 0 THEN '' ELSE concat('02_deals/doc', CAST(conv_id AS STRING), '.md') END")
    per = S.messages(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("updated"))
    return per.select("conv_id", T.session_key(F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("key"),
                      path.alias("doc_path"), "messages", F.col("updated").cast("string").alias("updated"))


def pending(spark, sf):
    return S.jobs(spark, sf).select(
        "job", T.session_key(F.concat(F.lit("c"), F.col("job").cast("string"))).alias("key"), "status", "cancel", "idle_secs")


SESSIONS = """SS AS (SELECT conv_id, left(md5(concat('c', CAST(conv_id AS VARCHAR))), 12) AS key, CASE WHEN conv_id % 9 = 0 THEN '' ELSE concat('02_deals/doc', CAST(conv_id AS VARCHAR), '.md') END AS doc_path,
  CAST(count(*) AS BIGINT) AS messages, CAST(max(turn) AS VARCHAR) AS updated FROM M GROUP BY conv_id)"""


@query("joi11_session_status", with_(V.M, V.J, SESSIONS) + f"""SELECT key, doc_path, CASE WHEN doc_path = '' THEN left(key, 6) ELSE concat('doc', CAST(conv_id AS VARCHAR)) END AS doc_name,
 messages, updated, coalesce({STATUS}, '') AS pending_status, coalesce(status = 'running' AND NOT cancel AND idle_secs > 600, false) AS pending_stale
 FROM SS LEFT JOIN J ON J.job = SS.conv_id""")
def _(spark, sf):
    return H.session_status(sessions(spark, sf), pending(spark, sf).drop("job"))


@query("joi10_session_label", with_(V.M, V.J, SESSIONS) + """SELECT job, coalesce(CASE WHEN doc_path <> '' THEN concat('doc', CAST(conv_id AS VARCHAR)) END, left(md5(concat('c', CAST(job AS VARCHAR))), 6)) AS label
 FROM J LEFT JOIN SS ON J.job = SS.conv_id""")
def _(spark, sf):
    return H.pending_labels(pending(spark, sf), sessions(spark, sf)).select("job", "label")
