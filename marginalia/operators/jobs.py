"""Job and step analytics: status, progress, remaining time, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_nonempty, lookup, or_else
from ..functions.text import base_name

STALE_SECS, STALE_SECS_CHAT = 600, 120
CHAT_KINDS = ("battle", "review")
SHOWN_SECS = 6 * 3600
# Order of a job list, and the labels of radar stages.
STATUS_RANK = {"running": 0, "interrupted": 1, "error": 2, "done": 3}
STAGES = {"fetch": "抓取", "cognition": "认知"}
FAILED = "任务失败"


def norm_status(status: Column, idle_secs: Column, cancel: Column | None = None,
                stale_secs: int | Column = STALE_SECS) -> Column:
    """Running without an update for too long, or cancelled, is interrupted; blank is done."""
    raw = F.coalesce(status, F.lit(""))
    known = F.when((raw == "running") & (idle_secs > stale_secs), "interrupted").when(
        raw == "", "done").otherwise(raw)
    return known if cancel is None else F.when(F.coalesce(cancel, F.lit(False)), "interrupted").otherwise(known)


def stale_after(kind: Column) -> Column:
    """Seconds without an update after which a job of this kind counts as interrupted."""
    return F.when(kind.isin(*CHAT_KINDS), STALE_SECS_CHAT).otherwise(STALE_SECS)


def elapsed_secs(started: Column, finished: Column, now: str) -> Column:
    """Seconds from start to finish (or now), at least 0; null when the start is unreadable."""
    t0 = F.try_to_timestamp(started)
    t1 = F.coalesce(F.try_to_timestamp(F.nullif(finished, F.lit(""))), F.lit(now).cast("timestamp"))
    return F.greatest(F.lit(0), F.unix_timestamp(t1) - F.unix_timestamp(t0)) + F.when(t0.isNull(), F.lit(None).cast("long")).otherwise(0)


def visible(status: Column, started: Column, finished: Column, now: str, shown_secs: int = SHOWN_SECS) -> Column:
    """Live jobs always; finished ones for a while, or when their age is unknown."""
    age = elapsed_secs(first_nonempty(finished, started), F.lit(""), now)
    return status.isin("running", "interrupted") | age.isNull() | (age <= shown_secs)


def progress(steps: DataFrame) -> DataFrame:
    """Done and total steps per job, percentage and the first running step.

    All aggregates are combined before the shuffle, so a job with very many steps is not hot.
    """
    done = F.count_if(F.col("step_status").isin("done", "error"))
    first_running = F.min(F.when(F.col("step_status") == "running", F.struct("pos", "label")))
    return steps.groupBy("job").agg(
        done.alias("done"), F.count(F.lit(1)).alias("total"),
        F.floor(100 * done / F.count(F.lit(1))).alias("pct"), first_running["label"].alias("current"))


def fraction(steps: DataFrame) -> DataFrame:
    """Mean fraction of a job's steps; a missing one counts as finished or not by status."""
    frac = F.coalesce("frac", F.when(F.col("step_status").isin("done", "error"), 1.0).otherwise(0.0))
    return steps.groupBy("job").agg(F.avg(F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0))).alias("fraction"))


def block_totals(steps: DataFrame) -> DataFrame:
    return steps.groupBy("job").agg(F.sum("total").alias("total"), F.sum(F.least("done", "total")).alias("done"))


def eta_secs(started: Column, done: Column, total: Column, now: str) -> Column:
    """Remaining seconds at the pace so far; null without a sample or a readable start."""
    elapsed = F.greatest(F.lit(0), F.unix_timestamp(F.lit(now).cast("timestamp"))
                         - F.unix_timestamp(F.try_to_timestamp(started)))
    return F.when((done > 0) & (total > done) & F.try_to_timestamp(started).isNotNull(),
                  elapsed / done * (total - done))


def with_eta(jobs: DataFrame, steps: DataFrame, now: str) -> DataFrame:
    """Remaining time from block counts, else from step counts."""
    counts = steps.groupBy("job").agg(
        F.sum(F.least("done", "total")).alias("b_done"), F.sum("total").alias("b_total"),
        F.count_if(F.col("step_status").isin("done", "error")).alias("f_done"), F.count(F.lit(1)).alias("f_total"))
    rows = jobs.join(counts, "job", "left")
    return rows.withColumn("eta_secs", F.coalesce(
        eta_secs(F.col("started"), F.col("b_done"), F.col("b_total"), now),
        eta_secs(F.col("started"), F.col("f_done"), F.col("f_total"), now))).drop(
        "b_done", "b_total", "f_done", "f_total")


def norm_steps(steps: Column, label: str) -> Column:
    """Step list as (label, status); the label depends on the kind of job."""
    def one(s: Column) -> Column:
        if label == "stage":
            text = F.concat(lookup(s["stage"], STAGES, s["stage"]), F.lit(" · "), s["theme"])
        else:
            text = F.coalesce(s[label], F.lit(""))
        return F.struct(text.alias("label"), F.coalesce(s["status"], F.lit("")).alias("status"))
    return F.transform(F.filter(steps, lambda s: s.isNotNull()), one)


def job_order(status: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(rank, status), F.lit(4))


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("rank", job_order(F.col("status"))).orderBy("rank", F.desc("started"), "job")


def of_pairs(drafts: DataFrame, pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Drafts kept under ``pair_key`` (first|second) whose two documents are a pair of ``pairs``."""
    chosen = pairs.select(F.concat(F.col(first).cast("string"), F.lit("|"), F.col(second).cast("string")).alias("pair_key"))
    return drafts.join(chosen, "pair_key", "left_semi")


def summary(c: dict[str, Column]) -> Column:
    """One line per job by kind and status."""
    def text(x):
        return x.cast("string")
    status, err = c["status"], F.coalesce(c["error"], F.lit(""))
    failed = F.left(or_else(err, FAILED), F.lit(120))
    ratio = F.concat(text(c["done"]), F.lit("/"), text(c["total"]))
    radar = (F.when(status == "done", F.concat(F.lit("新增信号 "), text(c["n_signals"]), F.lit(" 条 · 边际变量 "),
                                               text(c["n_variables"]), F.lit(" 个")))
             .when(status == "error", failed)
             .when(status == "running", F.concat(F.lit("模式 "), c["mode"], F.lit(" · 进度实时落盘"))).otherwise(""))
    tech = (F.when(status == "done", F.concat(F.lit("已合并 "), text(c["done"]), F.lit(" 篇进技术档案"), F.when(
                c["n_failed"] > 0, F.concat(F.lit(" · "), text(c["n_failed"]), F.lit(" 篇失败"))).otherwise("")))
            .when(status == "running", F.concat(F.lit("阶段："), c["mode"]))
            .when(status == "error", failed).otherwise(""))
    proj = F.replace(base_name(F.substring_index(F.coalesce(c["key"], F.lit("")), "|", 1)), F.lit(".md"), F.lit(""))
    review = (F.when(status == "done", F.when(proj != "", F.concat(proj, F.lit(" · 评审草稿已生成，等待人工确认")))
                     .otherwise("评审草稿已生成"))
              .when(status == "error", F.btrim(F.concat(proj, F.lit(" · "), F.left(or_else(err, FAILED), F.lit(100))),
                                               F.lit(" ·")))
              .otherwise(F.when(proj != "", F.concat(proj, F.lit(" · AI 生成中…"))).otherwise("AI 生成中…")))
    ingest = (F.when(status == "running", F.concat(ratio, F.lit(" 已处理"))).when(status == "error", failed)
              .otherwise(F.concat(ratio, F.lit(" 完成"))))
    chat = (F.when(status == "running", F.concat(F.lit("AI 回复中… "), F.right(F.coalesce(c["partial"], F.lit("")), F.lit(60))))
            .when(status == "error", failed).otherwise("回复已完成"))
    kind = c["kind"]
    return (F.when(kind == "radar", radar).when(kind == "tech", tech).when(kind == "review", review)
            .when(kind.isin("ingest", "ingest_save"), ingest).otherwise(chat))


