"""Chat sessions: recent messages, phase, statistics, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import lookup
from ..functions.text import base_name, closes_session
from .jobs import STALE_SECS, norm_status
from .ordered import top_per_group

MODEL_TURNS = 40
# Labels of the numbered phases of a debate.
PHASES = {"1": "假设攻击", "2": "证伪检验", "3": "反向世界", "4": "论点评估"}
PHASE_MARK = r"(?U)【Step\s*(\d+)\s*·\s*([^】]+)】"


def last_messages(messages: DataFrame, n: int = MODEL_TURNS) -> DataFrame:
    """The last ``n`` messages of each session."""
    return top_per_group(messages, ["conv_id"], [F.desc("turn")], n, "back")


def closing_intent(messages: DataFrame) -> DataFrame:
    """Sessions with a user message, and whether the last one asks to finish."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "turn").alias("content"))
    return last.select("conv_id", closes_session("content").alias("closing"))


def current_phase(messages: DataFrame) -> DataFrame:
    """Phase named in the last assistant message; without one, the first phase."""
    last = messages.groupBy("conv_id").agg(F.max(F.when(
        F.col("role") == "assistant", F.struct("turn", "content"))).alias("m"))
    text = F.coalesce("m.content", F.lit(""))
    number = F.regexp_extract(text, PHASE_MARK, 1)
    named = lookup(F.regexp_replace(number, r"^0+(?=.)", ""), PHASES, F.upper(F.regexp_extract(text, PHASE_MARK, 2)))
    return last.select("conv_id", F.when(number == "", PHASES["1"]).otherwise(named).alias("phase"))


def session_stats(messages: DataFrame) -> DataFrame:
    """Messages, user rounds and the current round number."""
    users = F.count_if(F.col("role") == "user")
    waiting = F.max_by("role", "turn") == "user"
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), users.alias("user_rounds"),
        F.greatest(F.lit(1), users + F.when(waiting, 0).otherwise(1)).alias("round_no"))


def estimated_usage(messages: DataFrame) -> DataFrame:
    """Token estimate of a session, two characters per token: the last message is the reply."""
    n = F.length(F.coalesce("content", F.lit("")))
    total, last = F.sum(n), F.max_by(n, F.col("turn"))
    return messages.groupBy("conv_id").agg(
        F.floor((total - last) / 2).alias("prompt_tokens"), F.floor(last / 2).alias("completion_tokens"))


def session_status(sessions: DataFrame, pending: DataFrame) -> DataFrame:
    """Sessions with the state of their pending reply, latest first."""
    p = pending.select("key", F.col("status").alias("_s"), "cancel", "idle_secs")
    stale = (F.col("_s") == "running") & ~F.coalesce("cancel", F.lit(False)) & (F.col("idle_secs") > STALE_SECS)
    state = F.when(F.col("_s").isNull(), "").when(F.col("_s") == "", F.when(
        F.coalesce("cancel", F.lit(False)), "interrupted").otherwise("")).otherwise(
        norm_status(F.col("_s"), F.col("idle_secs"), F.col("cancel")))
    doc = F.replace(base_name(F.col("doc_path")), F.lit(".md"), F.lit(""))
    return sessions.join(p, "key", "left").select(
        "key", "doc_path", F.coalesce(F.nullif(doc, F.lit("")), F.left("key", F.lit(6))).alias("doc_name"),
        "messages", "updated", state.alias("pending_status"),
        F.coalesce(stale, F.lit(False)).alias("pending_stale")).orderBy(F.desc("updated"), "key")


def pending_labels(pending: DataFrame, sessions: DataFrame) -> DataFrame:
    """Label of a pending reply: the session's document name, else the start of its key."""
    doc = F.replace(base_name(F.coalesce("doc_path", F.lit(""))), F.lit(".md"), F.lit(""))
    return pending.join(sessions.select("key", "doc_path"), "key", "left").withColumn(
        "label", F.coalesce(F.nullif(doc, F.lit("")), F.left("key", F.lit(6)))).drop("doc_path")
