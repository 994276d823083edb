"""Model-call cost log: pricing, provider matching, daily and weekly totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import values
from .signals import days_before

# Price per million tokens (input, output).
PRICES = [
    ("kimi-k2.6", 4.0, 21.0),
    ("deepseek-chat", 2.0, 8.0),
    ("glm-4-plus", 50.0, 50.0),
    ("qwen-plus", 0.8, 2.0),
    ("gpt-4o", 18.0, 72.0),
    ("gemini-2.5-flash", 2.2, 18.0),
]
# Endpoint of each provider, and model-name prefixes in matching order.
PROVIDER_URLS = {
    "moonshot": "https://api.moonshot.cn/v1",
    "deepseek": "https://api.deepseek.com/v1",
    "zhipu": "https://open.bigmodel.cn/api/paas/v4",
    "doubao": "https://ark.cn-beijing.volces.com/api/v3",
    "dashscope": "https://dashscope.aliyuncs.com/compatible-mode/v1",
    "openai": "https://api.openai.com/v1",
    "gemini": "https://generativelanguage.googleapis.com/v1beta/openai/",
    "xai": "https://api.x.ai/v1",
    "perplexity": "https://api.perplexity.ai",
}
MODEL_PREFIXES = [
    ("moonshot", ["kimi-", "moonshot-"]),
    ("zhipu", ["glm-", "chatglm"]),
    ("doubao", ["doubao-", "ep-"]),
    ("dashscope", ["qwen", "qwq-"]),
    ("openai", ["gpt-", "chatgpt-", "o1", "o3", "o4"]),
    ("gemini", ["gemini-"]),
    ("anthropic", ["claude-"]),
    ("xai", ["grok-"]),
    ("perplexity", ["sonar"]),
    ("deepseek", ["deepseek-"]),
]


def with_cost(log: DataFrame, spark: SparkSession) -> DataFrame:
    """Cost of each call in DECIMAL, rounded to four places; an unknown model costs nothing."""
    prices = values(spark, PRICES, "model STRING, p_in DECIMAL(10,2), p_out DECIMAL(10,2)")
    rows = log.join(F.broadcast(prices), "model", "left")
    def part(tokens: str, price: str) -> Column:
        return F.col(tokens).cast("decimal(14,0)") * F.coalesce(F.col(price), F.lit(0).cast("decimal(10,2)"))
    cost = F.round((part("prompt_tokens", "p_in") + part("completion_tokens", "p_out")).cast("decimal(28,4)")
                   * F.lit("0.000001").cast("decimal(7,6)"), 4).cast("decimal(18,4)")
    return rows.withColumn("cost", cost).drop("p_in", "p_out")


def match_provider(model: Column, base_url: Column) -> Column:
    """Provider by exact endpoint, else by the first model-name prefix; null when neither fits."""
    url = F.rtrim(F.coalesce(base_url, F.lit("")), F.lit("/"))
    out = None
    for provider, known in PROVIDER_URLS.items():
        hit = url == known.rstrip("/")
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    name = F.lower(F.coalesce(model, F.lit("")))
    for provider, prefixes in MODEL_PREFIXES:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = out.when(hit, provider)
    return out


def cost_of_day(costed: DataFrame, day: str) -> DataFrame:
    return costed.where(F.col("day") == day).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(28,4)")).alias("cost"))


def cost_by_feature(costed: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Calls, tokens and cost per feature over the last days, most expensive first, with the total."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return (costed.where(F.col("day") >= days_before(as_of, days))
            .withColumn("feature", F.coalesce("feature", F.lit("unknown")))
            .rollup("feature").agg(
                F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.sum("cost").alias("cost"),
                F.grouping("feature").alias("g"))
            .select(F.when(F.col("g") == 1, "(total)").otherwise(F.col("feature")).alias("feature"),
                    "calls", "tokens", "cost", "g").orderBy(F.desc("g"), F.desc("cost")).drop("g"))


def last_entry(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Time and mode of the last log entry."""
    row = log.agg(F.max_by(F.struct("ts", "mode"), seq).alias("r"))
    return row.select(F.col("r.ts").alias("ts"), F.when(
        F.coalesce("r.mode", F.lit("")) == "", F.col("r.ts")).otherwise(
        F.concat("r.ts", F.lit("（"), "r.mode", F.lit("）"))).alias("label"))


def run_totals(runs: DataFrame) -> DataFrame:
    """New signals and variables of a run, summed over its nested maps."""
    zero = F.lit(0).cast("long")
    return runs.withColumns({
        "n_signals": F.aggregate(F.map_values("results"), zero, lambda a, x: a + x),
        "n_variables": F.aggregate(F.map_values("cognition"), zero, lambda a, x: a + x["variables"])})
