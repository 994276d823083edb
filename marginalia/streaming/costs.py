"""Running cost totals per day and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.costs import with_cost


def cost_totals(stream: DataFrame) -> DataFrame:
    costed = with_cost(stream, stream.sparkSession)
    return costed.groupBy("day", "feature").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
