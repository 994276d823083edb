"""Connected components of a graph given by its edges, as Spark joins over narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _rewired(links: DataFrame) -> DataFrame:
    """One round of alternating stars (Kiveris and others, 2014) over links (u, v), u > v.

    First every node links its larger neighbours to the smallest of its neighbours and itself, then
    every node links its smaller neighbours, and itself, to the smallest of them.
    """
    both = links.union(links.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("low"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")),
                                                            F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("_l"))
    return small.select("_l.*").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of the edges (a, b): the smallest node that can be reached.

    Links are rewired until every node is linked to the label alone. A path halves in length with
    every round, so a component takes about as many as the logarithm of its longest path; the number
    of links never grows. Minima of a hub's links are pre-aggregated; joins on a hub are split by the
    engine. Self loops and repeated edges do no harm.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    count = links.count()
    while count:
        moved = staged(_rewired(links), "links")
        moved_count = moved.count()
        same = moved_count == count and moved.join(links, ["u", "v"], "left_anti").limit(1).count() == 0
        links, count = moved, moved_count
        if same:
            break
    return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
