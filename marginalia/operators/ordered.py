"""Order-sensitive operators that stay safe when one group holds a large share of all rows.

``lag() OVER (PARTITION BY group ORDER BY seq)`` sorts a whole group in one task. Here the rows are
cut into order-preserving buckets, and one summary row per group and bucket carries values across
bucket borders. Append numbers are cut into ranges, so a bucket holds at most that many rows of unique
numbers and no statistics are needed; any other order is cut at quantiles of (group, order), so a
bucket holds about one part in ``CUT_POINTS`` of the table, whichever group it belongs to. The caller
says which it is; the plan never depends on the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import let

# Append numbers (or name suffixes) that fall into one bucket.
NUMBER_RANGE = 1_000_000
LOWEST = -2 ** 63  # bucket of rows without a number; they come first, as nulls do
# Cut points between buckets of any other order; a power of two.
CUT_POINTS = 4096


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the given order.

    ``min_by`` is combined on the map side, so a key that holds a third of all rows sends one row
    per map task through the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their rank. The rank filter is applied before the
    shuffle as well, so each map task sends at most ``n`` rows of a group."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def cut_points(df: DataFrame, cols: Sequence[str]) -> Column:
    """Sorted sample of at most ``CUT_POINTS`` ordering keys, as a scalar subquery: the keys with the
    smallest hashes, taken in one scan. The sample depends on the data only, so a retried task sees
    the same cut points, and its size does not grow with the table."""
    keys = df.select(F.struct(*cols).alias("_k"))
    sample = keys.orderBy(F.xxhash64("_k"), "_k").limit(CUT_POINTS).agg(F.sort_array(F.collect_set("_k")))
    return sample.scalar()


def with_order_bucket(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Order-preserving ``_bucket`` number: how many cut points lie below the row's key, found by
    binary search."""
    cols = [*group, *order]
    strides = F.array(*[F.lit(1 << k) for k in range(CUT_POINTS.bit_length() - 1, -1, -1)])

    def search(v: Column) -> Column:
        return F.aggregate(strides, F.lit(0), lambda at, stride: F.when(
            F.get(v["cuts"], at + stride - 1) < v["key"], at + stride).otherwise(at))
    bound = F.struct(F.col("_cuts").alias("cuts"), F.struct(*cols).alias("key"))
    return df.withColumn("_cuts", cut_points(df, cols)).withColumn("_bucket", let(bound, search)).drop("_cuts")


def with_number_bucket(df: DataFrame, number: str, rows: int = NUMBER_RANGE) -> DataFrame:
    """Order-preserving ``_bucket`` number from an append number: its range of ``rows`` numbers."""
    return df.withColumn("_bucket", F.coalesce(F.floor(F.col(number) / rows), F.lit(LOWEST)))


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str,
               prev: str | None = None, next_: str | None = None, rows: int | None = None) -> DataFrame:
    """Value of the previous and/or next row of the group. ``rows`` says that ``order`` is one append
    number, to be cut into ranges of that many.

    The rows are shuffled once, to (group, bucket), and get their neighbours there; only the first and
    the last row of a bucket go further, to their group, where they meet those of the next buckets.
    """
    df = df.withColumn("_v", F.col(value))
    df = with_number_bucket(df, *order, rows) if rows else with_order_bucket(df, group, order)
    inside = W.partitionBy(*group, "_bucket").orderBy(*order)
    placed = df.select("*", F.lag("_v").over(inside).alias("_prev"), F.lead("_v").over(inside).alias("_next"),
                       F.row_number().over(inside).alias("_at"), F.count(F.lit(1)).over(W.partitionBy(*group, "_bucket")).alias("_size"))
    first, last = F.col("_at") == 1, F.col("_at") == F.col("_size")
    edges = placed.where(first | last).groupBy(*group, "_bucket").agg(
        F.max_by("_v", first.cast("int")).alias("_first"), F.max_by("_v", last.cast("int")).alias("_last"))
    across = W.partitionBy(*group).orderBy("_bucket")
    edges = edges.select(*group, "_bucket", F.lag("_last").over(across).alias("_before"),
                         F.lead("_first").over(across).alias("_after"))
    joined = placed.join(edges, [*group, "_bucket"], "left")
    extra = {**({prev: F.when(first, F.col("_before")).otherwise(F.col("_prev"))} if prev else {}),
             **({next_: F.when(last, F.col("_after")).otherwise(F.col("_next"))} if next_ else {})}
    return joined.withColumns(extra).drop("_v", "_before", "_after", "_bucket", "_prev", "_next", "_at", "_size")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, out: str) -> DataFrame:
    """Inclusive running sum within the group, over its ``_bucket`` column in two levels: totals of
    earlier buckets plus the running sum inside the row's own bucket."""
    df = df.withColumn("_a", amount.cast("long"))
    totals = df.groupBy(*group, "_bucket").agg(F.sum("_a").alias("_t"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (df.join(totals, [*group, "_bucket"], "left")
            .withColumn(out, F.col("_off") + F.sum("_a").over(inside)).drop("_a", "_off", "_bucket"))


def unique_names(new: DataFrame, existing: DataFrame, base: str = "base", seq: str = "seq",
                 suffix: str = "suffix", rows: int = NUMBER_RANGE) -> DataFrame:
    """Collision-free names: the k-th new row of a base gets the k-th suffix that is still free.

    ``existing`` holds (base, suffix) with suffix 1 for the bare name. With the used suffixes
    u_1 < u_2 < ... there are u_j - j free ones below u_j, hence the k-th free suffix is k plus the
    number of j with u_j - j < k: a running count over both inputs, no per-base arrays. ``seq`` is the
    append number of a row; it and the suffixes of a base are unique, so ranges make bounded buckets.
    """
    used = existing.select(base, F.col(suffix).cast("long").alias("_u")).distinct()
    payload = [c for c in new.columns if c != base]

    ranked = running_sum(with_number_bucket(used, "_u", rows), [base], ["_u"], F.lit(1), "_j")
    steps = ranked.groupBy(base, (F.col("_u") - F.col("_j") + 1).alias("_at")).agg(
        F.count(F.lit(1)).alias("_cnt"))
    numbered = running_sum(with_number_bucket(new, seq, rows), [base], [seq], F.lit(1), "_k")
    both = numbered.select(base, F.col("_k").alias("_at"), F.lit(0).cast("long").alias("_cnt"),
                           F.struct(*payload).alias("_row")).unionByName(
        steps.select(base, "_at", "_cnt"), allowMissingColumns=True)
    both = with_number_bucket(both.withColumn("_new", F.col("_row").isNotNull().cast("int")), "_at", rows)
    counted = running_sum(both, [base], ["_at", "_new"], F.col("_cnt"), "_skip")
    n = F.col("_at") + F.col("_skip")
    return counted.where(F.col("_new") == 1).select(
        base, *[F.col("_row")[c].alias(c) for c in payload],
        F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), n.cast("string"))).alias("name"))
