"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first,
to the shard with the least load so far.

The heap runs on the driver over the sizes of the groups with the number of groups of each: sizes add
up to all bytes, so there are at most the square root of twice the bytes of different ones (14 million
for 100 TB, in flat arrays). Groups of one size are dealt at once: the shards whose loads are less than a size
apart take turns in a fixed order until the next shard joins them. A group's rank among those of its
size then tells its shard. Every group is placed by this one rule, whatever its size and their number.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

PART_ROWS = 200_000  # rows numbered by one task (about)
HOT = 1000  # a group with more than one in so many rows finds its shard by a broadcast


def schedule(sizes: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, list[int]]]:
    """For (size, number of groups) by falling size: (size, first rank, turns). A group of a rank from the
    first on gets shard ``turns[(rank - first) % len(turns)]``. Each goes to the least loaded shard, among
    equally loaded ones to the one with the smallest number."""
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        done = 0
        while done < count:
            if count - done <= 4 * shards:
                turns = []
                for _ in range(count - done):
                    load, s = heap[0]
                    heapq.heapreplace(heap, (load + size, s))
                    turns.append(s)
                yield size, done, turns
                break
            order = sorted(heap)
            least, first = order[0]
            near = [x for x in order if x < (least + size, first)] or order[:1]
            rounds = (count - done) // len(near)
            if size and len(near) < shards:  # stop short of the next shard's turn
                rounds = min(rounds, max(1, (order[len(near)][0] - least) // size - 1))
            yield size, done, [s for _, s in near]
            heap = [(load + rounds * size, s) for load, s in near] + order[len(near):]
            heapq.heapify(heap)
            done += rounds * len(near)


def _place(groups: DataFrame, shards: int) -> DataFrame:
    """(_bytes, _turns): for every size its (first rank, turns) in order of rank."""
    histogram = groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("_n")).toArrow()
    size, count = (histogram.column(c).to_numpy() for c in ("_bytes", "_n"))
    falling = np.argsort(-size)
    sizes, ranks, flat, ends = array("q"), array("q"), array("i"), array("q", [0])
    for s, rank, turns in schedule(zip(size[falling].tolist(), count[falling].tolist()), shards):
        sizes.append(s)
        ranks.append(rank)
        flat.extend(turns)
        ends.append(len(flat))
    turns = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
    table = pa.table({"_bytes": pa.array(np.array(sizes, dtype=np.int64)), "rank": pa.array(np.array(ranks, dtype=np.int64)), "turns": turns})
    placed = groups.sparkSession.createDataFrame(table, "_bytes long, rank long, turns array<int>")
    return placed.groupBy("_bytes").agg(F.sort_array(F.collect_list(F.struct("rank", "turns"))).alias("_turns"))


def _numbered(rows: DataFrame, within: list[str], order: list, by: str, total: int, out: str) -> DataFrame:
    """Number the rows of each ``within`` from 0 on, in parts by the hash of ``by`` that hold about
    ``PART_ROWS`` rows at most: a row per part crosses them."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(total // PART_ROWS + 1)))
    ahead = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = parted.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*within, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    at = F.row_number().over(W.partitionBy(*within, "_part").orderBy(*order))
    return (parted.withColumn("_at", at).join(before, [*within, "_part"])
            .withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before"))


def assign(rows: DataFrame, shards: int, group: str = "group_key", size: str = "size", key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot`` (0, 1, ... without gaps within a shard) to narrow rows.

    Rows of equal ``group`` (null counts as '') get one shard; a null size counts as 0. Groups of equal size and
    the rows of a shard follow the hash, then the value, of their key; rows alike in all columns are
    interchangeable. A group may hold any share of the rows: sizes are pre-aggregated, the shards of
    the largest groups (fewer than ``HOT``) are broadcast, and a shard's rows are numbered in parts.
    """
    named = rows.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    sized = F.coalesce(F.col(size), F.lit(0)).cast("long")
    groups = staged(named.groupBy("_g").agg(F.sum(sized).alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "shard-groups")
    number, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    ranked = _numbered(groups, ["_bytes"], ["_g"], "_g", number, "_rank").join(_place(groups, shards), "_bytes")
    turn = F.element_at(F.filter("_turns", lambda t: t["rank"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_turn", turn)
    shard = F.get(F.col("_turn.turns"), ((F.col("_rank") - F.col("_turn.rank")) % F.size("_turn.turns")).cast("int"))
    placed = staged(ranked.select("_g", "_rows", shard.alias("shard")), "shard-of-groups")
    large = F.col("_rows") * HOT > total  # fewer than HOT groups
    hot = placed.where(large).select("_g", F.col("shard").alias("_hot"))
    known = named.join(F.broadcast(hot), "_g", "left")
    cold = known.where("_hot IS NULL").drop("_hot").join(placed.where(~large).select("_g", "shard"), "_g")
    whole = cold.unionByName(known.where("_hot IS NOT NULL").withColumnRenamed("_hot", "shard")).drop("_g")
    order = [F.col(f"`{c}`") for c in [key, *[x for x in rows.columns if x != key]]]
    return _numbered(whole, ["shard"], order, key, total, "slot")


def shard_documents(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents of equal text stay together; a size is the
    text's UTF-8 bytes plus 16. A null text is an empty one. Texts are read once; what moves is narrow.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = staged(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("group_key")), "shard-rows")
    return assign(rows, shards).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                                       F.col("slot").cast("long").alias("slot"))
