"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's word shingles are hashed. One fixed permutation scatters them over a ring; a second one,
shifted by one place for each coordinate, gives all coordinates of the signature (so two permutations
stand for hundreds). Signatures are cut into bands; documents that share a band are candidates.

Documents with equal shingle sets are one class and only classes go on. Within a band the classes are
not paired with each other: in every round a few of them (pivots: those that share most bands with
others first) are compared with the rest, and only across components not joined yet. What is still
apart in a shared band after that goes through an exact prefix filter on the shingles themselves, so
the components are those of all links; nothing is capped. Links are confirmed on the full sets.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, text_batches
from .graph import components
from .words import Segments, codepoints, mix

RING = 1 << 20
SHINGLE_WORDS, SIMILARITY = 5, 80  # words a shingle, least similarity in hundredths
PIVOT_ROUNDS = ((0, 1), (1, 3))  # ranks of the pivots of a band in each round
_SPACES = [0x20, *range(0x09, 0x0E)]


def bands_for(similarity: int) -> tuple[int, int]:
    """(bands, rows): a pair at the least similarity is missed with a probability below 1e-8."""
    rows = 6 if similarity >= 85 else 5 if similarity >= 80 else 4 if similarity >= 70 else 3
    p = (similarity / 100) ** rows
    return int(np.ceil(np.log(1e-8) / np.log1p(-p))), rows


@cache
def _ring(coordinates: int) -> np.ndarray:
    """The second permutation, a row of shifted values for each place of the ring."""
    pi = np.random.default_rng(7).permutation(RING).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)


@cache
def _space() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[_SPACES] = True
    return out


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, text by text, and where each text's begin).

    A-Z count as a-z; words are runs of characters other than the six ASCII white spaces. A text of
    fewer words has its whole sequence as its one shingle, a text without words has none.
    """
    cp, starts = codepoints(texts)
    if not len(cp):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32)
    space = _space()[cp]
    begins = np.ones(len(cp), dtype=bool)
    begins[1:] = space[1:] != space[:-1]
    seg = Segments(cp, starts, begins, keep=lambda start: ~space[start])
    count = np.bincount(seg.text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(seg.hash)
    place = np.arange(n) - first[:-1][seg.text]
    size = np.minimum(count, words)[seg.text]
    heads = np.flatnonzero(place + size <= count[seg.text])
    total = np.full(len(heads), 0x9E37, dtype=np.uint64)
    for k in range(words):
        inside = size[heads] > k
        at = np.minimum(heads + k, n - 1)
        total = np.where(inside, mix(total ^ seg.hash[at]) * np.uint64(0x2127599BF4325C37) + np.uint64(k), total)
    total = mix(total)
    owner = seg.text[heads]
    codes, _ = pd.factorize(mix(total ^ mix(owner.astype(np.uint64) + np.uint64(1))))
    one = np.zeros(codes.max(initial=-1) + 1, dtype=np.int64)
    one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    owner = owner[one]
    return total[one], np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: a row of ``coordinates`` minima for every non-empty set."""
    ring = _ring(coordinates)
    place = (mix(values ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(RING - 1)).astype(np.int64)
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), coordinates), dtype=np.int32)
    step, k = 8192, 0
    while k < len(full):
        a = offsets[full[k]]
        last = k
        while last + 1 < len(full) and offsets[full[last + 1] + 1] - a <= step:
            last += 1
        b = offsets[full[last] + 1]
        if last == k and b - a > step:  # one long text: block by block
            least = ring[place[a]].copy()
            for at in range(a, b, step):
                np.minimum(least, ring[place[at:min(b, at + step)]].min(axis=0), out=least)
            out[k] = least
        else:
            out[k:last + 1] = np.minimum.reduceat(ring[place[a:b]], offsets[full[k:last + 1]] - a, axis=0)
        k = last + 1
    return out


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketches(docs: DataFrame, words: int, bands: int, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, 128-bit digest of the shingle set, band keys); no band for an empty set."""

    def run(batches):
        for batch, texts in text_batches(batches):
            values, offsets = shingles(texts, words)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            digest = np.zeros((2, len(texts)), dtype=np.uint64)
            keys = np.zeros((0, bands), dtype=np.int64)
            if len(full):
                for k, salt in enumerate((0x1B873593, 0xCC9E2D51)):
                    digest[k, full] = np.add.reduceat(mix(values ^ np.uint64(salt)), offsets[full])
                sig = signatures(values, offsets, bands * rows).astype(np.uint64)
                h = np.tile(mix(np.arange(bands, dtype=np.uint64) + np.uint64(11)), (len(full), 1))
                for r in range(rows):
                    h = mix(h ^ (sig[:, r * bands:(r + 1) * bands] + np.uint64(1)))
                keys = h.view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), *[pa.array(d.view(np.int64)) for d in digest],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, shingles): the hashes of every document's distinct shingles."""

    def run(batches):
        for batch, texts in text_batches(batches):
            values, offsets = shingles(texts, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))],
                names=["doc_id", "shingles"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, "doc_id long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (p, m) whose full sets are similar enough."""
    with_m = pairs.join(sets.select(F.col("doc_id").alias("m"), F.col("shingles").alias("of_m")), "m")
    both = with_m.join(sets.select(F.col("doc_id").alias("p"), F.col("shingles").alias("of_p")), "p")
    shared = F.size(F.array_intersect("of_m", "of_p"))
    return both.select("p", "m", (F.size("of_m") + F.size("of_p")).alias("total"), shared.alias("shared")).filter(
        F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * similarity).select("p", "m")


def _links(classes: DataFrame, docs: DataFrame, words: int, similarity: int, text: str, key: str) -> DataFrame | None:
    """(v, comp): the component of every class that shares a band with another one."""
    exploded = classes.select(F.explode("bands").alias("band"), F.col("rep").alias("v"), F.col("n_shingles").alias("n"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("in_band")).filter("in_band > 1")
    members = exploded.join(shared, "band")
    degree = members.groupBy("v").agg(F.sum("in_band").alias("degree"))
    members = staged(members.join(degree, "v").select("band", "v", "n", "degree", "in_band"), "band-members")
    most = members.agg(F.max("in_band")).first()[0]
    if most is None:
        return None
    ids = members.select(F.col("v").alias("_v")).distinct()
    involved = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_t")).join(
        ids, F.col("doc_id") == F.col("_v"), "left_semi")
    sets = staged(shingle_sets(involved, words, "_t", "doc_id"), "shingle-sets")
    labels = staged(ids.select(F.col("_v").alias("v"), F.col("_v").alias("comp")), "labels")
    tested: list[DataFrame] = []
    for low, high in PIVOT_ROUNDS:
        now = _apart(members, labels).filter(F.col("in_band") > low)
        order = W.partitionBy("band").orderBy(F.desc("degree"), "v")
        pivots = now.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= high).filter(
            F.col("rank") > low).select("band", F.col("v").alias("p"), F.col("n").alias("n_p"), F.col("comp").alias("comp_p"))
        pairs = now.join(pivots, "band").filter(
            (F.col("comp") != F.col("comp_p")) &
            (F.least("n", "n_p") * 100 >= F.greatest("n", "n_p") * similarity)).select(
            F.least("p", "v").alias("p"), F.greatest("p", "v").alias("m")).distinct()
        labels = _joined(labels, pairs, tested, sets, similarity)
        if most <= high:
            return labels
    left = _apart(members, labels).filter(F.col("in_band") > high).select("v", "comp").distinct()
    return _joined(labels, _sharing_prefix(left, sets, similarity), tested, sets, similarity)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their components, of the bands that still hold two components."""
    now = members.join(labels, "v")
    apart = now.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most")
    return now.join(apart.select("band"), "band")


def _joined(labels: DataFrame, pairs: DataFrame, tested: list[DataFrame], sets: DataFrame, similarity: int) -> DataFrame:
    """The labels after the pairs (p, m) have been compared, if they haven't been before."""
    if tested:
        pairs = pairs.join(reduce(DataFrame.union, tested), ["p", "m"], "left_anti")
    pairs = staged(pairs, "pairs")
    tested.append(pairs)
    links = staged(_verified(pairs, sets, similarity), "links")
    if not links.limit(1).count():
        return labels
    edges = links.join(labels.select(F.col("v").alias("p"), F.col("comp").alias("a")), "p").join(
        labels.select(F.col("v").alias("m"), F.col("comp").alias("b")), "m").select("a", "b")
    merged = components(edges)
    return staged(labels.join(merged, F.col("comp") == F.col("node"), "left").select(
        "v", F.coalesce("label", "comp").alias("comp")), "labels")


def _sharing_prefix(nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """All pairs (p, m) of the nodes (v, comp) from two components that can be similar enough, and few others.

    An exact filter: with the shingles of every set in one order, rarest first, two similar sets must
    share a shingle within a prefix of each (the shorter one for the smaller set), and the first
    shared one must leave enough shingles behind it in both. Edited copies begin with shingles of
    their own, so a group of copies that are all too different from each other gives no pair.
    """
    own = sets.join(nodes, F.col("doc_id") == F.col("v")).select(
        "v", "comp", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("sid"), F.explode("shingles").alias("s"))
    common = own.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = own.join(common, "s")
    whole = W.partitionBy("v", "sid")
    ranked = ranked.withColumn("i", F.col("n") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("df", "s")) - 1)
    ceil = lambda x, y: f"CAST(floor(({x} + {y} - 1) / {y}) AS BIGINT)"
    both = 100 + similarity
    ranked = staged(ranked.filter(F.col("i") < F.expr(f"n - {ceil(f'{similarity} * n', 100)} + 1")), "prefixes")
    small = ranked.filter(F.col("i") < F.expr(f"n - {ceil(f'{2 * similarity} * n', both)} + 1")).select(
        "s", F.col("v").alias("v1"), F.col("comp").alias("c1"), F.col("n").alias("n1"), F.col("i").alias("i1"))
    least = F.expr(ceil(f"{similarity} * (n1 + n)", both))
    found = small.join(ranked, "s").filter(
        (F.col("c1") != F.col("comp")) & ((F.col("n1") < F.col("n")) | ((F.col("n1") == F.col("n")) & (F.col("v1") < F.col("v")))) &
        (F.col("n1") * 100 >= F.col("n") * similarity) & (F.least(F.col("n1") - F.col("i1"), F.col("n") - F.col("i")) >= least))
    return found.select(F.least("v1", "v").alias("p"), F.greatest("v1", "v").alias("m")).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: int = SIMILARITY,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Two documents are linked when 100 * shared >= similarity * all of their distinct shingles.
    ``component_id`` is the smallest id reachable over links, the own id included; ``kept`` marks it.
    A null or blank text has no shingle and is linked with nothing. Rows that share an id are one
    document: they are linked with each other and share its fate. A null id is linked with nothing
    and not kept. An empty table gives an empty one.
    """
    bands, rows = bands_for(similarity)
    sketch = staged(sketches(docs, words, bands, rows, text, key), "sketches")
    of_set = ["n_shingles", "set_a", "set_b"]
    filled = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(filled.groupBy(*of_set).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    rep = classes.select(*of_set, "rep")
    labels = _links(classes, docs, words, similarity, text, key)
    if labels is not None:
        rep = rep.join(labels, rep["rep"] == labels["v"], "left").select(
            *of_set, F.coalesce("comp", "rep").alias("rep"))
    out = sketch.drop("bands").join(rep, of_set, "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"),
                      F.coalesce(F.col("doc_id") == found, F.lit(False)).alias("kept"))
