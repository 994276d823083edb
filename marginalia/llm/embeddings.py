"""Near-duplicate vectors by int8 tile products with proven error bounds.

A unit vector x is stored as s * q + e: q has 8-bit integers, s is the scale, and the length of the
rest e is known. By Cauchy-Schwarz the product of two stored vectors differs from the true cosine by
at most |e_x| + (1 + |e_x|) |e_y|. Tiles of vectors are multiplied in small integers (exact in float32);
pairs whose upper bound stays below the threshold are done, pairs whose lower bound reaches it are
links, and only those between are computed again from the vectors in double precision.

Equal vectors are one class with a count. A tile pair gives back a number of links per vector and a
spanning forest of its links, never the pairs, so a large group of near copies costs no more output
than its members. Tile pairs whose centres are too far apart for any link are skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged
from .graph import components

TILE = 2048  # vectors a tile
GROUP = 8  # tiles a side of a block, about; a task holds two sides
SLACK = 1e-5  # room for float32 rounding of the scaled products
CHUNK = 1 << 17  # pairs computed again at a time


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, int8 values, scales, lengths of the rest) of the rows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - q * scale[:, None]
    return unit, q, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-12) + 1e-15


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def tile_links(a: dict, b: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of two tiles, or of one tile with itself (b None, i < j)."""
    other = a if b is None else b
    empty = np.zeros(0, dtype=np.int64)
    if a["unit"].shape[1] != other["unit"].shape[1]:
        return empty, empty
    if b is not None:  # angles obey the triangle inequality
        reach = np.arccos(min(1.0, threshold)) + a["radius"] + other["radius"]
        if reach < np.pi and float(a["centre"] @ other["centre"]) < np.cos(reach) - 1e-9:
            return empty, empty
    whole = np.float32 if a["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    upper = a["q"].astype(whole) @ other["q"].astype(whole).T
    upper *= a["scale"].astype(whole)[:, None]
    upper *= other["scale"].astype(whole)[None, :]
    ea, eb = a["rest"], other["rest"]
    upper += ea.astype(whole)[:, None]  # |e_x| + |e_y| + |e_x| |e_y|, the last at its largest
    upper += (eb * (1 + ea.max()) + SLACK).astype(whole)[None, :]
    i, j = np.nonzero(upper >= threshold)
    if b is None:
        i, j = (v[i < j] for v in (i, j))
    margin = 2 * (ea[i] + eb[j] * (1 + ea.max()) + SLACK)
    unsure = np.flatnonzero(upper[i, j] - margin < threshold)
    good = np.ones(len(i), dtype=bool)
    for at in range(0, len(unsure), CHUNK):
        part = unsure[at:at + CHUNK]
        cosine = np.einsum("nd,nd->n", a["unit"][i[part]], other["unit"][j[part]])
        good[part] = cosine >= threshold
    return i[good], j[good]


def _tile(row: dict) -> dict:
    vectors = np.frombuffer(row["vectors"], dtype="<f8").reshape(row["rows"], -1)
    unit, q, scale, rest = quantise(vectors)
    centre = unit.mean(axis=0)
    norm = np.sqrt(centre @ centre)
    centre = centre / norm if norm > 0 else unit[0]
    radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) + 1e-7
    return {"unit": unit, "q": q, "scale": scale, "rest": rest, "centre": centre, "radius": radius,
            "rep": np.frombuffer(row["reps"], dtype="<i8"), "count": np.frombuffer(row["counts"], dtype="<i8")}


def _tiles(classes: DataFrame, tile: int) -> DataFrame:
    """Vectors of similar signs side by side in tiles: (tile, rows, vectors, reps, counts)."""

    def code(batches):
        for batch in batches:
            lists = batch.column("embedding")
            out = np.zeros(batch.num_rows, dtype=np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)
                plane = np.random.default_rng(int(d)).standard_normal((d, 20))
                out[rows] = ((x @ plane) > 0) @ (1 << np.arange(20)) + (int(d) << 20)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("count"), lists, pa.array(out)],
                                             names=["rep", "count", "embedding", "code"])

    coded = staged(classes.mapInArrow(code, "rep long, count long, embedding array<double>, code long"), "vector-codes")
    ordered = coded.repartitionByRange(partitions(classes.sparkSession), "code", "rep").sortWithinPartitions("code", "rep")

    def build(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def emit():
            nonlocal number, held
            number += 1
            vectors = np.array([h[2] for h in held], dtype="<f8")
            out = pa.RecordBatch.from_pydict({
                "tile": [number], "rows": [len(held)], "vectors": [vectors.tobytes()],
                "reps": [np.array([h[0] for h in held], dtype="<i8").tobytes()],
                "counts": [np.array([h[1] for h in held], dtype="<i8").tobytes()]},
                schema=pa.schema([("tile", pa.int64()), ("rows", pa.int64()), ("vectors", pa.binary()),
                                  ("reps", pa.binary()), ("counts", pa.binary())]))
            held = []
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, tile):
                part = batch.slice(at, tile)
                for row in zip(*(part.column(c).to_pylist() for c in ("rep", "count", "embedding"))):
                    if held and (len(held) == tile or len(held[0][2]) != len(row[2])):
                        yield emit()
                    held.append(row)
        if held:
            yield emit()

    return staged(ordered.mapInArrow(build, "tile long, rows long, vectors binary, reps binary, counts binary"), "tiles")


def linked_vectors(vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id",
                   tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are linked when their cosine in double precision is at least ``threshold`` (> 0).
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id
    reachable (itself included), ``kept`` marks it. Null, empty and zero vectors, vectors with a
    null, NaN or infinite component, and null ids link with nothing; vectors of different length
    neither. A repeated row is the same vector again and counts once. An id given to different
    vectors joins them; its links are those of all of them.
    """
    as_double = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), as_double.alias("embedding"))
    fine = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() &
            F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) &
            F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)))
    plain = rows.filter(fine).select("vec_id", F.transform("embedding", lambda v: v + 0.0).alias("embedding")).distinct()
    member = staged(plain.select("vec_id", "embedding", F.sha2(F.array_join(F.col("embedding").cast("array<string>"), " "), 256).alias("cls")),
                    "vectors")
    classes = member.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("count"),
                                        F.first("embedding").alias("embedding"))
    classes = staged(classes, "vector-classes")
    tiles = _tiles(classes.select("rep", "count", "embedding"), tile)
    sides = max(1, -(-tiles.count() // group))
    mine = F.pmod(F.xxhash64("tile"), F.lit(sides)).cast("int")
    blocks = tiles.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).select(
        F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "tile", "rows", "vectors", "reps", "counts")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("tile").to_dict("records")
        made = [(r["own"], _tile(r)) for r in rows]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def note(a, b, i, j):
            if not len(i):
                return
            if b is None:
                n, rep, count = len(a["rep"]), a["rep"], a["count"]
            else:
                n = len(a["rep"]) + len(b["rep"])
                rep, count, j = np.concatenate([a["rep"], b["rep"]]), np.concatenate([a["count"], b["count"]]), j + len(a["rep"])
            links = (np.bincount(i, weights=count[j], minlength=n) + np.bincount(j, weights=count[i], minlength=n)).astype(np.int64)
            near = _labels(i, j, n)
            used = np.flatnonzero(links)
            found.append((rep[used], links[used], rep[near[used]]))

        same = pdf["g"].iloc[0] == pdf["h"].iloc[0]
        for k, (own, a) in enumerate(made):
            if same:
                note(a, None, *tile_links(a, None, threshold))
            for other, b in made[k + 1:]:
                if same or own != other:
                    note(a, b, *tile_links(a, b, threshold))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
        return pd.DataFrame({"rep": columns[0], "links": columns[1], "near": columns[2]})

    hits = staged(blocks.groupBy("g", "h").applyInPandas(block, "rep long, links long, near long"), "tile-links")
    degree = hits.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(hits.select(F.col("rep").alias("a"), F.col("near").alias("b")).union(
        member.join(classes.select("cls", "rep"), "cls").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
        .filter("a <> b").distinct())
    per_class = classes.join(degree, "rep", "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("links"))
    links = member.join(per_class, "cls").groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(
        joined.select(F.col("node").alias("vec_id"), "label"), "vec_id", "left")
    found_id = F.coalesce("label", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), found_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == found_id, F.lit(False)).alias("kept"))
