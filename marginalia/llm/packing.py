"""Sequence packing along a space-filling curve.

Documents become token ids and a hashed vector, projected to three dimensions; the Hilbert key of
that point orders them, so that neighbours on the curve are documents of similar wording. The curve
is cut into ranges (one task each, balanced by a sample of keys; equal keys are told apart by
``doc_id``, so a group of copies is cut as well), and every range is filled into sequences one
document after another. The tail of a range is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged, text_batches
from .words import ListCache, Segments, char_table, codepoints, ragged

LENGTH = 1024
DIMENSIONS, BITS = 3, 10
STOP = 0  # the id after a document
SPECIAL = "<|endoftext|>"  # the one special string of the vocabulary


@cache
def tokenizer(ranks_path: str):
    """The byte-level BPE of the rank file, with the one special string of its vocabulary."""
    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: len(ranks)})


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _token_bytes(ranks_path: str) -> np.ndarray:
    """Number of bytes of every id."""
    bpe = tokenizer(ranks_path)
    return np.array([len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)], dtype=np.int64)


def _encode_parts(parts: list[str], alone: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts one after another, and their number for each. Parts that are not ``alone``
    keep their tokens when they are laid end to end, so one call encodes them all, and the bytes of
    the tokens tell where a part ends."""
    bpe = tokenizer(ranks_path)
    lists: list[np.ndarray] = [np.zeros(0, dtype=np.uint16)] * len(parts)
    together = np.flatnonzero(~alone).tolist()
    if together:
        joined = "".join([parts[i] for i in together])
        ids = bpe.encode_to_numpy(joined, disallowed_special=())
        if joined.isascii():
            sizes = np.array([len(parts[i]) for i in together])
        else:
            sizes = np.array([len(parts[i].encode("utf-8", "surrogatepass")) for i in together])
        ends = np.searchsorted(np.cumsum(_token_bytes(ranks_path)[ids]), np.cumsum(sizes)) + 1
        for i, one in zip(together, np.split(ids.astype(np.uint16), ends[:-1])):
            lists[i] = one
    for i in np.flatnonzero(alone).tolist():
        special = SPECIAL in parts[i]
        lists[i] = np.array(bpe.encode(parts[i], allowed_special="all") if special else bpe.encode_ordinary(parts[i]), dtype=np.uint16)
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.concatenate(lists), lengths


def tokenize(texts: list[str], ranks_path: str, cache_: ListCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their number for each text.

    A single space between two characters that are no white space always starts a token of this
    vocabulary's pattern and ends the one before, so the parts between are encoded alone, each
    different part once per task. Parts that begin with such a space and end with no white space may
    be encoded in one string.
    """
    cp, starts = codepoints(texts)
    if not len(cp):
        return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
    solid = ~char_table("isspace")[cp]
    begins = np.zeros(len(cp), dtype=bool)
    begins[1:-1] = (cp[1:-1] == 0x20) & solid[:-2] & solid[2:]
    seg = Segments(cp, starts, begins)
    codes, first = seg.classes()
    whole = "".join(texts)
    alone = ~(begins[seg.start] & solid[seg.start + seg.length - 1])
    alone[np.isin(seg.start, starts)] = True  # the first part of a text has no space of its own to begin with
    if SPECIAL in whole:
        at = np.array([m.start() for m in re.finditer(re.escape(SPECIAL), whole)])
        alone[np.searchsorted(seg.start, at, side="right") - 1] = True

    def work(new):
        rows = first[new]
        parts = [whole[a:b] for a, b in zip(seg.start[rows].tolist(), (seg.start[rows] + seg.length[rows]).tolist())]
        return _encode_parts(parts, alone[rows], ranks_path)

    at = cache_.rows(seg.hash[first], work)
    ids, lengths = ragged(cache_.offsets, cache_.data, at[codes])
    return ids, np.bincount(seg.text, weights=lengths, minlength=len(texts)).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (a row each, ``bits`` bits per coordinate)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [v ^ flip for v in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> bit) & 1)
    return key


@cache
def _directions(size: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((size, dimensions)).astype(np.float32)


def curve_keys(ids: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents given by their ids: the mean of the ids' fixed random vectors (the
    projection of the hashed bag of tokens), squashed to the cube. A document without ids lies in its middle."""
    table = _directions(1 << 16, dimensions)
    ends = np.cumsum(counts)
    point = np.zeros((len(counts), dimensions))
    full = np.flatnonzero(counts)
    if len(full):
        for d in range(dimensions):
            point[full, d] = np.add.reduceat(table[ids, d], (ends - counts)[full]) / counts[full]
    cube = (np.tanh(point * 3) + 1) / 2
    return hilbert_keys(np.minimum((cube * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def token_table(docs: DataFrame, ranks: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, curve, ids): ids as little-endian unsigned 16-bit numbers, the stop id last. A null
    text counts as an empty one."""
    ranks = ranks or default_ranks()

    def run(batches):
        cache_ = ListCache()
        for batch, texts in text_batches(batches):
            ids, counts = tokenize(texts, ranks, cache_)
            curve = curve_keys(ids, counts)
            ends = np.cumsum(counts)
            stop = np.array([STOP], dtype="<u2").tobytes()
            raw = ids.astype("<u2").tobytes()
            packed = [raw[2 * a:2 * b] + stop for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve, pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "curve", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, "doc_id long, curve long, ids binary")


PIECE = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _fill(rows, length: int, space: int):
    """Pieces of one range of documents (doc_id, ids array), sequences numbered from ``space``. Holds
    one open sequence at a time."""
    open_, used, sequence = [], 0, space
    for doc, ids in rows:
        at = 0
        while at < len(ids):
            part = ids[at:at + length - used]
            open_.append((doc, at, part, len(ids)))
            at, used = at + len(part), used + len(part)
            if used == length:
                offset = 0
                for d, start, p, total in open_:
                    yield d, start, len(p), total, sequence, offset, p
                    offset += len(p)
                open_, used, sequence = [], 0, sequence + 1
    room = offset = 0
    while open_:
        if not room:
            room, offset = 1 << (used.bit_length() - 1), 0
            used -= room
        d, start, p, total = open_.pop(0)
        if len(p) > room:
            open_.insert(0, (d, start + room, p[room:], total))
            p = p[:room]
        yield d, start, len(p), total, sequence, offset, p
        offset, room = offset + len(p), room - len(p)
        if not room:
            sequence += 1


def pack(docs: DataFrame, length: int = LENGTH, ranges: int | None = None, ranks: str | None = None,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece of a document (see ``PIECE``; ids as in ``token_table``), every id in one piece.

    Texts are tokenized once; the ids are staged, so that the sampling of the ranges reads only keys.
    ``sequence_id`` is the range's number times 2**40 plus a count, unique and without meaning.
    An empty table gives no piece; an empty or null text gives its stop id. Repeated rows are packed
    each on its own (next to each other).
    """
    spark = docs.sparkSession
    ids = staged(token_table(docs, ranks, text, key), "packing-ids")
    ranges = ranges or partitions(spark)
    ordered = ids.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")

    def run(batches):
        from pyspark import TaskContext

        def rows():
            for batch in batches:
                column = batch.column("ids")
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    yield doc, np.frombuffer(column[i].as_buffer(), dtype="<u2")

        def emit(out):
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array([p.tobytes() for p in columns[6]], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        out = []
        for piece in _fill(rows(), length, TaskContext.get().partitionId() << 40):
            out.append(piece)
            if len(out) == 8192:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return ordered.mapInArrow(run, PIECE)


def crc_of_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` (of little-endian unsigned 32-bit ids) in place of the ids."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            crc = [zlib.crc32(np.frombuffer(column[i].as_buffer(), dtype="<u2").astype("<u4").tobytes())
                   for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(crc, pa.int64())],
                                             names=[*names, "ids_crc32"])

    return pieces.select(*names, "ids").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "ids_crc32"]))
