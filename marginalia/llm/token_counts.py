"""Token counts of a byte-pair model, by merging many letter runs at once as numpy arrays.

A text is cut between two characters that no piece of the vocabulary holds side by side: no merge
can cross such a place, so the runs are exact sub-problems. Equal runs are worked out once per task.
All runs of a batch are one ragged array of symbols. In every round each run applies its pair of
lowest rank, all runs at the same time; the symbols that survive are the tokens.

Within a run the library merges the best pair first and of equal ones the leftmost. A round may take
all places of the lowest rank together if the merged piece can't be part of a pair that ranks as
low or lower; of any other rank only the leftmost place is taken. Runs longer than ``LONG`` symbols
would need too many rounds; they take the same steps from a heap of (rank, place), in n log n.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches
from .words import ListCache, Segments, codepoints, ragged

MARK = "▁"  # how the vocabulary writes a space
LONG = 128  # symbols from which a run takes the heap; both ways give the same symbols
NONE = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class MergeTable:
    """Which symbols merge into which, at what rank, read from a SentencePiece file of kind BPE.

    Symbols are the pieces, the characters that occur in pieces, and four for any other character,
    by its number of UTF-8 bytes (0 to 3). ``weight`` is the number of tokens a surviving symbol
    stands for: one for a piece, else one for each byte.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        how = proto.normalizer_spec
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not plain or any(
                p.type in (4, 5) for p in proto.pieces):
            raise ValueError(f"{path}: not a byte-pair model with byte fallback and without normalisation")
        score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        level = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        chars = sorted({c for piece in score for c in piece})
        names = list(dict.fromkeys([*chars, *score]))
        number = {name: i + 4 for i, name in enumerate(names)}
        self.weight = np.array([1, 2, 3, 4, *[1 if n in score else len(n.encode()) for n in names]], dtype=np.int64)
        self.symbol = np.repeat(np.array([0, 1, 2, 3], dtype=np.int32), [0x80, 0x780, 0xF800, 0x100000])
        self.symbol[[ord(c) for c in chars]] = [number[c] for c in chars]

        self.size = len(names) + 4
        merges = [(number[piece[:i]] * self.size + number[piece[i:]], level[s], number[piece])
                  for piece, s in score.items() for i in range(1, len(piece)) if piece[:i] in number and piece[i:] in number]
        merges.sort()
        keys, ranks, products = zip(*merges) if merges else ((-1,), (NONE,), (0,))
        self.keys, self.ranks, self.products = (np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32),
                                                np.array(products, dtype=np.int32))
        rank_of = np.full(self.size, NONE, dtype=np.int64)
        rank_of[self.products] = self.ranks
        self.one_by_one = np.zeros(len(level) + 1, dtype=bool)  # ranks of which places are taken singly
        for side in (self.keys // self.size, self.keys % self.size):
            low = self.ranks <= rank_of[side]
            self.one_by_one[rank_of[side][low & (rank_of[side] < NONE)]] = True
        many = np.bincount(rank_of[rank_of < NONE].astype(np.int64), minlength=len(level) + 1) > 1
        self.one_by_one |= many
        self.find = {k: (r, p) for k, r, p in zip(keys, ranks, products)}

        joints = {(ord(a), ord(b)) for piece in score for a, b in zip(piece, piece[1:])}
        inside = sorted({c for joint in joints for c in joint})
        self.joint_number = np.zeros(0x110000, dtype=np.int32)
        self.joint_number[inside] = np.arange(1, len(inside) + 1)
        self.joint = np.zeros((len(inside) + 1, len(inside) + 1), dtype=bool)
        if joints:
            first, second = np.array(sorted(joints)).T
            self.joint[self.joint_number[first], self.joint_number[second]] = True

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of every pair of symbols, ``NONE`` for pairs that don't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.products[at]


@cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _merge_long(symbols: list[int], table: MergeTable) -> int:
    """Tokens of one run, best pair first and of equal ones the leftmost, from a heap."""
    n, size, find = len(symbols), table.size, table.find
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def look(a: int, b: int) -> None:
        found = find.get(symbols[a] * size + symbols[b])
        if found:
            heapq.heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))

    for a in range(n - 1):
        look(a, a + 1)
    while heap:
        _, a, left, right, product = heapq.heappop(heap)
        b = after[a]
        if symbols[a] != left or b >= n or symbols[b] != right:
            continue
        symbols[a], symbols[b], after[a] = product, -1, after[b]
        if after[b] < n:
            before[after[b]] = a
            look(a, after[b])
        if before[a] >= 0:
            look(before[a], a)
    return int(table.weight[[s for s in symbols if s >= 0]].sum())


def _merge_rounds(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> np.ndarray:
    """Tokens of every run; ``symbols`` holds the runs one after another, none of them empty."""
    counts = np.zeros(len(lengths), dtype=np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    rank, product = np.full(len(symbols), NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)

    def refresh(at: np.ndarray) -> None:
        inside = np.zeros(len(at), dtype=bool)
        not_last = at < len(symbols) - 1
        inside[not_last] = run[at[not_last]] == run[at[not_last] + 1]
        rank[at[~inside]] = NONE
        rank[at[inside]], product[at[inside]] = table.pairs(symbols[at[inside]], symbols[at[inside] + 1])

    refresh(np.arange(len(symbols)))
    while len(symbols):
        start = np.flatnonzero(np.diff(run, prepend=-1))
        size = np.diff(start, append=len(run))
        lowest = np.minimum.reduceat(rank, start)
        done = lowest == NONE
        if done.any():
            over = np.repeat(done, size)
            counts += np.bincount(run[over], weights=table.weight[symbols[over]], minlength=len(counts)).astype(np.int64)
            stay = ~over
            symbols, run, rank, product = symbols[stay], run[stay], rank[stay], product[stay]
            lowest, size = lowest[~done], size[~done]
            if not len(symbols):
                break
        place = np.flatnonzero(rank == np.repeat(lowest, size))
        chain = np.flatnonzero(np.diff(place, prepend=-2) != 1)  # neighbouring places overlap: every second one
        nth = np.arange(len(place)) - np.repeat(chain, np.diff(chain, append=len(place)))
        owner = run[place]
        leftmost = np.diff(owner, prepend=-1) != 0
        place = place[np.where(table.one_by_one[rank[place]], leftmost, nth % 2 == 0)]
        symbols[place] = product[place]
        stay = np.ones(len(symbols), dtype=bool)
        stay[place + 1] = False
        moved = np.cumsum(stay) - 1
        at = moved[place]
        symbols, run, rank, product = symbols[stay], run[stay], rank[stay], product[stay]
        refresh(np.unique(np.concatenate([at, at[at > 0] - 1])))
    return counts


def merged_counts(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable, long: int = LONG) -> np.ndarray:
    """Tokens of every run of symbols."""
    counts = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    short = np.flatnonzero(lengths <= long)
    data, sizes = ragged(offsets, symbols, short)
    counts[short] = _merge_rounds(data, sizes, table)
    for i in np.flatnonzero(lengths > long).tolist():
        counts[i] = _merge_long(symbols[offsets[i]:offsets[i + 1]].tolist(), table)
    return counts


def count_texts(texts: list[str], model: str, cache_: ListCache, long: int = LONG) -> np.ndarray:
    """Number of tokens of every text; an empty one has none."""
    table = merge_table(model)
    cp, starts = codepoints([" " + t if t else "" for t in texts])
    if not len(cp):
        return np.zeros(len(texts), dtype=np.int64)
    cp = np.where(cp == 0x20, np.uint32(ord(MARK)), cp)
    number = table.joint_number[cp]
    begins = np.ones(len(cp), dtype=bool)
    begins[1:] = ~table.joint[number[:-1], number[1:]]
    seg = Segments(cp, starts, begins)
    codes, first = seg.classes()

    def work(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = first[new]
        symbols, lengths = ragged(np.append(seg.start, len(cp)), table.symbol[cp], rows)
        return merged_counts(symbols, lengths, table, long), np.ones(len(rows), dtype=np.int64)

    at = cache_.rows(seg.hash[first], work)
    return np.bincount(seg.text, weights=cache_.data[at][codes], minlength=len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "n_tokens",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the number of tokens the library gives the whole text, without begin and
    end tokens. Null and empty texts have 0, repeated rows are counted each, an empty table gives an
    empty one. Columns that are not kept play no part, whatever their names."""
    model = model or default_model()
    kept = docs.select(*keep).schema
    schema = T.StructType([*kept.fields, T.StructField(out, T.LongType())])
    carried = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]

    def run(batches):
        cache_ = ListCache()
        for batch, texts in text_batches(batches):
            counts = count_texts(texts, model, cache_)
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_k{i}") for i in range(len(keep))], pa.array(counts)],
                                             names=[*keep, out])

    return docs.select(*carried, F.col(text).alias("_text")).mapInArrow(run, schema)
