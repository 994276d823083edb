"""The pieces of a public vocabulary, found in many equally long words at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from .words import mix

MARK = "▁"  # stands for a space at the start of a word, as the vocabulary writes it
_STEP = np.uint64(0xA0761D6478BD642F)
_SHIFT = np.uint64(42)


def _start(n: int) -> np.ndarray:
    return np.full(n, 0x2545F4914F6CDD1D, dtype=np.uint64)


def _extend(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return h * _STEP + mix(cp)


class PieceTable:
    """Sorted 64-bit keys of pieces with their ids; lookups are binary searches behind a bit filter."""

    def __init__(self, pieces: list[str], ids: list[int]):
        keys = np.empty(len(pieces), dtype=np.uint64)
        for k, piece in enumerate(pieces):
            h = _start(1)
            for c in piece:
                h = _extend(h, np.array([ord(c)], dtype=np.uint32))
            keys[k] = mix(h)[0]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.keys >> _SHIFT] = True
        self.longest = max(map(len, pieces))

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, ids) for every span of the words' columns that is a piece in some rows,
        by end then by start, so that a dynamic program may run along."""
        n, length = words.shape
        hashes: list[np.ndarray] = []  # of the spans that start at each column and end at the current one
        for end in range(1, length + 1):
            hashes.append(_start(n))
            first = max(0, end - self.longest)
            for start in range(first, end):
                hashes[start] = h = _extend(hashes[start], words[:, end - 1])
                key = mix(h)
                rows = np.flatnonzero(self.maybe[key >> _SHIFT])
                if len(rows):
                    at = np.searchsorted(self.keys, key[rows])
                    at[at == len(self.keys)] = 0
                    good = self.keys[at] == key[rows]
                    if good.any():
                        yield start, end, rows[good], self.ids[at[good]]
            if first:
                hashes[first - 1] = hashes[first - 1][:0]


@cache
def load_model(path: str):
    """(pieces, scores, ids of the 256 byte pieces) of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1]
    at_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    return normal, [at_byte[b] for b in range(256)] if len(at_byte) == 256 else None, len(proto.pieces)


@cache
def piece_table(path: str) -> PieceTable:
    normal, _, _ = load_model(path)
    return PieceTable([p for p, _, _ in normal], [i for _, _, i in normal])


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")
