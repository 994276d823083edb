"""SentencePiece encoding and decoding by Viterbi over many equally long words at once.

The text is cut wherever no piece of the vocabulary holds the two neighbouring characters: the best
segmentation can't cross such a place, so the parts are exact sub-problems. Equal parts are worked
out once per task. Equally long ones advance together, column by column: substring hashes probe the
sorted piece keys, and vectorised maxima store the back pointers.

Scores are those of the model file. The best path is the one with the highest sum of scores; ties
take the longer last piece. A character in no path is spelled in byte pieces. As the library does, a
space stands before the text and spaces are written U+2581; a U+2581 of the text itself is spelled
in bytes, so that decoding gives back every text exactly.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as P
from .common import text_batches
from .words import ListCache, Segments, codepoints, ragged

_LITERAL = 0x110000  # stands for a U+2581 of the text
UNKNOWN_PENALTY = 10.0
LONG = 128  # words with more characters have few mates; each is worked out alone, to the same path


@cache
def _joints(model: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the characters that occur in longer pieces, and which pairs of them do so side by side."""
    normal, _, _ = P.load_model(model)
    pairs = {(ord(a), ord(b)) for piece, _, _ in normal for a, b in zip(piece, piece[1:])}
    chars = sorted({c for pair in pairs for c in pair})
    number = np.zeros(0x110001, dtype=np.int32)
    number[chars] = np.arange(1, len(chars) + 1)
    together = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
    for a, b in pairs:
        together[number[a], number[b]] = True
    return number, together


@cache
def _scores(model: str) -> tuple[np.ndarray, float]:
    normal, _, size = P.load_model(model)
    scores = np.zeros(size)
    for _, score, i in normal:
        scores[i] = score
    return scores, min(s for _, s, _ in normal) - UNKNOWN_PENALTY


@cache
def _piece_scores(model: str) -> dict[str, tuple[float, int]]:
    return {piece: (score, i) for piece, score, i in P.load_model(model)[0]}


@cache
def _surfaces(model: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id one after another, and where they start. Ids that stand for nothing have none."""
    normal, byte_ids, size = P.load_model(model)
    out = [b""] * size
    for piece, _, i in normal:
        out[i] = piece.replace(P.MARK, " ").encode()
    for b, i in enumerate(byte_ids or ()):
        out[i] = bytes([b])
    offsets = np.zeros(size + 1, dtype=np.int64)
    np.cumsum([len(x) for x in out], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(out), dtype=np.uint8)


def viterbi(words: np.ndarray, model: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best segmentations of equally long words, from the last piece to the first: a list of
    (rows, starts, ids), id -1 for an unknown character."""
    table, (scores, unknown) = P.piece_table(model), _scores(model)
    n, length = words.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((length + 1, n), dtype=np.int32)
    piece = np.full((length + 1, n), -1, dtype=np.int64)
    single = np.zeros((length + 1, n), dtype=bool)

    def pass_unknown(end: int) -> None:
        rows = np.flatnonzero(~single[end])
        score = best[end - 1][rows] + unknown
        better = score > best[end][rows]
        rows = rows[better]
        best[end][rows], back[end][rows], piece[end][rows] = score[better], end - 1, -1
        single[end] = True

    done = 0
    for start, end, rows, ids in table.matches(words):
        while done < end - 1:
            done += 1
            pass_unknown(done)
        score = best[start][rows] + scores[ids]
        better = score > best[end][rows]
        hit = rows[better]
        best[end][hit], back[end][hit], piece[end][hit] = score[better], start, ids[better]
        if end == start + 1:
            single[end][rows] = True
    while done < length:
        done += 1
        pass_unknown(done)
    path, at, rows = [], np.full(n, length), np.arange(n)
    while len(rows):
        end = at[rows]
        path.append((rows, back[end, rows], piece[end, rows]))
        at[rows] = back[end, rows]
        rows = rows[at[rows] > 0]
    return path


def _long_path(word: np.ndarray, model: str) -> np.ndarray:
    """What ``viterbi`` finds for one word, by the same recurrence over a dictionary of the pieces: ids
    from the last piece to the first, an unknown character as -1 minus its code point."""
    table, (_, unknown), longest = _piece_scores(model), _scores(model), P.piece_table(model).longest
    text = np.minimum(word, 0x10FFFF).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    best, back = [0.0], [(0, -1)]
    for end in range(1, len(text) + 1):
        top, via, single = -np.inf, (end - 1, -1), False
        for start in range(max(0, end - longest), end):
            found = table.get(text[start:end])
            if found is not None:
                single = start == end - 1
                if best[start] + found[0] > top:
                    top, via = best[start] + found[0], (start, found[1])
        if not single and best[end - 1] + unknown > top:
            top, via = best[end - 1] + unknown, (end - 1, -1)
        best.append(top)
        back.append(via)
    out, at = [], len(text)
    while at:
        start, piece = back[at]
        out.append(piece if piece >= 0 else -1 - int(word[start]))
        at = start
    return np.array(out, dtype=np.int64)


def _encode_words(seg: Segments, rows: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray]:
    byte_ids = P.load_model(model)[1]
    values: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    lengths = seg.length[rows]
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        if length > LONG:
            for i in at:
                path = _long_path(seg.matrix(rows[i:i + 1], int(length))[0], model)
                owner.append(np.full(len(path), i))
                values.append(path)
            continue
        words = seg.matrix(rows[at], int(length))
        for own, starts, ids in viterbi(words, model):
            owner.append(at[own])
            values.append(np.where(ids >= 0, ids, -1 - words[own, starts].astype(np.int64)))
    owner_all, value_all = np.concatenate(owner), np.concatenate(values)
    order = np.argsort(owner_all[::-1], kind="stable")  # first piece first
    owner_all, value_all = owner_all[::-1][order], value_all[::-1][order]
    if (value_all < 0).any():
        spelled_owner, spelled = [], []
        for o, v in zip(owner_all.tolist(), value_all.tolist()):
            if v >= 0:
                spelled.append(v)
                spelled_owner.append(o)
                continue
            c = -1 - v
            raw = (P.MARK if c == _LITERAL else chr(c)).encode("utf-8", "surrogatepass")
            ids = [byte_ids[b] for b in raw] if byte_ids else [0]
            spelled += ids
            spelled_owner += [o] * len(ids)
        owner_all, value_all = np.array(spelled_owner), np.array(spelled, dtype=np.int64)
    counts = np.bincount(owner_all, minlength=len(rows)).astype(np.int64)
    return value_all.astype(np.uint16 if P.load_model(model)[2] <= 65536 else np.int32), counts


def encode_texts(texts: list[str], model: str, cache_: ListCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their number for each text (none for an empty one)."""
    cp, starts = codepoints([" " + t if t else "" for t in texts])
    cp = cp.copy()
    cp[cp == ord(P.MARK)] = _LITERAL
    cp[cp == 0x20] = ord(P.MARK)
    if not len(cp):
        return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
    number, together = _joints(model)
    num = number[cp]
    begins = np.ones(len(cp), dtype=bool)
    begins[1:] = ~together[num[:-1], num[1:]]
    seg = Segments(cp, starts, begins)
    codes, first = seg.classes()
    at = cache_.rows(seg.hash[first], lambda new: _encode_words(seg, first[new], model))
    ids, lengths = ragged(cache_.offsets, cache_.data, at[codes])
    return ids, np.bincount(seg.text, weights=lengths, minlength=len(texts)).astype(np.int64)


def decode_ids(ids: np.ndarray, counts: np.ndarray, model: str) -> list[str]:
    """The texts of the id lists; bytes that are no UTF-8 become U+FFFD."""
    offsets, surfaces = _surfaces(model)
    raw, lengths = ragged(offsets, surfaces, ids.astype(np.int64))
    size = np.zeros(len(counts) + 1, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    size[1:] = total[np.cumsum(counts)]
    blob = raw.tobytes()
    return [blob[a + 1:b].decode("utf-8", "replace") if b > a else "" for a, b in zip(size[:-1], size[1:])]


def encode(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "ids",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the ids as an array of int. A null text gives null, an empty one no id."""
    model = model or P.default_model()
    schema = docs.select(*keep).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches):
        cache_ = ListCache()
        for batch, texts in text_batches(batches):
            ids, counts = encode_texts(texts, model, cache_)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            absent = batch.column("_text").is_null()
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=absent)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, out])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(docs: DataFrame, model: str | None = None, ids: str = "ids", out: str = "text",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the decoded text; null ids give null."""
    model = model or P.default_model()
    schema = docs.select(*keep).schema.add(out, "string")

    def run(batches):
        for batch in batches:
            lists = batch.column("_ids")
            absent = lists.is_null().to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 256):
                part = lists.slice(at, 256)
                counts = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = decode_ids(part.flatten().to_numpy(zero_copy_only=False), counts, model)
                shown = [None if gone else t for t, gone in zip(texts, absent[at:at + 256])]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(at, 256) for c in keep], pa.array(shown, pa.string())], names=[*keep, out])

    return docs.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
