"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its line
into grades: P(grade >= k) = logistic(f(text) - threshold_k). The expected grade and the tail
probabilities follow. Features are frequencies, so that a text's length alone says nothing: hashed
words, hashed triples of character kinds, and the share of words that repeat the word before.

The fit is a full-batch quasi-Newton descent: every step is a Spark job that sums loss and gradient
over the staged features; the driver holds only the weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled, staged, text_batches
from .words import Segments, char_table, codepoints, mix

FIT_ROWS = 12_000  # rated documents to learn from, at most (about)
WORD_BITS, KINDS = 15, 40
STEPS = 25
PENALTY = 1e-3
SIZE = (1 << WORD_BITS) + KINDS ** 3 + 1


@cache
def _kinds() -> np.ndarray:
    """Kind of every code point: letters by case, digits, spaces, line breaks, each ASCII sign, the rest."""
    out = np.full(0x110000, 6, dtype=np.int64)
    out[char_table("isalpha")] = 1
    out[char_table("isupper")] = 2
    out[char_table("isdigit")] = 3
    out[char_table("isspace")] = 4
    out[10] = 5
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[signs] = 7 + np.arange(len(signs))
    return np.minimum(out, KINDS - 1)


def feature_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts; a feature may come several times, its values add up."""
    cp, starts = codepoints(texts)
    none = np.zeros(0, dtype=np.int64)
    if not len(cp):
        return none, none, np.zeros(0)
    space = char_table("isspace")[cp]
    begins = np.ones(len(cp), dtype=bool)
    begins[1:] = space[1:] != space[:-1]
    seg = Segments(cp, starts, begins, keep=lambda start: ~space[start])
    words = np.maximum(np.bincount(seg.text, minlength=len(texts)), 1)
    word = (mix(seg.hash) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (seg.hash[1:] == seg.hash[:-1]) & (seg.text[1:] == seg.text[:-1])
    kind = _kinds()[cp]
    length = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), length)
    triple = np.zeros(len(cp), dtype=np.int64)
    triple[2:] = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
    inner = np.arange(len(cp)) - starts[:-1][owner] >= 2
    triple, owner = triple[inner] + (1 << WORD_BITS), owner[inner]
    text = np.concatenate([seg.text, owner, seg.text[again]])
    feature = np.concatenate([word, triple, np.full(int(again.sum()), SIZE - 1)])
    value = np.concatenate([1 / words[seg.text], 1 / np.maximum(length, 1)[owner], 1 / words[seg.text[again]]])
    return text, feature, value


@dataclass
class Grader:
    """Weights and ascending thresholds; ``grades`` are the ratings from the lowest to the highest."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k) for every text (rows) and every grade above the lowest."""
        text, feature, value = feature_stream(texts)
        line = np.bincount(text, weights=self.weights[feature] * value, minlength=len(texts))
        return _logistic(line[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _loss(x: np.ndarray, rows: list, grades: np.ndarray, levels: int) -> tuple[float, np.ndarray]:
    """Loss and gradient of a batch; ``x`` holds the weights, the first threshold and log gaps."""
    w, first, gaps = x[:SIZE], x[SIZE], x[SIZE + 1:]
    cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    n = len(grades)
    text = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    feature = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows])
    line = np.bincount(text, weights=w[feature] * value, minlength=n)
    tail = np.column_stack([np.ones(n), _logistic(line[:, None] - cuts[None, :]), np.zeros(n)])
    at = np.arange(n)
    p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-12)
    slope = tail * (1 - tail)  # of a tail by the line
    by_line = -(slope[at, grades] - slope[at, grades + 1]) / p
    by_cut = np.zeros(levels - 1)
    lower, upper = grades > 0, grades < levels - 1
    np.add.at(by_cut, grades[lower] - 1, (slope[at, grades] / p)[lower])
    np.add.at(by_cut, grades[upper], -(slope[at, grades + 1] / p)[upper])
    out = np.zeros_like(x)
    out[:SIZE] = np.bincount(feature, weights=by_line[text] * value, minlength=SIZE)
    out[SIZE] = by_cut.sum()
    for k in range(len(gaps)):
        out[SIZE + 1 + k] = by_cut[k + 1:].sum() * np.exp(gaps[k])
    return float(-np.log(p).sum()), out


def _descend(evaluate, x: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps where the loss would rise."""
    loss, grad = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, stack = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            stack.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        else:
            d *= 1 / max(np.sqrt(grad @ grad), 1e-12)
        for (s, y), a in zip(pairs, reversed(stack)):
            d += s * (a - (y @ d) / (s @ y))
        step = 1.0
        while step > 1e-3:
            trial = x - step * d
            new_loss, new_grad = evaluate(trial)
            if new_loss <= loss:
                break
            step /= 4
        else:
            return x
        if (new_grad - grad) @ (trial - x) > 1e-12:
            pairs = [*pairs, (trial - x, new_grad - grad)][-memory:]
        done = loss - new_loss < 1e-5 * abs(loss)
        x, loss, grad = trial, new_loss, new_grad
        if done:
            break
    return x


def fit(docs: DataFrame, rows: int = FIT_ROWS, steps: int = STEPS, penalty: float = PENALTY, text: str = "text",
        grade: str = "grade", key: str = "doc_id") -> Grader | None:
    """Learn from the documents with a grade (an integer; null is skipped), about ``rows`` of them at
    most. Fewer than two grades can't be told apart: then there is no model (None)."""
    data = sampled(docs.select(F.col(key), F.col(text).alias("_text"), F.col(grade).cast("long").alias("grade")).filter(
        F.col("grade").isNotNull()), rows, key).select("_text", "grade")

    def build(batches):
        for batch, texts in text_batches(batches, limit=500_000):
            owner, feature, value = feature_stream(texts)
            slot, at = np.unique(owner * SIZE + feature, return_inverse=True)
            total = np.bincount(at, weights=value, minlength=len(slot)) if len(slot) else np.zeros(0)
            offsets = np.searchsorted(slot // SIZE, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("grade"), pa.ListArray.from_arrays(pa.array(offsets), pa.array((slot % SIZE).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(total))], names=["grade", "at", "value"])

    features = staged(data.mapInArrow(build, "grade long, at array<int>, value array<double>"), "quality-features").coalesce(16)  # bounded rows
    counts = {r["grade"]: r["n"] for r in features.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    grades = tuple(sorted(counts))
    if len(grades) < 2:
        return None
    level = {g: k for k, g in enumerate(grades)}
    n = sum(counts.values())
    # Frequencies are small numbers; one scale for all of them makes the first steps useful.
    scale = 30.0

    def evaluate(x):
        def part(batches):
            loss, grad = 0.0, np.zeros(len(x))
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    piece = batch.slice(at, 1000)
                    own = [(np.asarray(a.values), np.asarray(v.values) * scale) for a, v in zip(piece.column("at"), piece.column("value"))]
                    y = np.array([level[g] for g in piece.column("grade").to_pylist()], dtype=np.int64)
                    one_loss, one_grad = _loss(x, own, y, len(grades))
                    loss, grad = loss + one_loss, grad + one_grad
            yield pa.record_batch({"loss": [loss], "grad": [grad.tobytes()]})

        total, grad = 0.0, np.zeros(len(x))
        for r in features.mapInArrow(part, "loss double, grad binary").collect():  # at most 16 rows
            total, grad = total + r["loss"], grad + np.frombuffer(r["grad"])
        total, grad = total / n, grad / n
        total += 0.5 * penalty * float(x[:SIZE] @ x[:SIZE])
        grad[:SIZE] += penalty * x[:SIZE]
        return total, grad

    above = np.cumsum([counts[g] for g in grades][::-1])[::-1][1:] / n
    cuts = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))
    x = _descend(evaluate, np.concatenate([np.zeros(SIZE), [cuts[0]], gaps]), steps)
    thresholds = x[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(x[SIZE + 1:]))])
    return Grader(x[:SIZE] * scale, thresholds, grades)


def grade(docs: DataFrame, grader: Grader, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``expected_grade`` and ``tails``: P(grade >= k) for the grades above the
    lowest, in order. A null or empty text has no features and gets the prior's probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(grader)  # a fixed number of weights
    schema = docs.select(*keep).schema.add("expected_grade", "double").add("tails", T.ArrayType(T.DoubleType()))

    def run(batches):
        model = shared.value
        steps = np.diff(np.array(model.grades, dtype=float))
        for batch, texts in text_batches(batches, limit=500_000):
            tails = model.tails(texts)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * tails.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(model.grades[0] + tails @ steps),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(tails.ravel()))], names=[*keep, "expected_grade", "tails"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def with_rating(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``grade``: 0 for low quality, 1 for good but toxic text, 2 for good text; null without labels.
    Repeated labels of a document count by their lowest grade."""
    rated = labels.select(F.col(key).alias("_k"), F.when(F.col("quality") == 0, 0).when(
        (F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2).alias("_g"))
    rated = rated.groupBy("_k").agg(F.min("_g").alias("grade"))
    return docs.join(rated, F.col(key) == F.col("_k"), "left").drop("_k")
