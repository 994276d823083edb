"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms and look-alike letters of other scripts become Latin
letters, stacked marks and invisible characters go, and digits or signs inside words become the
letters they stand for. Words are then matched in one pass by an automaton that holds exact words,
word beginnings and exception phrases; a match inside an exception phrase does not count. The weight
of the matches, as it is and per hundred words, gives a probability by a logistic curve.

Lexicon and curve are learned from labelled texts. A term enters when it explains toxic documents
that no earlier term explains (so words that merely come along with a copied text stay out); its
weight is its log odds. A public list of insults is part of every lexicon.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, text_batches

FIT_ROWS = 20_000  # labelled documents to learn from, at most (about)
TERMS = 400  # learned terms, at most
CANDIDATES = 20_000  # terms looked at, at most: those with the strongest evidence
EVIDENCE = 20.0  # least log-likelihood ratio of a term (by chance: about 8e-6)
SUPPORT = 4  # toxic documents that must hold a term
STEMS = range(4, 9)  # letters of the word beginnings that may become terms
THRESHOLD = 0.7
SEED_WEIGHT = 3.0

# Insults, exception phrases, look-alike letters and signs that stand for letters.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting",
           "imbecile", "dumbass", "asshole", "bastard", "bitch", "arschloch", "dummkopf", "vollidiot", "abschaum",
           "connard", "imbécile", "ordure", "salaud", "idiota", "estúpido", "imbécil", "escoria", "cabrón")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "class clown",
              "idiot proof", "not stupid", "not an idiot", "not a loser", "not worthless", "not pathetic")
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁһкмтвнгүԛԝαεορτυικνχβγηρωıɑɡɩᴀʙᴄᴅᴇ",
    "aeopcyxijsdhkmtbhryqwaeoptuikvxbynpwiagiabcde"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
         "|": "i", "€": "e", "+": "t"}

_LOOK = str.maketrans(LOOKALIKES)
_HAS_LOOK = re.compile(f"[{''.join(LOOKALIKES)}]")
# A run of word characters and signs that holds a sign, found in one pass; where in it a word with
# signs begins: at a letter, or at signs with a letter behind them.
_SIGNED = re.compile(r"(?<![\w@$!|€+])[^\W0-9]*+[0-9@$!|€+][\w@$!|€+]*+")
_FROM = re.compile(r"[^\W\d_]|(?<![0-9@$!|€+])[0-9@$!|€+]++[^\W\d_]")
_ANY_SIGN = re.compile(r"[0-9@$!|€+]")
_SIGN = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")


def _letters(match: re.Match) -> str:
    run = match[0]
    begin = _FROM.search(run)
    if begin is None or not _ANY_SIGN.search(run, begin.start()):
        return run
    before, word = run[:begin.start()], run[begin.start():]
    tail = len(word.rstrip("!|+@$€"))  # signs at the end are punctuation
    return before + (word[:tail].translate(_SIGN) + " " if tail < len(word) else word.translate(_SIGN))


def fold(text: str) -> str:
    """Words of the folded text, one space before, between and after."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
    text = text.lower()
    if not text.isascii() and _HAS_LOOK.search(text):
        text = text.translate(_LOOK)
    return " " + " ".join(_WORD.findall(_SIGNED.sub(_letters, text))) + " "


@dataclass
class Lexicon:
    """Weights of exact words (``word``) and word beginnings (``word*``), and the logistic curve."""

    weights: dict[str, float]
    curve: tuple[float, float, float] = (-2.0, 1.0, 0.5)
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick
            patterns: dict[str, float | None] = {}
            for term, weight in self.weights.items():
                stem = term.endswith("*")
                spelled = fold(term.rstrip("*"))
                spelled = spelled[:-1] if stem else spelled
                for form in {spelled, spelled.replace("l", "i")}:  # the digit 1 stands for both letters
                    patterns[form] = max(weight, patterns.get(form) or 0.0)
            for phrase in self.exceptions:
                patterns[fold(phrase)] = None
            built = ahocorasick.Automaton()
            for form, weight in patterns.items():
                built.add_word(form, (len(form), weight))
            if patterns:
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def weigh(self, folded: str) -> float:
        """Weight of the matches. A word counts once, by its heaviest term; inside an exception phrase not at all."""
        automaton = self.automaton()
        if not len(automaton):
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        spared.sort()
        reach = list(accumulate((b for _, b in spared), max))

        def free(s: int) -> bool:
            at = bisect_right(spared, (s, len(folded))) - 1
            return at < 0 or reach[at] <= s
        return sum(w for s, w in best.items() if free(s))

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        weight = self.weigh(folded)
        return np.log1p(weight), np.log1p(100 * weight / max(1, folded.count(" ") - 1))

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * features[:, 0] + c * features[:, 1], -30, 30)))


def terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _ratio(a, b, toxic, clean):
    """Log-likelihood ratio of a term that is in a of the toxic and b of the clean documents."""
    share = toxic / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log(a / ((a + b) * share)), 0.0)
        right = np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0.0)
    return np.where(a / max(toxic, 1) > b / max(clean, 1), 2 * (left + right), 0.0)


def _evidence(toxic: float, clean: float) -> Column:
    """``_ratio`` of the columns a (over 0) and b."""
    a, b, share = F.col("a"), F.col("b"), toxic / (toxic + clean)
    left = a * F.log(a / ((a + b) * share))
    right = F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    return F.when(a / toxic > b / clean, 2 * (left + right)).otherwise(0.0)


def _odds(a, b, toxic, clean):
    return np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id",
        toxic: str = "toxic") -> Lexicon:
    """Learn from the documents that have a label (0 or 1; others are skipped).

    Term counts are Spark aggregates over a bounded sample; the driver sees at most ``CANDIDATES``
    terms and where they occur in the sample's toxic documents. Without both labels only the public
    list is used, on a fixed curve.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(toxic).cast("int").alias("_y")).filter("_y IN (0, 1)").groupBy("_k").agg(
        F.max("_y").alias("_y"))
    chosen = sampled(docs.select(key).join(known, F.col(key) == F.col("_k"), "left_semi"), rows, key).distinct()
    chosen = chosen.join(known, F.col(key) == F.col("_k")).select("_k", "_y")
    data = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(
        F.broadcast(chosen), F.col(key) == F.col("_k")).select(F.col("_k"), F.col("_y"), "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {0: Counter(), 1: Counter()}

        def emit():
            for y, tally in tallies.items():
                if tally:
                    yield pa.record_batch({"term": list(tally), "y": [y] * len(tally), "n": list(tally.values())})
                    tally.clear()

        for batch, texts in text_batches(batches):
            for y, t in zip(batch.column("_y").to_pylist(), texts):
                tallies[y].update(terms_of(t))
            if sum(map(len, tallies.values())) > 400_000:
                yield from emit()
        yield from emit()

    weights = {w: SEED_WEIGHT for w in INSULTS}
    whole = {r["_y"]: float(r["n"]) for r in data.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = whole.get(1, 0.0), whole.get(0, 0.0)
    if not n_toxic or not n_clean:
        return Lexicon(weights)
    counted = data.mapInArrow(count, "term string, y long, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    strong = counted.filter(F.col("a") >= SUPPORT).withColumn("evidence", _evidence(n_toxic, n_clean)).filter(F.col("evidence") >= EVIDENCE)
    found = strong.orderBy(F.desc("evidence"), F.desc("a"), "term").limit(CANDIDATES).toPandas()
    number = {t: i for i, t in enumerate(found.term)}

    def occur(batches):
        for batch, texts in text_batches(batches):
            keep = [(k, [number[t] for t in terms_of(text) if t in number]) for k, text in
                    zip(range(len(texts)), texts)]
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in keep], pa.list_(pa.int32()))], names=["terms"])

    holds = [r["terms"] for r in data.filter("_y = 1").mapInArrow(occur, "terms array<int>").collect()] if number else []
    grid = np.zeros((len(holds), len(found)), dtype=bool)
    for i, terms in enumerate(holds):
        grid[i, terms] = True
    left, b = np.ones(len(holds), dtype=bool), found.b.to_numpy(float)
    stems = np.array([t.endswith("*") for t in found.term], dtype=bool)
    for _ in range(TERMS):
        if not len(found):
            break
        a = grid[left].sum(axis=0).astype(float)
        gain = np.where(a >= SUPPORT, _ratio(a, b, n_toxic, n_clean), 0.0) - stems * 1e-6
        k = int(gain.argmax())
        if gain[k] < EVIDENCE:
            break
        weights[found.term[k]] = float(_odds(found.a[k], found.b[k], n_toxic, n_clean))
        left &= ~grid[:, k]
    lexicon = Lexicon(weights)

    def measure(batches):
        for batch, texts in text_batches(batches):
            f = np.array([lexicon.features(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["y", "f", "g"])

    seen = data.mapInArrow(measure, "y int, f double, g double").groupBy(
        "y", F.round("f", 2).alias("f"), F.round("g", 2).alias("g")).agg(F.count("*").alias("n")).toPandas()
    lexicon.curve = _logistic(seen[["f", "g"]].to_numpy(), seen.y.to_numpy(float), seen.n.to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps, with a small penalty; slopes are not negative."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``score`` and ``predicted`` (1 from the threshold on). A null text is an
    empty one and gets the score of a text without a match, the lowest there is."""
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch, texts in text_batches(batches):
            p = lexicon.probabilities(np.array([lexicon.features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
