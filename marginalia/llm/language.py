"""Language identification by unigram piece models whose segmentations are summed out.

A language is a distribution over the pieces of a fixed public vocabulary. The likelihood of a word
is the sum over all of its segmentations (forward algorithm); it is fitted by expectation
maximisation over the same lattice. Words are scored once per class of equal words, for all
languages and for all words of one length together.

Words are maximal runs of letters of the lower-cased text; runs over ``BLOCK`` letters (scripts
without spaces) are cut into blocks of that length. Nothing of a text is left out but non-letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .common import text_batches
from .words import ListCache, Segments, char_table, codepoints

BLOCK = 24
FIT_ROWS = 12_000  # documents the piece probabilities are fitted on (about), dealt by the languages' shares
LANG_ROWS = 1_000  # documents of every language in the fit at least (about), or all that it has
ROUNDS = 2
FLOOR = 1e-7  # probability of a letter that no piece holds


def _letter_runs(texts: list[str]) -> Segments:
    cp, starts = codepoints([t.lower() for t in texts])
    letter = char_table("isalpha")[cp]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    text_first = starts[:-1][starts[:-1] < len(cp)]
    begins[text_first] = True
    ends_run = ~letter
    ends_run[1:] &= letter[:-1]
    begins |= ends_run  # the gaps between words are segments too, dropped below
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, len(cp)))
    long = np.flatnonzero(length > BLOCK)
    for i in long:
        begins[at[i]:at[i] + length[i]:BLOCK] = True
    return Segments(cp, starts, begins, keep=lambda start: letter[start])


def _marked(seg: Segments, rows: np.ndarray, length: int) -> np.ndarray:
    """The words with the mark of a word's start before them."""
    out = np.empty((len(rows), length + 1), dtype=np.uint32)
    out[:, 0] = ord(P.MARK)
    out[:, 1:] = seg.matrix(rows, length)
    return out


def _forward(table: P.PieceTable, words: np.ndarray, prob: np.ndarray):
    """(alpha, spans): alpha[j] sums the segmentations of the first j columns, per word and language."""
    n, length = words.shape
    alpha = [np.ones((n, prob.shape[1]))] + [np.zeros((n, prob.shape[1])) for _ in range(length)]
    spans = []
    known = np.zeros((n, length + 1), dtype=bool)
    done = 0
    for start, end, rows, ids in table.matches(words):
        while done < end - 1:  # columns where no piece ends are closed too, each before a later one reads it
            done += 1
            _unknown(alpha, known, done)
        alpha[end][rows] += alpha[start][rows] * prob[ids]
        if end == start + 1:
            known[rows, end] = True
        spans.append((start, end, rows, ids))
    while done < length:
        done += 1
        _unknown(alpha, known, done)
    return alpha, spans, known


def _unknown(alpha: list, known: np.ndarray, end: int) -> None:
    """A letter that is no piece of its own passes with a small probability (once per column)."""
    rows = np.flatnonzero(~known[:, end])
    if len(rows):
        alpha[end][rows] += alpha[end - 1][rows] * FLOOR
        known[rows, end] = True


def _by_length(seg: Segments, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = seg.length[rows]
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, rows[at]


def word_scores(seg: Segments, rows: np.ndarray, table: P.PieceTable, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of the segments under every language."""
    out = np.empty((len(rows), prob.shape[1]))
    for length, at, own in _by_length(seg, rows):
        alpha, _, _ = _forward(table, _marked(seg, own, length), prob)
        out[at] = np.log(np.maximum(alpha[-1], 1e-300))
    return out


def expected_counts(seg: Segments, rows: np.ndarray, weight: np.ndarray, table: P.PieceTable,
                    prob: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the weighted words (weight: a column per language), by the
    forward and backward sums over all segmentations."""
    out = np.zeros_like(prob)
    for length, at, own in _by_length(seg, rows):
        alpha, spans, _ = _forward(table, _marked(seg, own, length), prob)
        single = np.zeros((len(own), length + 2), dtype=bool)
        for start, end, r, _ in spans:
            if end == start + 1:
                single[r, end] = True
        beta = [np.zeros_like(alpha[0]) for _ in range(length + 1)] + [np.ones_like(alpha[0])]
        scale = np.where(alpha[-1] >= 1e-300, weight[at] / np.maximum(alpha[-1], 1e-300), 0.0)  # 0: nothing to learn from
        by_end: dict[int, list] = {}
        for span in spans:
            by_end.setdefault(span[1], []).append(span)
        for end in range(length + 1, 0, -1):
            for start, _, r, ids in by_end.get(end, ()):
                use = beta[end][r] * prob[ids]
                np.add.at(out, ids, alpha[start][r] * use * scale[r])
                beta[start][r] += use
            r = np.flatnonzero(~single[:, end])
            beta[end - 1][r] += beta[end][r] * FLOOR
    return out


def _sampled(docs: DataFrame, held: dict[str, int], rows: int, lang_rows: int, lang: str, key: str) -> DataFrame:
    """About ``rows`` rows dealt by the languages' shares, and of each language about ``lang_rows`` at
    least (all if it has no more): those whose key's hash is below the language's bound. ``held``:
    rows of every language. The same rows are taken every time."""
    share = rows / max(sum(held.values()), 1)
    bounds = [x for name, n in held.items() for x in (name, int(2**30 * min(1.0, max(share, lang_rows / n))))]
    bound = F.element_at(F.create_map(*map(F.lit, bounds)), F.col(lang))
    return docs.filter(F.pmod(F.xxhash64(key), F.lit(2**30)) < bound)


def fit(docs: DataFrame, rows: int = FIT_ROWS, rounds: int = ROUNDS, model: str | None = None,
        text: str = "text", lang: str = "lang", key: str = "doc_id", lang_rows: int = LANG_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities: a row per vocabulary id, a column per language).

    The languages and their counts are taken over all rows, the probabilities over a sample that
    holds rows of each. Every round is one Spark job over the sample that sums expected piece counts;
    the driver gets a number per piece and language, however many documents there are. Rows without
    text or language are skipped; with nothing to learn from, the list of languages is empty.
    """
    model = model or P.default_model()
    size = P.load_model(model)[2]
    docs = docs.select(F.col(key), F.col(text), F.col(lang)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    held = {r[0]: r[1] for r in docs.groupBy(lang).agg(F.count("*")).collect()}
    langs = sorted(held)
    if not langs:
        return [], np.zeros((size, 0))
    sample = _sampled(docs, held, rows, lang_rows, lang, key).select(F.col(text).alias("_text"), F.col(lang).alias("lang"))
    prob = np.full((size, len(langs)), 1.0 / size)
    column = {name: k for k, name in enumerate(langs)}

    for _ in range(rounds):
        now = prob

        def count(batches):
            table, total = P.piece_table(model), np.zeros((size, len(langs)))
            for batch, texts in text_batches(batches):
                seg = _letter_runs(texts)
                if not len(seg.start):
                    continue
                own = np.array([column[x] for x in batch.column("lang").to_pylist()])[seg.text]
                codes, first = seg.classes()
                weight = np.zeros((len(first), len(langs)))
                np.add.at(weight, (codes, own), 1.0)
                total += expected_counts(seg, first, weight, table, now)
            piece, which = np.nonzero(total)
            yield pa.record_batch({"piece": piece, "which": which, "n": total[piece, which]})

        found = sample.mapInArrow(count, "piece long, which long, n double").groupBy("piece", "which").agg(
            F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(langs)), 0.02)
        counts[found.piece, found.which] += found.n
        prob = counts / counts.sum(axis=0)
    return langs, prob


def identify(docs: DataFrame, langs: list[str], prob: np.ndarray, model: str | None = None,
             text: str = "text", unknown: str = "und", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its share of the likelihood, per letter run tempered to avoid
    rounding to 1 on long texts) to the kept columns.

    A null text, a text without a letter and an empty list of languages give ``unknown`` and score 0.
    Ties go to the language that sorts first. Repeated rows are scored alike.
    """
    model = model or P.default_model()
    shared = docs.sparkSession.sparkContext.broadcast(prob)  # vocabulary x languages
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        table, p = P.piece_table(model), shared.value
        cache = ListCache()
        for batch, texts in text_batches(batches):
            pred, score = [unknown] * len(texts), np.zeros(len(texts))
            seg = _letter_runs(texts)
            if langs and len(seg.start):
                codes, first = seg.classes()

                def work(new, seg=seg, first=first):
                    values = word_scores(seg, first[new], table, p)
                    return values, np.ones(len(new), dtype=np.int64)

                at = cache.rows(seg.hash[first], work)
                scores = cache.data[at][codes]
                has = np.bincount(seg.text, minlength=len(texts))
                total = np.column_stack([np.bincount(seg.text, weights=scores[:, k], minlength=len(texts))
                                         for k in range(len(langs))])
                best = total.argmax(axis=1)
                share = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(has, 1))[:, None])
                top = 1.0 / share.sum(axis=1)
                for i in np.flatnonzero(has):
                    pred[i], score[i] = langs[best[i]], top[i]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
