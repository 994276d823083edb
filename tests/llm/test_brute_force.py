"""Fingerprints and the quality classifier, worked out once more over plain sets and dense rows."""

import numpy as np
import pytest
import regex
from conftest import DATA
from pyspark.sql import functions as F

from marginalia.llm import fingerprints, quality
from marginalia.llm.common import table
from marginalia.llm.queries import QUERIES


def terms_of(text):
    return list(dict.fromkeys(t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t))


def test_fingerprints_query_over_plain_sets(spark):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, DATA, "documents").collect())
    edited = [t[:len(t) - len(t) // 2] + docs[(i + 1) % len(docs)][1][:len(t) // 2] for i, (_, t) in enumerate(docs)]
    count = {}
    for _, t in docs:
        for w in terms_of(t):
            count[w] = count.get(w, 0) + 1
    n = len(docs)
    kept = {w for w, c in count.items() if c >= max(2.0, fingerprints.LEAST_SHARE * n)}
    band = {w for w in kept if count[w] <= fingerprints.MOST_SHARE * n}
    got_band, got_above = fingerprints.bands(table(spark, DATA, "documents"))
    assert set(got_band) == band and set(got_above) == kept - band

    words = sorted({w for t in [*(t for _, t in docs), *edited] for w in terms_of(t)})
    seeds = len(fingerprints.FAMILIES)
    hashes = spark.createDataFrame([(w,) for w in words], "t string").selectExpr("t", *[f"xxhash64(t, {g}) AS h{g}" for g in range(seeds + 1)])
    h = {r.t: [r[f"h{g}"] for g in range(seeds + 1)] for r in hashes.collect()}

    def subsets(text):
        own = terms_of(text)
        inside = [w for w in own if w in band]
        out = sorted((w in kept, h[w][seeds], w) for w in own if w not in band)
        extra = min(fingerprints.EXTRA, max(sum(not above for above, _, _ in out), fingerprints.EXTRA - len(inside)))
        chosen = [*inside, *[w for _, _, w in out[:extra]]]
        return [frozenset(w for w in chosen if ((h[w][g] % 2**64) >> 7 * j) & 1023 < share)
                for g, (share, times) in enumerate(fingerprints.FAMILIES) for j in range(times)]

    def alike(a, b):
        known = [x == y for x, y in zip(a, b) if x or y]
        return sum(known) / len(known) if known else 1.0

    sets, changed = [subsets(t) for _, t in docs], [subsets(t) for t in edited]
    rows = {r.doc_id: r for r in QUERIES["op2_document_fingerprints"](spark, DATA).collect()}
    family = [g for g, (_, times) in enumerate(fingerprints.FAMILIES) for _ in range(times)]  # a family hashes in its own way
    name_of, set_of = {}, {}
    for i, (k, _) in enumerate(docs):
        r = rows[k]
        assert r.near_edited == pytest.approx(alike(sets[i], changed[i])) and r.near_next == pytest.approx(alike(sets[i], sets[(i + 1) % n]))
        for shown, own in ((r.fingerprint, sets[i]), (r.edited_fingerprint, changed[i])):
            for at, kept_terms in enumerate(own):
                name = shown[8 * at:8 * at + 8]
                assert (name == "-" * 8) == (not kept_terms)
                own_name, own_set = (family[at], name), (family[at], kept_terms)
                assert name_of.setdefault(own_set, own_name) == own_name and set_of.setdefault(own_name, own_set) == own_set


def dense(texts):
    """A row of feature values per text, counted one by one; columns are the features that occur."""
    rows = []
    for t in texts:
        own = {}
        _, feature, value = quality.feature_stream([t])
        for f, v in zip(feature.tolist(), value.tolist()):
            own[f] = own.get(f, 0.0) + v
        rows.append(own)
    names = sorted({f for r in rows for f in r})
    return np.array([[r.get(f, 0.0) for f in names] for r in rows]), names


def grade_probabilities(x, w, cuts):
    tail = 1 / (1 + np.exp(-(x @ w[:, None] - cuts[None, :])))
    edges = np.column_stack([np.ones(len(x)), tail, np.zeros(len(x))])
    return edges[:, :-1] - edges[:, 1:]


def fitted_by_newton(x, y, levels, penalty):
    """The same model on dense rows: damped Newton steps with numerical second differences of the gradient."""
    def unpack(p):
        return p[:x.shape[1]], p[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(p[x.shape[1] + 1:]))])

    def loss(p):
        w, cuts = unpack(p)
        return -np.log(grade_probabilities(x, w, cuts)[np.arange(len(y)), y]).mean() + penalty / 2 * (w @ w)

    def slope(p, step=1e-6):
        return np.array([(loss(p + step * e) - loss(p - step * e)) / (2 * step) for e in np.eye(len(p))])

    p = np.concatenate([np.zeros(x.shape[1]), [-0.5], np.zeros(levels - 2)])
    for _ in range(60):
        g = slope(p)
        if np.abs(g).max() < 1e-7:
            break
        curve = np.array([(slope(p + 1e-4 * e) - g) / 1e-4 for e in np.eye(len(p))])
        move = np.linalg.solve((curve + curve.T) / 2 + 1e-6 * np.eye(len(p)), g)
        size = 1.0
        while loss(p - size * move) > loss(p) and size > 1e-4:
            size /= 2
        p = p - size * move
    return unpack(p)


def test_quality_fit_is_that_of_dense_rows(spark):
    rng = np.random.default_rng(12)
    words = [["aa", "ab"], ["aa", "ba"], ["ba", "bb"]]
    rows = [(i, " ".join(rng.choice(words[i % 3] if rng.random() < 0.8 else ["aa", "ab", "ba", "bb"], 6)), i % 3) for i in range(45)]
    rows += [(100, rows[0][1], 1), (101, rows[0][1], 2)]  # ties: one text with several grades
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade long")
    grader = quality.fit(frame, steps=400, penalty=0.02)
    texts = [t for _, t, _ in rows]
    x, names = dense(texts)
    # The columns that matter, by an exact change of basis: rows span few dimensions.
    u, s, _ = np.linalg.svd(x * 30.0, full_matrices=False)
    reduced = (u * s)[:, s > 1e-9 * s[0]]
    w, cuts = fitted_by_newton(reduced, np.array([g for _, _, g in rows]), 3, 0.02)
    want = grade_probabilities(reduced, w, cuts)
    tails = grader.tails(texts)
    assert np.abs(tails[:, 0] - (1 - want[:, 0])).max() < 0.02 and np.abs(tails[:, 1] - want[:, 2]).max() < 0.02
    line = x @ grader.weights[names]
    plain = 1 / (1 + np.exp(-(line[:, None] - grader.thresholds[None, :])))
    assert np.allclose(tails, plain)
    graded = {r.doc_id: (r.expected_grade, tuple(r.tails)) for r in quality.grade(frame.select("doc_id", "text", F.lit(1).alias("score")), grader).collect()}
    assert graded[0] == graded[100] == graded[101]
    assert all(np.allclose(graded[k][1], plain[i]) and np.isclose(graded[k][0], plain[i].sum()) for i, (k, _, _) in enumerate(rows))
