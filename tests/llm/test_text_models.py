"""Language identification, piece encoding, toxicity and quality against brute force and held-out rows."""

import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from marginalia.llm import encoding, language, pieces, quality, toxicity
from marginalia.llm.common import held_out, table
from marginalia.llm.queries import QUERIES
from marginalia.llm.words import ListCache

ODD = [(1, None), (2, ""), (3, "   "), (4, "Hello  wörld\n你好 ▁x\t!"), (4, "Hello  wörld\n你好 ▁x\t!"), (5, "a" * 5000),
       (6, "x " * 3000), (7, "\u0000\U0001F600é"), (None, "some text"), (8, "123 456")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", F.lit("x").alias("score"), F.lit(1).alias("ids"), F.lit("en").alias("lang"))


def best_path(text, model):
    """Plain dynamic program over one word list of a text."""
    normal, byte_ids, _ = pieces.load_model(model)
    table_ = {p: (s, i) for p, s, i in normal}
    unknown = min(s for _, s, _ in normal) - encoding.UNKNOWN_PENALTY
    t = (" " + text).replace("▁", "\U0010FFFE").replace(" ", "▁")
    best = [(0.0, 0, [])] + [None] * len(t)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - 16), end):
            part = t[start:end]
            found = table_.get(part)
            if found is None and end - start > 1:
                continue
            raw = ("▁" if part == "\U0010FFFE" else part).encode()
            score, ids = (found[0], [found[1]]) if found else (unknown, [byte_ids[b] for b in raw])
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, start, ids)
    out, at = [], len(t)
    while at:
        out[:0] = best[at][2]
        at = best[at][1]
    return out if text else []


def test_encoding_is_the_best_path():
    model = pieces.default_model()
    texts = ["", "the theat lying", "Hello  wörld\n你好 ▁x\t!", "aaaaaaaaaaaaaaaaaaaaaaaa bb", "don't  stop—now", "été là-bas, ñandú"]
    ids, counts = encoding.encode_texts(texts, model, ListCache())
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == best_path(t, model)
    assert encoding.decode_ids(ids, counts, model) == texts


def test_encoding_of_odd_rows(spark, odd):
    coded = encoding.encode(odd, keep=("doc_id", "text"))
    back = encoding.decode(coded, out="again", keep=("doc_id", "text", "ids")).collect()
    assert len(back) == len(ODD) and all(r.again == r.text for r in back)
    assert [r.ids for r in back if r.text is None] == [None] and [r.ids for r in back if r.text == ""] == [[]]
    assert encoding.encode(odd.limit(0)).count() == 0


def test_encoding_query(spark):
    rows = QUERIES["op6_sentencepiece"](spark, DATA).collect()
    assert len(rows) == table(spark, DATA, "documents").count() and all(r.round_trip for r in rows)
    text = {r.doc_id: r.text for r in table(spark, DATA, "documents").limit(3).collect()}
    for r in rows:
        if r.doc_id in text:
            ids = best_path(text[r.doc_id], pieces.default_model())
            assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(" ".join(map(str, ids)).encode()))


def test_forward_sums_all_segmentations():
    model = pieces.default_model()
    found = pieces.piece_table(model)
    rng = np.random.default_rng(3)
    prob = rng.random((pieces.load_model(model)[2], 2)) * 1e-3
    seg = language._letter_runs(["lying thé"])
    got = language.word_scores(seg, np.arange(len(seg.start)), found, prob)
    normal = {p: i for p, _, i in pieces.load_model(model)[0]}
    for k in range(len(seg.start)):
        word = pieces.MARK + seg.string(k)
        total = [np.ones(2)] + [np.zeros(2) for _ in word]
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in normal:
                    total[end] = total[end] + total[start] * prob[normal[word[start:end]]]
                elif end == start + 1:
                    total[end] = total[end] + total[start] * language.FLOOR
        np.testing.assert_allclose(got[k], np.log(total[-1]))


@pytest.mark.parametrize("word", ["㐀㐁x", "㐀㐁㐂the", "a㐀㐁㐂", "㐀㐁"])
def test_forward_over_neighbouring_unknown_letters(word):
    found = pieces.piece_table(pieces.default_model())
    assert not {"㐀", "㐁", "㐂"} & {p for p, _, _ in pieces.load_model(pieces.default_model())[0]}
    prob = np.random.default_rng(4).random((pieces.load_model(pieces.default_model())[2], 2)) * 1e-3
    scores, counts = [], []
    for mates in ("", " " + "e" * len(word)):  # alone in its group of equally long words, and beside a known word
        seg = language._letter_runs([word + mates])
        scores.append(language.word_scores(seg, np.array([0]), found, prob)[0])
        weight = np.zeros((len(seg.start), 2))
        weight[0] = 1.0
        counts.append(language.expected_counts(seg, np.arange(len(seg.start)), weight, found, prob))
    normal = {p: i for p, _, i in pieces.load_model(pieces.default_model())[0]}
    marked, total = pieces.MARK + word, [np.ones(2)]
    for end in range(1, len(marked) + 1):
        total.append(sum((total[a] * (prob[normal[marked[a:end]]] if marked[a:end] in normal else language.FLOOR * (end == a + 1))
                          for a in range(end)), np.zeros(2)))
    for got in scores:
        np.testing.assert_allclose(got, np.log(total[-1]))
    np.testing.assert_allclose(counts[0], counts[1])
    assert counts[0].sum(axis=0).max() <= len(marked)


def test_language_on_held_out_rows_and_odd_rows(spark, odd):
    rows = QUERIES["op1_language_id"](spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in apart) >= 0.9 * len(apart) and all(0 <= r.score <= 1 for r in rows)
    langs, prob = language.fit(odd.filter("doc_id IS NOT NULL"))
    got = language.identify(odd, langs, prob).collect()
    assert len(got) == len(ODD) and [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)] == ["und"] * 4
    assert language.fit(odd.limit(0))[0] == []
    assert {r.lang_pred for r in language.identify(odd, [], np.zeros((1, 0))).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    words = {"en": "the house and the garden with this water", "fi": "talossa yöllä järvellä kuitenkin syksyllä"}
    docs = spark.createDataFrame([(i, f"{words['fi' if i in (7, 305) else 'en']} {i}", "fi" if i in (7, 305) else "en")
                                  for i in range(400)], "doc_id long, text string, lang string")
    langs, prob = language.fit(docs, rows=20)
    assert langs == ["en", "fi"]
    assert {(r.doc_id in (7, 305), r.lang_pred) for r in language.identify(docs, langs, prob).collect()} == {(True, "fi"), (False, "en")}
    sizes = {r[0]: r[1] for r in language._sampled(docs, {"en": 398, "fi": 2}, 20, 50, "lang", "doc_id").groupBy("lang").count().collect()}
    assert sizes["fi"] == 2 and 25 <= sizes["en"] <= 75


def test_toxicity_folds_and_spares():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "loser": 3.0, "trash": 3.0, "lowei*": 2.0})
    weigh = lambda t: lexicon.weigh(toxicity.fold(t))
    for disguised in ("IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "i​diot", "l0ser", "1oser", "lo$er"):
        assert weigh(f"you {disguised}, go") == 3.0, disguised
    assert weigh("idiotic losers") == 0 and weigh("loweischaft") == 2.0 and weigh("flowei") == 0
    assert weigh("a trash can and trash") == 3.0 and weigh("at 108.51.216.133") == 0 and weigh("") == 0


def test_toxicity_on_held_out_and_odd_rows(spark, odd):
    rows = QUERIES["op5_toxicity"](spark, DATA).collect()
    assert len(rows) == table(spark, DATA, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    assert sum(r.predicted for r in rows if truth.get(r.doc_id) == 0) <= 1
    alone = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(odd, alone).collect()
    assert len(got) == len(ODD) and {r.predicted for r in got} == {0}
    assert toxicity.score(odd.limit(0), alone).count() == 0


def test_toxic_terms_are_learned(spark):
    docs = [(i, f"word{i % 7} other{i % 5} plain text " + ("grumbelig fool" if i % 4 == 0 else "good one")) for i in range(200)]
    lexicon = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    learned = set(lexicon.weights) - set(toxicity.INSULTS)
    assert len(learned) == 1 and next(iter(learned)).rstrip("*") in ("fool", "grumbelig"[:len(next(iter(learned)).rstrip("*"))])
    p = lexicon.probabilities(np.array([lexicon.features("word1 grumbelig fool"), lexicon.features("word1 plain")]))
    assert p[0] > 0.7 > 0.3 > p[1]


def test_toxic_terms_are_not_crowded_out_by_copies(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CANDIDATES", 40)
    copied = " ".join(a + b + "xyzw" for a in "bcdfghkl" for b in "mnpqrstv")
    texts = [(copied, 1)] * 40 + [(f"plain {'abcdefgh'[i % 8]} grumbelig", 1) for i in range(100)]
    texts += [("plain text" + (" grumbelig" if i < 5 else ""), 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert any("grumbelig".startswith(w.rstrip("*")) for w in set(lexicon.weights) - set(toxicity.INSULTS))
    rows = [(100, 5), (40, 0), (4, 399), (1, 1)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", toxicity._evidence(140.0, 400.0).alias("e")).collect()
    for r in got:
        np.testing.assert_allclose(r.e, toxicity._ratio(np.array(float(r.a)), np.array(float(r.b)), 140.0, 400.0))


def test_quality_gradient_and_grades(spark, odd):
    rng = np.random.default_rng(5)
    x = np.zeros(quality.SIZE + 2)
    x[:50], x[-2:] = rng.normal(size=50), (-0.3, 0.2)
    rows = [(rng.integers(0, 50, 8), rng.random(8)) for _ in range(12)]
    y = rng.integers(0, 3, 12)
    _, grad = quality._loss(x, rows, y, 3)
    for k in (*range(5), quality.SIZE, quality.SIZE + 1):
        step = np.zeros_like(x)
        step[k] = 1e-6
        slope = (quality._loss(x + step, rows, y, 3)[0] - quality._loss(x - step, rows, y, 3)[0]) / 2e-6
        assert abs(slope - grad[k]) < 1e-4
    rated = spark.createDataFrame([(i, "fine words here now" if i % 3 else "|| ## ||", min(i % 3, 2)) for i in range(60)],
                                  "doc_id long, text string, grade int")
    grader = quality.fit(rated)
    assert grader.grades == (0, 1, 2) and (np.diff(grader.thresholds) > 0).all()
    got = quality.grade(odd, grader).collect()
    assert len(got) == len(ODD) and all(1 >= r.tails[0] >= r.tails[1] >= 0 and abs(r.expected_grade - sum(r.tails)) < 1e-9 for r in got)
    assert quality.fit(rated.filter("grade = 1")) is None and quality.fit(rated.limit(0)) is None
    assert quality.grade(odd.limit(0), grader).count() == 0


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op9_quality_classifier"](spark, DATA).collect()
    truth = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    apart = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == table(spark, DATA, "documents").count()
    assert sum(r.kept == bool(truth[r.doc_id]) for r in apart) >= 0.9 * len(apart)
    assert spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first().h
