"""Long texts, long paths, clashing columns, and the order of the packing curve."""

import random
import re
import time

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import encoding, graph, packing, pieces, toxicity
from marginalia.llm.common import table
from marginalia.llm.words import ListCache


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [e.ids for e in encoder.encode_batch(texts, add_special_tokens=False)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_packed_ids_are_the_library_s(spark, library):
    texts = [r.text or "" for r in table(spark, DATA, "documents").select("text").collect()]
    cache = ListCache()
    for k in range(0, len(texts), 50):
        assert split(*packing.tokenize(texts[k:k + 50], packing.default_ranks(), cache)) == library(texts[k:k + 50])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=50), st.lists(st.sampled_from(
    [" ", " ", "a", "don't", "é", "你", "\n", "\t", "\x1c", "\x85", "12", "<|endoftext|>", "!", "\U0001F600", "　"]), max_size=25).map("".join)),
    min_size=1, max_size=8))
def test_packed_ids_of_any_text(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in encoder.encode_batch(texts, add_special_tokens=False)]
    assert split(*packing.tokenize(texts, packing.default_ranks(), ListCache())) == want


def test_neighbours_on_the_curve_are_alike(spark):
    rows = packing.token_table(table(spark, DATA, "documents")).collect()
    rows = sorted(rows, key=lambda r: (r.curve, r.doc_id))
    bags = [set(np.frombuffer(bytes(r.ids), dtype="<u2").tolist()) for r in rows]

    def alike(a, b):
        return len(a & b) / max(1, len(a | b))

    order = np.random.default_rng(1).permutation(len(bags))
    near = np.mean([alike(a, b) for a, b in zip(bags, bags[1:])])
    far = np.mean([alike(bags[i], bags[j]) for i, j in zip(order, order[1:])])
    assert near > 1.3 * far


OLD_SIGNED = re.compile(r"[^\W\d_][\w@$!|€+]*[0-9@$!|€+][\w@$!|€+]*|[0-9@$!|€+]+[^\W\d_][\w@$!|€+]*")


def old_letters(match):
    word = match[0]
    tail = len(word.rstrip("!|+@$€"))
    signs = str.maketrans(toxicity.SIGNS)
    return word[:tail].translate(signs) + " " if tail < len(word) else word.translate(signs)


@settings(max_examples=1500, deadline=None)
@given(st.text("ab1@!_ é٣€ +", max_size=25))
def test_signs_in_words(text):
    assert toxicity._SIGNED.sub(toxicity._letters, text) == OLD_SIGNED.sub(old_letters, text)


@pytest.mark.parametrize("text", ["a" * 10**6, "你好" * 500_000, "1" * 10**6, "a1" * 500_000, "_1" * 500_000, "trash can idiot " * 60_000,
                                  "".join(random.Random(1).choice("abcXYZ019+/") for _ in range(10**6))])
def test_toxicity_of_a_long_text_takes_seconds(text):
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 3.0))
    start = time.perf_counter()
    lexicon.features(text)
    assert time.perf_counter() - start < 10


def test_exception_phrases_are_spared():
    lexicon = toxicity.Lexicon({"trash": 3.0, "idiot": 2.0})
    assert lexicon.weigh(toxicity.fold("trash can, the idiot, trash bin")) == 2.0
    assert lexicon.weigh(toxicity.fold("trash can trash")) == 3.0
    assert lexicon.weigh(toxicity.fold("1d1ot tr4sh")) == 5.0


def rounds_of(monkeypatch, edges):
    staged, done = graph.staged, []
    monkeypatch.setattr(graph, "staged", lambda df, name: done.append(name) or staged(df, name))
    got = {r.node: r.label for r in graph.components(edges).collect()}
    return got, len(done) - 1


def test_a_falling_path_takes_few_rounds(spark, monkeypatch):
    n = 1000
    falling = [(0, n)] + [(i, i - 1) for i in range(n, 1, -1)]  # 0 - n - (n-1) - ... - 1
    got, rounds = rounds_of(monkeypatch, spark.createDataFrame(falling, "a long, b long").coalesce(1))
    assert set(got) == set(range(n + 1)) and set(got.values()) == {0} and rounds <= 12


def test_components_of_random_graphs(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(1000, 1000), (7, 9), (9, 7)] + [(500, 501 + i) for i in range(200)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got, rounds = rounds_of(monkeypatch, spark.createDataFrame(edges, "a long, b long"))
    assert got == {x: root(x) for x in up} and rounds <= 12
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


CLASHING = ("tails", "expected_grade", "score", "predicted", "_text", "_gone", "row", "kept", "component_id", "n_shingles", "grade", "quality",
            "toxic", "held_out", "features", "with.dot", "label", "node")


def test_pipeline_stages_keep_any_columns(spark):
    import corpus_pipeline
    plain = table(spark, DATA, "documents")
    docs = plain.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHING)
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, plain, DATA).select("doc_id").collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_long_words_are_encoded_like_short_ones(monkeypatch):
    rng = random.Random(6)
    model = pieces.default_model()
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for letters in ("a", "ab", "thein ", "aeiou\u2581", "é你a\U0010FFFF") for _ in range(40)]
    ids, counts = encoding.encode_texts(texts, model, ListCache())
    for long in (0, 10**9):
        monkeypatch.setattr(encoding, "LONG", long)
        own_ids, own_counts = encoding.encode_texts(texts, model, ListCache())
        assert own_ids.tolist() == ids.tolist() and own_counts.tolist() == counts.tolist()
    assert encoding.decode_ids(ids, counts, model) == texts


@pytest.mark.parametrize("text", ["a" * 10**6, "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10**6)), "你好" * 500_000, " " * 10**6])
def test_encoding_of_a_long_text_takes_seconds(text):
    model = pieces.default_model()
    encoding.encode_texts(["warm up"], model, ListCache())
    start = time.perf_counter()
    ids, counts = encoding.encode_texts([text], model, ListCache())
    assert time.perf_counter() - start < 20 and encoding.decode_ids(ids, counts, model) == [text]
