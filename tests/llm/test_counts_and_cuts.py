"""Infill rotations, source divergence and token counts against plain Python and the library."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import divergence, infill, token_counts
from marginalia.llm.common import table
from marginalia.llm.queries import QUERIES
from marginalia.llm.words import ListCache

WORDS = "".join(random.Random(7).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10**6))
SPACED = " ".join(WORDS[i:i + 6] for i in range(0, 10**6, 6))
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, "Hello  wörld\n你好 x", "en", None), (4, "Hello  wörld\n你好 x", "en", None),
       (5, WORDS, "en", "b"), (6, SPACED, "de", "b"), (7, "你好世界" * 250_000, "zh", "c"), (8, " " * 200_000, "", ""),
       (None, "one two", "en", "a"), (9, "a<P>b <M>", "en", "a"), (10, "\u0000 \u0001x\U0001F600", "en", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit(1).alias(c) for c in ("n", "form", "output", "_text", "_k0", "_h0", "n_tokens", "term", "docs", "value", "rank")])


def documents(spark):
    return table(spark, DATA, "documents").collect()


# ---- infill -------------------------------------------------------------------------------------

def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_query(spark):
    want = {r.doc_id: (*plain_infill(r.doc_id, r.text), r.text or "") for r in documents(spark)}
    got = QUERIES["op11_fill_in_middle"](spark, DATA).collect()
    assert len(got) == len(want) and {"plain", "spm", "psm"} == {r.form for r in got}
    for r in got:
        *head, output, text = want[r.doc_id]
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "你", " ", "\n", "<", ">", "P", "P>", "<S", "M", "\x00"]), max_size=30), st.data())
def test_infill_rotations_are_undone(parts, data):
    text = "".join(parts)
    if any(x in text for x in ("<P>", "<S>", "<M>")):
        return
    i, j = sorted((data.draw(st.integers(0, len(text))), data.draw(st.integers(0, len(text)))))
    p, m, s = text[:i], text[i:j], text[j:]
    for form, output in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}"), ("plain", text)):
        made = infill.transform(text.encode(), len(p.encode()), len((p + m).encode()), form)
        assert made == output.encode() and infill.invert(made, form) == text.encode()


def test_infill_of_odd_rows(spark, odd):
    cut = infill.fill_in_middle(odd, keep=("doc_id", "_k0"), share=100)
    rows = cut.collect()
    assert len(rows) == len(ODD)
    texts = {k: t or "" for k, t, _, _ in ODD}
    for r in rows:
        assert r.n == plain_infill(r.doc_id, texts[r.doc_id])[0] and (r.form == "plain") == (r.doc_id in (1, 2, 9))
        assert infill.invert(r.output.encode(), r.form).decode() == texts[r.doc_id]
    back = infill.restore(cut, out="text", keep=("doc_id",)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((k or 0, t or "") for k, t, _, _ in ODD)
    assert infill.fill_in_middle(odd.limit(0)).count() == 0
    gone = infill.restore(spark.createDataFrame([(1, None, "psm")], "doc_id long, output string, form string")).collect()
    assert gone[0].text is None


# ---- divergence ---------------------------------------------------------------------------------

def plain_audit(rows, least, top=50):
    """(lang, source, part, item): (value, rank) by counting, over all terms of every pair."""
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    n, df = Counter(), Counter()
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        n.update((lang, source, t) for t in found)
        df.update((lang, t) for t in set(found))
    out = {}
    for lang in {r[1] for r in rows}:
        kept = [t for (a, t), c in df.items() if a == lang and c >= least]
        sources = {r[2] for r in rows if r[1] == lang}

        def share(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        own = {s: [n[lang, s, t] for t in kept] for s in sources}
        p = {s: [share(c, sum(own[s])) for c in own[s]] for s in sources}
        whole = [sum(own[s][i] for s in sources) for i in range(len(kept))]
        q = [share(c, sum(whole)) for c in whole]
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources - {s})
            terms = sorted((b - a, t.encode(), t) for a, b, c, t in zip(p[s], q, own[s], kept) if c and a > b)[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (value, _, item) in enumerate(items, 1):
                    out[lang, s, part, item] = (-value, rank)
    return out


def audited(df, **how):
    got = divergence.audit(df, **how).collect()
    out = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in got}
    assert len(out) == len(got)
    return out


def test_divergence_query(spark):
    want = plain_audit([(r.text, r.lang, r.source) for r in documents(spark)], 30)
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in QUERIES["op12_source_divergence"](spark, DATA).collect()}
    assert got == want and {k[2] for k in want} == {"pair", "term"}


@pytest.mark.parametrize("cells", [divergence.CELLS, 20])
def test_divergence_of_many_sources(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rnd = random.Random(11)
    rows = [(" ".join(rnd.choice("abcdefghijklmnop") * rnd.choice((1, 1, 2, 9, 70)) for _ in range(rnd.randint(0, 12))),
             rnd.choice(("x", "x", "y", None)), rnd.choice(["hot"] * 8 + [f"s{i}" for i in range(14)] + [None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").select("*", F.lit(1).alias("n"), F.lit("t").alias("term"))
    for least in (1, 5, 10**6):
        assert audited(df, least_docs=least) == plain_audit(rows, least)


def test_divergence_of_odd_rows(spark, odd):
    rows = [(t, a, b) for _, t, a, b in ODD]
    for least in (1, 2, 30):
        assert audited(odd, least_docs=least) == plain_audit(rows, least)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_pointer_sort_is_a_sort():
    rnd = random.Random(5)
    pool = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "x" * 64, "x" * 65, "x" * 300, "x" * 299 + "y", "é", "ééééé", "Ab"]
    for _ in range(40):
        texts = ["".join(rnd.choice(pool) + rnd.choice(" \n0_") for _ in range(rnd.randint(0, 40))) for _ in range(5)]
        raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        folded, begin, length, text = divergence.word_pointers(raw, starts)
        words = [folded[b:b + n].tobytes() for b, n in zip(begin, length)]
        order, new = divergence.pointer_sort(folded, begin, length, text % 2)
        keys = [(text[i] % 2, words[i], i) for i in order]
        assert keys == sorted(keys)
        assert new.tolist() == [i == 0 or keys[i][:2] != keys[i - 1][:2] for i in range(len(keys))]


# ---- token counts -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    processor = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def test_token_counts_query(spark, library):
    docs = documents(spark)
    want = dict(zip([r.doc_id for r in docs], library([r.text or "" for r in docs])))
    got = QUERIES["op13_token_counts"](spark, DATA).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    sizes = {r.doc_id: len((r.text or "").encode()) for r in docs}
    assert all(r.n_bytes == sizes[r.doc_id] and r.over_limit == (r.n_tokens > 4096) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aeit nghs▁<>\n", max_size=80)), min_size=1, max_size=6))
def test_token_counts_of_any_text(texts):
    import sentencepiece
    model = token_counts.default_model()
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [len(x) for x in processor.encode(texts, num_threads=1)]
    for long in (token_counts.LONG, 0):  # rounds over all runs, and the heap for every run
        assert token_counts.count_texts(texts, model, ListCache(), long).tolist() == want


def test_token_counts_of_odd_rows(spark, odd, library):
    got = token_counts.count_tokens(odd, keep=("doc_id", "_k0", "_text")).collect()
    want = library([t or "" for _, t, _, _ in ODD])
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((row[0] or 0, n) for row, n in zip(ODD, want))
    assert token_counts.count_tokens(odd.limit(0)).count() == 0
