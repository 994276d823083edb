"""Fingerprints, chat, sharding, near-duplicates, packing and vectors against plain Python."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from marginalia.llm import chat, embeddings, fingerprints, graph, near_duplicates, packing, sharding
from marginalia.llm.common import table
from marginalia.llm.queries import QUERIES
from marginalia.llm.words import ListCache

ODD = [(1, None), (2, ""), (3, "   "), (4, "Hello  wörld\n你好"), (4, "Hello  wörld\n你好"), (5, "a" * 3000),
       (6, "x y " * 2000), (7, "one two"), (8, "one two"), (9, "ONE TWO"), (None, "one two")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit(1).alias("size"), F.lit("s").alias("shard"), F.lit(0).alias("n"))


def documents(spark):
    return sorted((r.doc_id, r.text or "") for r in table(spark, DATA, "documents").select("doc_id", "text").collect())


def test_fingerprints(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_document_fingerprints"](spark, DATA).collect()}
    docs = documents(spark)
    by_text = {}
    for i, (k, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[:len(t) - half] + docs[(i + 1) % len(docs)][1][:half]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[k].n_chars == len(t)
        assert by_text.setdefault(t, rows[k].fingerprint) == rows[k].fingerprint
        assert 0 <= rows[k].near_next <= 1 and 0 <= rows[k].near_edited <= 1
    near = [(r.near_edited, r.near_next) for r in rows.values()]
    assert np.mean([a for a, _ in near]) > 3 * np.mean([b for _, b in near])


def test_lexicon_and_odd_rows(spark, odd):
    docs = spark.createDataFrame([(i, "the " + ("mid " if i % 5 == 0 else "") + f"only{i}") for i in range(50)], "doc_id long, text string")
    assert fingerprints.lexicon(docs, least=0.1, most=0.5) == ["mid"]
    got = fingerprints.fingerprints(odd, fingerprints.lexicon(odd)).collect()
    assert len(got) == len(ODD) and all(set(r.fingerprint) == {None} for r in got if r.doc_id in (1, 2, 3))
    same = {tuple(r.fingerprint) for r in got if r.text == "one two"}
    assert len(same) == 1
    pairs = fingerprints.with_next(odd.select("doc_id", "text"), "doc_id", ["text"]).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted((str(a[0]), str(a[1]), str(b[1])) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str(r.doc_id), str(r.text), str(r.next_text)) for r in pairs) == want
    assert fingerprints.with_next(odd.limit(0).select("doc_id", "text"), "doc_id", ["text"]).count() == 0


def test_fingerprints_of_a_small_language(spark):
    own = [f"pien{i}" for i in range(300)]
    main = [f"main{i}" for i in range(80)]
    docs = [(i, " ".join(main[(i * 7 + k) % 80] for k in range(12)) + f" the year2020 only{i}") for i in range(400)]
    docs += [(1000, " ".join(own)), (1001, " ".join(f"muu{i}" for i in range(300)))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    terms, above = fingerprints.bands(docs, least=0.01)
    assert set(main) <= set(terms) and {"the", "year2020"} <= set(above) and not set(own) & {*terms, *above}
    cases = {"half": (own, own[:150] + main[:12]),  # the other half from a text of the main language
             "one more": (own, own + main[:1]),
             "unrelated": (own + main[:1], [f"muu{i}" for i in range(300)] + main[:1]),
             "short": (["the", "year2020"], ["the", "year2020"]),
             "none": ([], [])}
    rows = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in cases.items()], "k string, a string, b string")
    for c in "ab":
        rows = fingerprints.with_fingerprint(rows, c, f"{c}_fp", terms, above)
    got = {r.k: r for r in rows.select("k", "a_fp", fingerprints.likeness(F.col("a_fp"), F.col("b_fp")).alias("x")).collect()}
    assert got["half"].x > 0.1 and got["one more"].x > 0.5 and got["unrelated"].x < 0.3
    assert got["short"].x == 1 and set(got["short"].a_fp) != {None} and set(got["none"].a_fp) == {None}


def test_chat_read_back(spark):
    rows = {r.conv_id: r for r in QUERIES["op3_chat_formatting"](spark, DATA).collect()}
    turns = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in table(spark, DATA, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(rows) == set(turns)
    for k, own in turns.items():
        own.sort()
        learned = "".join(t for _, role, t in own if role == "assistant")
        got = rows[k]
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got.n_turns, got.loss_chars, got.loss_sha256) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image:0|> \\ <|end|>\n"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15},
             {"type": "audio", "ref": "b.wav", "seconds": 1.5}, None, {"type": "document", "pages": 2}, {"type": "odd", "text": "end"}]
    segment, a, b, files = chat.format_message("assistant", parts)
    role, text, holders = chat.read_segment(segment)
    assert (role, text) == ("assistant", "see <|image:0|> \\ <|end|>\nend")
    assert holders == [("image", 0), ("audio", 1), ("document", 2)]
    assert [(f["kind"], f["ref"], f["tokens"]) for f in files] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", None, 1200)]
    assert segment[a:b].startswith("see ") and segment[b:] == chat.END
    assert chat.read_segment(chat.format_message(None, None)[0]) == ("", "", [])
    messages = spark.createDataFrame([(1, 0, None, None), (None, 0, "user", "hi"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    done = chat.digests(chat.format_turns(messages.select("*", chat.text_parts().alias("content"))))
    assert {(r.conv_id, r.n_turns) for r in done.collect()} == {(1, 2), (None, 1)}
    assert chat.format_turns(messages.limit(0).select("*", chat.text_parts().alias("content"))).count() == 0


def test_chat_parts_split_inside_a_control_string():
    text = lambda *parts: [{"type": "text", "text": t} for t in parts]
    image = {"type": "image", "ref": "a.png"}
    cases = [(text("<", "|image:0|>"), "<|image:0|>", 0), (text("a<", "", "|end|>\n"), "a<|end|>\n", 0), (text("\\", "<", "|x"), "\\<|x", 0),
             ([*text("<"), None, {"type": "odd", "text": "|image:0|>"}], "<|image:0|>", 0),
             ([*text("<"), image, *text("|image:0|>")], "<|image:0|>", 1)]
    for parts, whole, n in cases:
        segment, a, b, _ = chat.format_message("assistant", parts)
        assert chat.read_segment(segment) == ("assistant", whole, [("image", k) for k in range(n)])
        assert segment[b:] == chat.END


def test_sharding(spark, odd):
    rows = QUERIES["op4_sharding"](spark, DATA).collect()
    docs = dict(documents(spark))
    shards, load, of_text = {}, [0] * 40, {}
    for r in rows:
        text = docs[r.doc_id]
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
        assert of_text.setdefault(text, r.shard) == r.shard
        shards.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(load) - min(load) <= max(len(t.encode()) + 16 for t in docs.values())
    placed = sharding.shard_documents(odd, 3).collect()
    assert len(placed) == len(ODD) and len({r.shard for r in placed if r.doc_id in (1, 2)}) == 1
    assert sharding.shard_documents(odd.limit(0), 3).count() == 0
    assert list(sharding.schedule(iter([(5, 1), (4, 1), (3, 2)]), 2)) == [(5, 0, [0]), (4, 0, [1]), (3, 0, [1, 0])]


def heap_loads(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_schedule_is_the_heap_s():
    rng = np.random.default_rng(8)
    for _ in range(200):
        shards = int(rng.integers(1, 12))
        sizes = {int(s): int(n) for s, n in zip(rng.integers(0, 10**rng.integers(1, 6), 8), rng.integers(1, 10**rng.integers(1, 5), 8))}
        got = [0] * shards
        by_size = {}
        for size, rank, turns in sharding.schedule(iter(sorted(sizes.items(), reverse=True)), shards):
            by_size.setdefault(size, []).append((rank, turns))
        for size, runs in by_size.items():
            for (rank, turns), end in zip(runs, [*[r for r, _ in runs[1:]], sizes[size]]):
                for i in range(end - rank):
                    got[turns[i % len(turns)]] += size
        assert got == heap_loads([s for s, n in sizes.items() for _ in range(n)], shards)


def test_sharding_is_exact_for_many_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 700)
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 40, 3000), rng.integers(1, 5000, 2000), [10**6] * 3])
    rows = [(i, f"g{i}", int(s)) for i, s in enumerate(sizes)] + [(10_000 + i, "g0", 7) for i in range(4000)] + [(None, None, None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, group_key string, size long").select("*", F.lit("x").alias("shard_"), F.lit(1).alias("_n"))
    got = sharding.assign(frame, 13).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _, _ in rows)
    totals, where, load, slots = {}, {}, [0] * 13, {}
    for r in got:
        name = r.group_key or ""
        totals[name] = totals.get(name, 0) + (r["size"] or 0)
        assert where.setdefault(name, r.shard) == r.shard
        load[r.shard] += r["size"] or 0
        slots.setdefault(r.shard, []).append(r.slot)
    assert load == heap_loads(list(totals.values()), 13)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i:i + words]) for i in range(len(w) - words + 1)}


def components_of(docs, words, similarity):
    sets = [(k, shingle_set(t, words)) for k, t in docs]
    up = {k: k for k, _ in docs}
    def root(x):
        return x if up[x] == x else root(up[x])
    for i, (k, a) in enumerate(sets):
        for m, b in sets[:i]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = root(k), root(m)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets}


def edited(n, words, changes, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(0, 10**9)}" for _ in range(words)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for at in rng.choice(words, rng.integers(0, changes), replace=False):
            own[at] = f"z{rng.integers(0, 10**9)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("rounds", [near_duplicates.PIVOT_ROUNDS, ((0, 1),)])
def test_near_duplicates_of_a_family(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_duplicates, "PIVOT_ROUNDS", rounds)
    docs = edited(90, 120, 9, 1) + [(1000 + k, t) for k, t in edited(40, 90, 12, 2)[1:]]  # the second has no original
    want = components_of(docs, 3, 85)
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and 2 < len({c for _, c in want.values()}) < 120


def test_near_duplicates_query_and_odd_rows(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_minhash_near_dedup"](spark, DATA).collect()}
    assert got == components_of(documents(spark), 3, 85)
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    at = {r.doc_id: r for r in rows}
    assert all(at[k].component_id == k and at[k].kept and at[k].n_shingles == 0 for k in (1, 2, 3))
    assert {at[k].component_id for k in (7, 8, 9)} == {7} and not at[8].kept and not at[None].kept
    assert near_duplicates.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (201, 200), (200, 201)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 200, 201: 200}


def test_hilbert_curve_is_a_walk():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tokens_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer
    texts = ["", "it's  a test\n\n x<|endoftext|> y", "été là 12 345!", " lead", "a b 　c"]
    ids, counts = packing.tokenize(texts, packing.default_ranks(), ListCache())
    at = np.concatenate([[0], np.cumsum(counts)])
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    assert [ids[at[k]:at[k + 1]].tolist() for k in range(len(texts))] == [e.ids for e in want]


def check_pieces(rows):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= 1024
    return docs, [sum(n for _, n in s) for s in sequences.values()]


def test_packing(spark, odd):
    rows = QUERIES["op8_packing"](spark, DATA).collect()
    docs, sizes = check_pieces(rows)
    for own in docs.values():
        own.sort()
        assert [s for s, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]] and sum(n for _, n, _ in own) == own[0][2]
    assert len(docs) == len(documents(spark)) and all(s & (s - 1) == 0 for s in sizes)  # no padding at all
    texts = dict(documents(spark))
    for r in rows[:50]:
        ids, _ = packing.tokenize([texts[r.doc_id]], packing.default_ranks(), ListCache())
        part = np.append(ids, packing.STOP)[r.start:r.start + r.length].astype("<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
    packed = packing.pack(odd).collect()
    assert sum(r.doc_id in (1, 2) and r.doc_tokens == 1 for r in packed) == 2
    check_pieces(packed)
    assert packing.pack(odd.limit(0)).count() == 0


def brute_vectors(rows, threshold):
    fine = {}
    for k, v in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault(k, []).append(np.array(v, dtype=float))
    links, up = {k: set() for k, _ in rows}, {k: k for k, _ in rows}
    def root(x):
        return x if up[x] == x else root(up[x])
    for k, a in fine.items():
        for m, b in fine.items():
            if k != m and len(a[0]) == len(b[0]) and a[0] @ b[0] / np.sqrt((a[0] @ a[0]) * (b[0] @ b[0])) >= threshold:
                links[k].add(m)
                x, y = root(k), root(m)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {k: (len(links[k]), root(k) if k is not None else None) for k, _ in rows}


def test_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (600, [2 * x for x in rows[3][1]])]
    rows += [(700, None), (701, []), (702, [0.0] * 24), (703, [float("nan")] * 24), (704, [1.0, None]), (705, [1.0, 2.0]), (706, [1.0, 2.0]),
             (None, rows[0][1]), (707, [float("inf")] * 24), (708, [1e-30] + [0.0] * 23), (709, [1e-38] + [0.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("label"), F.lit(1).alias("rep"))
    got = embeddings.linked_vectors(df, 0.95, tile=64, group=2).collect()
    want = brute_vectors(rows, 0.95)
    assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embeddings.linked_vectors(df.limit(0)).count() == 0


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    got = QUERIES["op10_embedding_near_dedup"](spark, DATA).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows, 0.95)


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = table(spark, DATA, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == docs.columns and kept <= ids and len(kept) >= 0.7 * len(ids), name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    pieces = corpus_pipeline.run(spark, DATA).collect()
    docs_out, _ = check_pieces(pieces)
    assert set(docs_out) <= ids and len(docs_out) >= 0.5 * len(ids)
    truth = {r.doc_id: r for r in table(spark, DATA, "labels").collect()}
    assert sum(truth[k].quality == 0 for k in docs_out if k in truth) <= 2
