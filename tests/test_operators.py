"""Operators on small frames, with hot groups and tiny buckets."""

import hashlib
import json
import random
import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from marginalia.functions.expr import quoted
from marginalia.operators import anchors, chat, corpus, costs, enrich, jobs, lookup, narratives, ordered, pages, signals


def test_neighbours_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{i % 7}", f"n{rng.random():.9f}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "g string, name string")
    df = ordered.with_order_bucket(frame, ["g"], ["name"])
    assert df.groupBy("g", "_bucket").count().agg(F.max("count")).first()[0] < 60
    groups = {}
    for g, name in sorted(rows):
        groups.setdefault(g, []).append(name)
    want = {(g, x): (ns[i - 1] if i else None, ns[i + 1] if i + 1 < len(ns) else None)
            for g, ns in groups.items() for i, x in enumerate(ns)}
    out = ordered.neighbours(frame, ["g"], ["name"], "name", prev="p", next_="n").collect()
    assert {(r.g, r.name): (r.p, r.n) for r in out} == want


def test_neighbours_by_append_number(spark):
    rng = random.Random(2)
    numbers = [*rng.sample(range(-50, 4000), 900), None]
    rows = [("hot" if rng.random() < 0.5 else f"g{i % 5}", n) for i, n in enumerate(numbers)]
    frame = spark.createDataFrame(rows, "g string, n long")
    groups = {}
    for g, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        groups.setdefault(g, []).append(n)
    want = {(g, x): (ns[i - 1] if i else None, ns[i + 1] if i + 1 < len(ns) else None)
            for g, ns in groups.items() for i, x in enumerate(ns)}
    for size in (16, 10_000):
        out = ordered.neighbours(frame, ["g"], ["n"], "n", prev="p", next_="q", rows=size).collect()
        assert {(r.g, r.n): (r.p, r.q) for r in out} == want


def test_request_sizes(spark):
    rows = [(5, f"t{i}") for i in range(19)] + [(9000, "far"), (-1, "below")]
    frame = spark.createDataFrame(rows, "seq long, title string").selectExpr("*", "'a' AS account", "'d' AS date", "'x' AS text")
    got = sorted((r.start, r.n_articles) for r in signals.article_payload(frame, "seq").collect())
    assert got == [(-4096, 1), (0, 3), (0, 8), (0, 8), (8192, 1)]


def test_full_requests(spark):
    numbers = [*range(0, 9000, 700), *range(5000, 5013), 10**9, -3, None]
    rows = [(n, f"t{n}") for n in numbers]
    frame = spark.createDataFrame(rows, "seq long, title string").selectExpr("*", "'a' AS account", "'d' AS date", "'x' AS text")
    got = sorted((r.batch, r.n_articles, r.payload) for r in signals.article_requests(frame, "seq").collect())
    order = sorted(n for n in numbers if n is not None)
    assert [n for _, n, _ in got] == [8] * (len(order) // 8) + [len(order) % 8][:len(order) % 8]
    assert [x["title"] for _, _, p in got for x in json.loads(p)] == [f"t{n}" for n in order]


def test_document_list_of_a_request(spark):
    articles = spark.createDataFrame([(1, " T ", "a", "2024-02-01T1", "x" * 5000)], "seq long, title string, account string, date string, text string")
    docs = spark.createDataFrame([("b.md", "B", "t" * 70, None), ("a.md", "A", "", "g" * 120)], "name string, title string, tagline string, gist string")
    r = signals.extraction_requests(articles, docs, "seq").first()
    assert r.doc_list == f"- a.md | A —  | 内容：{'g' * 100}\n- b.md | B — {'t' * 60} | 内容："
    assert json.loads(r.payload) == {"title": "T", "account": "a", "date": "2024-02-01", "text": "x" * 4000}
    assert signals.extraction_requests(articles, docs.limit(0), "seq").first().doc_list == signals.NO_DOCS
    many = spark.range(signals.DOC_LIST + 1).selectExpr("CAST(id AS STRING) AS name", "'t' AS title", "'l' AS tagline", "'g' AS gist")
    with pytest.raises(Exception, match="documents in the list"):
        signals.extraction_requests(articles, many, "seq").collect()


def test_document_list_of_any_length(spark):
    articles = spark.range(3).selectExpr("id AS seq", "'t' AS title", "'a' AS account", "'d' AS date", "'x' AS text")
    names = [f"n{i * 7919 % 5003:06d}.md" for i in range(5003)]
    docs = spark.createDataFrame([(n, None if n.endswith("7.md") else f"T {n}", "é" * 70, None) for n in names],
                                 "name string, title string, tagline string, gist string").repartition(7)
    line = lambda n: f"- {n} | {'' if n.endswith('7.md') else 'T ' + n} — {'é' * 60} | 内容："
    want = "\n".join(map(line, sorted(names)))
    assert "\n".join(r.text for r in signals.list_parts(docs).orderBy("part").collect()) == want
    got = signals.filing_requests(articles, docs, "seq").collect()
    assert sorted(r.seq for r in got) == [0, 1, 2] and {r.list_md5 for r in got} == {hashlib.md5(want.encode()).hexdigest()}
    few = docs.where("name < 'n000900'")
    held = signals.extraction_requests(articles, few, "seq").first().doc_list
    assert signals.filing_requests(articles, few, "seq").first().list_md5 == hashlib.md5(held.encode()).hexdigest()
    none = signals.filing_requests(articles, docs.limit(0), "seq").first().list_md5
    assert none == hashlib.md5(signals.NO_DOCS.encode()).hexdigest()


def test_search_with_a_table_of_queries(spark):
    docs = spark.createDataFrame([("k", "a.md", "Alpha", "x"), ("k", "b.md", "beta", "alpha")],
                                 "category_key string, name string, title string, content string")
    asked = spark.createDataFrame([("ALPHA",), ("alpha",), ("",), (None,), ("zz",)], "q string")
    got = [(r.q, r.name, r.score) for r in corpus.search_many(docs, asked).orderBy("rank").collect()]
    assert got == [("alpha", "a.md", 10), ("alpha", "b.md", 3)]
    assert corpus.search_many(docs, asked.limit(0)).count() == 0


def test_quoted_ends_in_a_heading(spark, one):
    assert one(F.col("c").rlike("^" + quoted(r"a\Eb.") + "$"), c=r"a\Eb.")
    assert not one(F.col("c").rlike("^" + quoted(r"a\Eb.") + "$"), c=r"a\EbX")


def test_no_job_while_a_plan_is_built(spark, monkeypatch):
    new = spark.createDataFrame([("a", 1)], "base string, seq long")
    used = spark.createDataFrame([("a", 1)], "base string, suffix int")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    ordered.unique_names(new, used)
    ordered.neighbours(new, ["base"], ["seq"], "seq", prev="p")
    assert len(tracker.getJobIdsForGroup()) == before


def test_unique_names_against_brute_force(spark):
    rng = random.Random(5)
    new = [(rng.choice(["hot", "hot", "hot", "x", "y"]), i) for i in range(400)]
    used = {(rng.choice(["hot", "x", "z"]), rng.randint(1, 120)) for _ in range(150)}
    for limit in (11, 1000):
        got = ordered.unique_names(spark.createDataFrame(new, "base string, seq long"),
                                   spark.createDataFrame(sorted(used), "base string, suffix int"), rows=limit)
        names, taken = {r.seq: r.name for r in got.collect()}, set(used)
        for base, seq in new:
            n = next(k for k in range(1, 1000) if (base, k) not in taken)
            taken.add((base, n))
            assert names[seq] == (base if n == 1 else f"{base}_{n}")


def test_search_order_and_weights(spark):
    docs = spark.createDataFrame([
        ("", "a.md", "a.md", "Alpha", ["x"], "", "其他", "zzz"), ("k", "b.md", "k/b.md", "b", ["ALPHA"], "", "c", "alpha"),
        ("k", "c.md", "k/c.md", "c", ["x"], "alpha", "c", "q"), ("k", "d.md", "k/d.md", "d", ["x"], "", "c", "q")],
        "category_key string, name string, path string, title string, tags array<string>, project string, "
        "category string, content string")
    got = [(r.path, r.score) for r in corpus.search(docs, "alpha").collect()]
    assert got == [("k/b.md", 11), ("a.md", 10), ("k/c.md", 6)]
    assert [r.path for r in corpus.search(docs, "").collect()] == ["a.md", "k/b.md", "k/c.md", "k/d.md"]
    many = corpus.search_many(docs, ["alpha", "q"], 1).collect()
    assert {(r.q, r.path) for r in many} == {("alpha", "k/b.md"), ("q", "k/c.md")}


def test_related_counts_words_once(spark):
    docs = spark.createDataFrame([
        ("k", "a", "a", "C", ["t"], "P", "apple banana cherry tiny"), ("k", "b", "b", "D", [], "", "Apple apple BANANA x"),
        ("k", "c", "c", "C", ["t"], "P", "none"), ("k", "d", "d", "D", [], "", "tiny")],
        "category_key string, name string, path string, category string, tags array<string>, project string, content string")
    got = [(r.path, r.score) for r in corpus.related(docs, "a").collect()]
    assert got == [("c", 10.0), ("b", 0.2)]
    assert corpus.related(docs, "missing").count() == 0


def test_contained_in(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xyz"), (3, "")], "id int, t string")
    needles = spark.createDataFrame([("abc", 0), ("b", 1), ("", 2), ("longer than all", 3)], "w string, p int")
    got = {(r.id, r.w) for r in lookup.contained_in(texts, "t", needles, "w").collect()}
    assert got == {(1, "abc"), (1, "b")}


@pytest.mark.parametrize("count", [10, 10_000])
def test_containment_against_brute_force(spark, count):
    rng = random.Random(count)
    letters = ["a", "b", "c", "é", "你", " "]
    texts = [(i, "hot " * (i % 3 == 0) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))) for i in range(300)] + [(300, None), (300, "ab")]
    needles = ["a", "é", "hot", " ", ""] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(count)]
    frame = spark.createDataFrame(texts, "id int, t string")
    got = lookup.contained_in(frame, "t", spark.createDataFrame([(n, len(n)) for n in needles], "w string, size int"), "w")
    want = sorted((i, t, w) for i, t in texts for w in needles if t and w and w in t)
    assert sorted((r.id, r.t, r.w) for r in got.collect()) == want


def test_texts_emit_their_anchors_only(spark):
    texts = spark.createDataFrame([(i, f"a common title of number {i}") for i in range(2000)], "id int, t string")
    needles = spark.createDataFrame([(f"number {i}77",) for i in range(10)] + [("common title of zzz",)], "w string")
    maybe = anchors.candidates(texts, "t", ["id"], needles, "w").count()
    hits = lookup.contained_in(texts, "t", needles, "w").count()
    assert hits == 9 + 10 and maybe <= 4 * 200  # every text has 25 grams; only texts with a 77 in them emit one


def test_grams_of_long_texts_in_bounded_memory():
    raw = np.random.default_rng(5).integers(97, 123, 3_000_000, dtype=np.uint8)
    for wanted in (None, np.random.default_rng(6).integers(0, 256, anchors.GRAMS >> 3, dtype=np.uint8)):
        want = np.unique(anchors.gram_codes(raw, np.array([0, len(raw)]), wanted, False)[0])
        tracemalloc.start()
        codes, owner = anchors.distinct_grams(raw, np.array([0, len(raw)]), wanted, False)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert codes.tolist() == want.tolist() and not owner.any() and peak < 120_000_000
    texts = [b"abcab", b"", b"\xe4\xbd\xa0", b"ab"]
    starts = np.cumsum([0, *map(len, texts)])
    codes, owner = anchors.distinct_grams(np.frombuffer(b"".join(texts), dtype=np.uint8), starts, None, True)
    assert np.bincount(owner, minlength=4).tolist() == [3, 0, 1, 1]


def test_search_table_is_like_the_list(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAé你") for _ in range(rng.randint(1, 5)))
    rows = [(rng.choice(["", "k"]), f"n{i}.md", f"n{i}.md", word(), [word(), None] if i % 3 else None, word(), rng.choice(["c", "d"]),
             " ".join(word() for _ in range(30)) if i % 4 else None) for i in range(120)]
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, "category_key string, name string, path string, title string, tags array<string>, "
                                       "project string, category string, content string")
    asked = ["a", "É", "ab", "你", "aba", "zz", "ab a", ".md", "n1"]
    for limit in (3, 1000):
        listed, table = corpus.search_many(docs, asked, limit), corpus.search_many(
            docs, spark.createDataFrame([(q,) for q in [*asked, "A", "", None]], "q string"), limit)
        shown = lambda df: sorted((r.q, r.path, r.score, r["rank"], str(r.tags)) for r in df.collect())
        assert shown(table) == shown(listed) and sorted(table.columns) == sorted(listed.columns)


def test_search_with_very_many_queries(spark):
    docs = spark.createDataFrame([("k", f"n{i}.md", f"title {i}", f"body of {i * 37 % 1000}") for i in range(300)],
                                 "category_key string, name string, title string, content string")
    asked = spark.range(100_000).selectExpr("concat('title ', id) AS q")
    got = corpus.search_many(docs, asked).where("rank = 1").collect()
    assert {r.q for r in got} == {f"title {i}" for i in range(300)} and all(r.score == 10 for r in got)


SIGNAL = '{"title": " T1 ", "date": "2024-01-02T10", "source_type": "小道消息", "event_type": "八卦", "theme": "火星产业", "importance": "爆表"}'


def replies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, reply string")


def test_parse_items(spark):
    df = replies(spark, f"```json\n[{SIGNAL}]\n```", f"前 [{SIGNAL}] 后", "plain", "[1, 2]", "[{bad]", '{"a": [1]}')
    rows = signals.parse_items(df, "reply", "光通信").collect()
    assert [(r.i, r.title, r.theme, r.source_type, r.event_type, r.date) for r in rows] == [
        (i, "T1", "光通信", "产业信息", "Market", "2024-01-02") for i in (0, 1)]
    art = signals.parse_article_items(df, "reply").first()
    assert (art.theme, art.importance, art.origin, art.auto) == ("其他", "中", "wechat", False)


def test_limit_counts_untitled_items(spark):
    text = "[" + ",".join(['{"title": ""}'] + ['{"title": "t%d"}' % i for i in range(13)]) + "]"
    assert signals.parse_items(replies(spark, text), "reply", "x", 10).count() == 9


def test_parse_object(spark):
    df = replies(spark, 'pre {"a": 1, "b": [2]} post', "[1,2,3]", "prose", "{bad}")
    got = df.select(F.try_variant_get(signals.json_object("reply"), "$.a", "int")).collect()
    assert [r[0] for r in got] == [1, None, None, None]


def test_extraction(spark):
    df = replies(spark, '{"target": " NEW ", "key_points": ["a", " ", "b"], "metrics": "x", "new_title": "1.6T 光模块"}')
    r = signals.conform_extraction(df, "reply").first()
    assert (r.target, r.key_points, r.metrics) == ("NEW", ["a", "b"], [])


def test_route_target(spark):
    cases = [("a b.md", "x", "y", "a b.md"), ("NEW", "1.6T 光模块", "", "1.6T_光模块.md"), ("X", "", "X", "X.md"),
             ("", "", "", "未命名技术.md")]
    df = spark.createDataFrame(cases, "t string, n string, o string, want string")
    for r in df.select(signals.route_target(F.col("t"), F.col("n"), F.col("o")).alias("got"), "want").collect():
        assert r.got == r.want


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-01-01",), ("",), ("本周",), (None,), ("2024-13-01",)], "date string")
    fresh = [r.date for r in signals.fresh(df, "2024-01-31").collect()]
    assert fresh == ["2024-01-31", "", "本周", None, "2024-13-01"]
    assert [r.date for r in signals.since(df, "2024-01-31", 7).collect()] == ["2024-01-31", "本周", "2024-13-01"]
    kept = df.where(signals.in_range("date", "2024-01-01", "2024-01-31")).collect()
    assert [r.date for r in kept] == ["2024-01-31", "2024-01-01"]


def test_dedup(spark):
    pool = spark.createDataFrame([(1, "AB 厂商扩产"), (2, "other")], "seq long, title string")
    items = spark.createDataFrame([(3, "AB厂商 扩产"), (4, "AB，厂商扩产！"), (5, "Other"), (6, "new"), (7, ""), (8, "NEW")],
                                  "seq long, title string")
    assert [(r.seq, r.origin, r.auto) for r in signals.append_to_pool(pool, items).collect()] == [(6, "wechat", False)]


def test_merge_angles(spark):
    rows = [(1, "t", "q1", "A"), (2, "t", "q1", "B"), (3, "t", "q2", "A"), (4, "t", "q2", "C")]
    got = signals.merge_angles(spark.createDataFrame(rows, "seq long, theme string, sub_query string, title string"))
    assert [r.title for r in got.orderBy("rank").collect()] == ["A", "B", "C"]


def test_narratives_start_from_known_state(spark):
    schema = "theme string, seq long, date string, narrative string, trigger string"
    feed = spark.createDataFrame([("a", 1, "d1", "x", "t1"), ("a", 2, "d2", " ", "t2"), ("a", 3, "d3", "x", "t3"),
                                  ("a", 4, "d4", "y", "t4"), ("b", 5, "d5", "z", "t5")], schema)
    rows = [(r.theme, r.seq, r.previous, r.new_narrative, r.trigger, r.is_transition)
            for r in narratives.history(feed).orderBy("seq").collect()]
    assert rows == [("a", 1, "（首次建立）", "x", "", True), ("a", 4, "x", "y", "t4", False), ("b", 5, "（首次建立）", "z", "", True)]
    known = spark.createDataFrame([("a", "x"), ("b", "w")], "theme string, narrative string")
    rows = [(r.theme, r.seq, r.previous) for r in narratives.history(feed, known).orderBy("seq").collect()]
    assert rows == [("a", 4, "x"), ("b", 5, "w")]
    cur = {r.theme: (r.narrative, r.updated) for r in narratives.current(feed).collect()}
    assert cur == {"a": ("y", "d4"), "b": ("z", "d5")}


def test_eta(one):
    now = "2024-01-01 00:02:00"
    eta = lambda s, d, t: one(jobs.eta_secs(F.col("s"), F.col("d"), F.col("t"), now), s=s, d=d, t=t)
    assert eta("2024-01-01T00:00:00", 2, 8) == 360
    assert eta("2024-01-01T00:00:00", 0, 8) is None and eta("2024-01-01T00:00:00", 8, 8) is None
    assert eta("bad", 2, 8) is None


def test_job_status(one):
    status = lambda s, idle, c=False: one(
        jobs.norm_status(F.col("s"), F.col("i"), F.col("c")), s=s, i=idle, c=c)
    assert status("running", 601) == "interrupted" and status("running", 600) == "running"
    assert status("", 0) == "done" and status("done", 0, True) == "interrupted" and status("odd", 0) == "odd"


def test_provider(one):
    match = lambda m, u: one(costs.match_provider(F.col("m"), F.col("u")), m=m, u=u)
    assert match("x", "https://api.deepseek.com/v1/") == "deepseek"
    assert match("KIMI-k2", "https://proxy") == "moonshot" and match("zz", "https://proxy") is None


def test_phase(spark):
    rows = [(1, 0, "user", "【Step 2 · b】"), (1, 1, "assistant", "x【Step 3 · c】"), (2, 0, "assistant", "【Step 9 · deep】"),
            (3, 0, "assistant", "【Step 2 · b】"), (3, 1, "assistant", "none"), (4, 0, "user", "hi")]
    got = {r.conv_id: r.phase for r in chat.current_phase(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")).collect()}
    assert got == {1: "反向世界", 2: "DEEP", 3: "假设攻击", 4: "假设攻击"}


def test_page_conversion(spark):
    docs = spark.createDataFrame([("a", ["dense " * 40] * 5 + [""] * 5)], "doc string, pages array<string>")
    plan = pages.chunk_plan(docs, "doc", 5)
    engines = {"vision": F.lit("seen"), "local": F.when(F.col("text_layer"), F.col("raw")).otherwise("")}
    out = {r.chunk: r.engine for r in pages.convert(plan, engines, vision="vision").collect()}
    assert out == {0: "local", 1: "vision"}
    failed = pages.convert(plan, {"local": F.lit(" ")})
    assert [r.page for r in pages.degraded_pages(failed, "doc").orderBy("page").collect()] == list(range(1, 11))
    md = pages.assemble(failed, "doc").first().markdown
    assert md.startswith("<!-- p.1-5 · engine:pypdf -->") and md.endswith("engine:pypdf -->\n")


def test_enrich_retries_empty_replies(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "i int, prompt string")

    def service(prompts, seen=set()):  # noqa: B006 - state of one worker
        out = []
        for p in prompts:
            out.append("" if p == "p3" or (p == "p1" and p not in seen) else p.upper())
            seen.add(p)
        return out

    got = {r.i: (r.reply, r.failed) for r in enrich.enrich(df, "prompt", service, parallelism=1).collect()}
    assert got[0] == ("P0", False) and got[1] == ("P1", False) and got[3] == ("", True)


def test_enrich_keeps_going_after_a_failure(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "fine")], "i int, prompt string")

    def down(prompts):
        raise TimeoutError("slow")

    def short(prompts):
        return prompts[:1]

    def unset(prompts):
        raise enrich.ConfigurationError("no key")

    assert {(r.failed, r.error) for r in enrich.enrich(df, "prompt", down).collect()} == {(True, "TimeoutError: slow")}
    assert all(r.failed and "replies to" in r.error for r in enrich.enrich(df.coalesce(1), "prompt", short, retries=0).collect())
    with pytest.raises(Exception, match="no key"):
        enrich.enrich(df, "prompt", unset).collect()


def test_enrich_calls_are_bounded(spark):
    sizes = [0, 5, 300_000, 800_000, 10, 2_000_000, 3, None, *[90_000] * 30]
    rows = [(i, None if n is None else "é" * (n // 2), i if i % 2 else None) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, prompt string, extra int").coalesce(1)

    def service(prompts):
        size = sum(len((p or "").encode()) for p in prompts)
        return [f"{len(prompts)} {size} {len(p or '')}" for p in prompts]

    got = {r.i: r for r in enrich.enrich(df, "prompt", service).collect()}
    assert [(got[i].prompt, got[i].extra) for i in range(len(rows))] == [r[1:] for r in rows]
    for i, n in enumerate(sizes):
        count, size, own = map(int, got[i].reply.split())
        assert own == (n or 0) // 2 and not got[i].failed and (size <= enrich.CALL_BYTES or count == 1)
