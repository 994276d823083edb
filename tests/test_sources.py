"""File sources, sinks and streams on temporary folders."""

import os
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from marginalia.session import shared_dir
from marginalia.sources import articles, corpus_files, logs, upserts, versions
from marginalia.streaming import costs, index, jobs, narratives, signals, sinks

DOC = "# Title {0}\n> tag\n**Status**: 已投资\nTags: a,b | x\n\nbody"


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "kb"
    for rel in ("root.md", "02_deals/b.md", "02_deals/a.md", "zz/c.md", "02_deals/deep/no.md", "02_deals/skip.txt"):
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(DOC.format(rel), encoding="utf-8")
    (root / "02_deals" / "bad.md").write_bytes("中文".encode("gbk"))
    return str(root)


def test_scan_and_index(spark, corpus, tmp_path):
    docs = corpus_files.build_index(spark, corpus, [("Title zz", "T")])
    rows = {r.path: r for r in docs.collect()}
    assert set(rows) == {"root.md", "02_deals/a.md", "02_deals/b.md", "zz/c.md"}
    assert rows["root.md"].category_key == "" and rows["zz/c.md"].track == "T"
    assert rows["02_deals/a.md"].status == "已投资" and rows["02_deals/a.md"].tags == ["a", "b"]
    path = str(tmp_path / "index")
    assert corpus_files.load_index(spark, corpus, path).count() == 4
    os.remove(os.path.join(corpus, "root.md"))
    assert corpus_files.load_index(spark, corpus, path).count() == 4
    assert corpus_files.load_index(spark, corpus, path, force=True).count() == 3
    one = versions.read(spark, path).where("part = '02_deals'")
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) and one.count() == 2


def test_decode(spark):
    rows = [(1, "你好".encode()), (2, "你好".encode("gbk")), (3, b"ab\xff"), (4, None)]
    got = {r.i: r.text for r in corpus_files.decode_text(
        spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert got == {1: "你好", 2: "你好", 3: "ab�", 4: None}


def test_state_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    bad.write_text('[{"a": 1},')
    schema = "a long, b string"
    assert [r.a for r in logs.read_state(spark, str(good), schema).collect()] == [1, 2]
    assert logs.read_state(spark, str(bad), schema).count() == 0
    assert logs.read_state(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_log_append_and_read(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in (1, 2):
        logs.append_log(spark.createDataFrame([(f"2024-01-0{n}", "radar", n)], "ts string, feature string, prompt_tokens long"), path)
    with open(os.path.join(path, "part-extra.json"), "w") as f:
        f.write("\n{broken\n")
    rows = logs.parse_cost_lines(logs.read_lines(spark, path)).collect()
    assert sorted(r.prompt_tokens or 0 for r in rows) == [0, 1, 2] and sum(r.corrupt for r in rows) == 1


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("# c\nhttp://a\n\n  http://b \n # kept\n")
    assert [r.value for r in logs.url_list(logs.read_lines(spark, str(path))).collect()] == ["http://a", "http://b", "# kept"]


def test_save_state_replaces(spark, tmp_path):
    path = str(tmp_path / "state")
    logs.save_state(spark.range(5), path)
    logs.save_state(spark.range(2), path)
    logs.save_state(logs.load_state(spark, path).limit(1), path)
    assert logs.load_state(spark, path).count() == 1 and versions.versions(spark, path) == [2, 3]


def test_failed_write_keeps_the_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert logs.load_state(spark, path, "id long").count() == 0
    logs.save_state(spark.range(5), path)
    broken = spark.range(0, 4, 1, 4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        logs.save_state(broken, path)
    assert logs.load_state(spark, path).count() == 5 and os.listdir(path) == ["v0000000001"]


PAGE = ('<meta property="og:title" content="标题 &amp; x"/><meta content="作者" name="author">{}'
        '<script>var ct = "1700000000";</script><div id="js_content"><p>第一段 &amp; a</p><style>p</style>'
        '<p>第二段</p></div><script>footer</script>')


def test_article(one):
    got = one(F.struct(*[c.alias(n) for n, c in articles.article("p").items()]),
              p=PAGE.format('<script>var nickname = htmlDecode("号主");</script>'))
    assert (got.title, got.account, got.date, got.text) == ("标题 & x", "号主", "2023-11-14", "第一段 & a\n第二段")
    assert one(articles.article("p")["account"], p=PAGE.format("")) == "作者"
    h1 = one(articles.article("p")["title"], p='<h1 class="rich_media_title" id="x"> A\n <b>B</b></h1>')
    assert h1 == "A B"


# ---- streams ----------------------------------------------------------------------------------

def staged(spark, folder, rows, schema):
    """One file per call, so each file is a micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_signal_stream_over_restarts(spark, tmp_path):
    schema, src, work = "seq long, date string, title string", str(tmp_path / "in"), str(tmp_path / "work")
    staged(spark, src, [(1, "2024-01-30", "A b"), (2, "2024-01-01", "old"), (3, "", "undated")], schema)
    assert signals.dedup_append(stream(spark, src, schema), work, as_of="2024-01-31").count() == 2
    staged(spark, src, [(4, "2024-01-30", "a-B"), (5, "2024-01-30", "fresh"), (6, "本周", "week")], schema)
    staged(spark, src, [(7, "2024-01-30", "Fresh!"), (8, "2024-01-19", "late"), (9, "2024-01-21", "edge")], schema)
    got = signals.dedup_append(stream(spark, src, schema), work, as_of="2024-01-31")
    assert sorted(r.seq for r in got.collect()) == [1, 3, 5, 6, 9]


def test_narrative_stream_keeps_state(spark, tmp_path):
    schema = "theme string, seq long, date string, narrative string, trigger string"
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    staged(spark, src, [("a", 1, "d1", "x", "t1"), ("b", 2, "d2", "y", "t2")], schema)
    narratives.narrative_history(stream(spark, src, schema), work)
    staged(spark, src, [("a", 3, "d3", "x", "t3"), ("b", 4, "d4", "z", "t4")], schema)
    narratives.narrative_history(stream(spark, src, schema), work)
    staged(spark, src, [("a", 5, "d5", "w", "t5"), ("a", 6, "d6", "x", "t6")], schema)
    rows = narratives.narrative_history(stream(spark, src, schema), work).orderBy("seq").collect()
    assert [(r.seq, r.previous) for r in rows] == [(1, "（首次建立）"), (2, "（首次建立）"), (4, "y"), (5, "x"), (6, "w")]


def test_watermark_dedup_and_stale_jobs(spark, tmp_path):
    schema, src = "ts timestamp, title string, job long, status string", str(tmp_path / "in")
    staged(spark, src, [(D(2024, 1, 1), "A", 1, "running"), (D(2024, 1, 1), "a!", 2, "running"),
                        (D(2024, 1, 1, 0, 9), "B", 2, "running"), (D(2024, 1, 1), "C", 3, "done")], schema)
    q = (signals.dedup_within_watermark(stream(spark, src, schema), "ts").writeStream.format("memory")
         .queryName("dedup_wm").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("dedup_wm").count() == 3
    last = jobs.last_heartbeats(spark.read.schema(schema).parquet(src))
    got = {r.job: r.status for r in jobs.with_staleness(last, "2024-01-01 00:15:00").collect()}
    assert got == {1: "interrupted", 2: "running", 3: "done"}


def test_signal_stream_reads_only_its_own_input(spark, tmp_path):
    schema, src, work = "seq long, date string, title string", str(tmp_path / "in"), str(tmp_path / "work")
    rows = [(100 * b + i, "2024-01-30" if i % 7 else "2023-01-01", f"t{(b * 31 + i * i) % 200}") for b in range(10) for i in range(40)]
    for b in range(10):
        staged(spark, src, rows[40 * b:40 * b + 40][::-1], schema)
        if b in (3, 9):  # the set of titles outlives a restart
            pool = signals.dedup_append(stream(spark, src, schema), work, as_of="2024-01-31")
    first = {}
    for seq, date, title in rows:
        if date == "2024-01-30":
            first.setdefault(title, seq)
    assert {r.title: r.seq for r in pool.collect()} == first and pool.count() == len(first)
    report = sinks.report(spark, work).orderBy("batch_id").collect()
    assert [r.batch_id for r in report] == list(range(10)) and all(r.rows_read == 40 for r in report)
    assert report[-1].state_rows == len(first)
    assert sum(r.observed["late"] for r in report) == sum(d != "2024-01-30" for _, d, _ in rows)


def test_windows_leave_the_state(spark, tmp_path):
    schema, src, work = "ts timestamp, theme string", str(tmp_path / "in"), str(tmp_path / "work")
    days = [D(2024, 1 + d // 28, 1 + d % 28) for d in range(0, 280, 7)]
    for k in range(0, len(days), 4):
        staged(spark, src, [(d, t) for d in days[k:k + 4] for t in "ab"] + ([(D(2024, 1, 1), "late")] if k > 8 else []), schema)
    got = signals.run_windows(signals.weekly_counts(stream(spark, src, schema), "ts"), "weekly", work).collect()
    seen = {(r.start, r.theme): r.n for r in got}
    assert len(seen) == len(got) and sum(n for (_, t), n in seen.items() if t != "late") == 2 * len(days)
    assert all(t != "late" for _, t in seen) and {r.closed for r in got} == {True, False}
    report = sinks.report(spark, work).collect()
    assert max(r.state_rows for r in report) <= 16 and sum(r.late_in_state for r in report) > 0


def test_totals_in_update_mode(spark, tmp_path):
    schema = "day string, feature string, model string, prompt_tokens long, completion_tokens long"
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    for b in range(4):
        staged(spark, src, [(f"d{b}", "x", "qwen-plus", 1, 1), ("d0", "y", "qwen-plus", 10, b)], schema)
        totals = sinks.run_to_table(costs.cost_totals(stream(spark, src, schema)), "costs", ["day", "feature"], work)
    assert {(r.day, r.feature): (r.calls, r.tokens) for r in totals.collect()} == {
        **{(f"d{b}", "x"): (1, 2) for b in range(4)}, ("d0", "y"): (4, 46)}


def test_stale_jobs_are_reported_without_input(spark, tmp_path):
    schema, src, out = "ts timestamp, job long, status string, kind string", str(tmp_path / "in"), str(tmp_path / "out")
    now = D.now()
    staged(spark, src, [(now, 1, "running", "x"), (now, 2, "done", "x"), (D(2024, 1, 1), 3, "running", "x"), (now, 4, "running", "x")], schema)
    secs = F.when(F.col("job") == 1, 3).otherwise(600)
    query = (jobs.status_changes(stream(spark, src, schema), stale=secs).writeStream.outputMode("update")
             .foreachBatch(sinks.write_batch(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    try:
        last = {}
        until = time.time() + 90
        while last.get(1) != "interrupted" and time.time() < until:
            time.sleep(1)
            if query.lastProgress and os.path.exists(out):
                last = {r.job: r.status for r in spark.read.schema("job long, at long, status string").parquet(out).orderBy("at").collect()}
    finally:
        query.stop()
    assert last == {1: "interrupted", 2: "done", 3: "interrupted", 4: "running"}
    assert {p["numInputRows"] for p in query.recentProgress} == {0, 4}


def test_stale_jobs_of_a_log(spark, tmp_path):
    schema, src, work = "ts timestamp, job long, status string, kind string", str(tmp_path / "in"), str(tmp_path / "work")
    at = lambda m, s=0: D(2024, 1, 1, 0, m, s)
    staged(spark, src, [(at(0), 1, "running", "x"), (at(0), 2, "running", "battle"), (at(0), 3, "done", "x"), (at(5), 4, "running", "x"),
                        (at(0), 5, "running", "x"), (None, 6, "running", "x")], schema)
    staged(spark, src, [(at(9), 5, "running", "x"), (at(1), 3, "running", "x"), (at(8), 4, "error", "x"), (at(1), 5, "done", "x")], schema)
    got = jobs.run_statuses(stream(spark, src, schema), until="2024-01-01 00:10:01", work=work).collect()
    assert {r.job: r.status for r in got} == {1: "interrupted", 2: "interrupted", 3: "running", 4: "error", 5: "running"}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long"
    def put(changes, change, **how):
        upserts.upsert(spark.createDataFrame(changes, schema), path, ["k"], change, **how)
    def whole():
        df = upserts.read(spark, path, spark.createDataFrame([], schema).schema)
        return {r.k: r.v for r in df.collect()}
    put([(k, 0) for k in range(200)], 0, buckets=8)
    parts = versions.last(spark, path)[1]["parts"]
    put([(5, 1), (1000, 1)], 1)
    after = versions.last(spark, path)[1]["parts"]
    assert sum(parts[b][0] != after[b][0] for b in parts) <= 2 and whole() == {**{k: 0 for k in range(200)}, 5: 1, 1000: 1}
    put([(7, 9)], 1)  # repeated after a failure: nothing happens
    assert whole()[7] == 0 and upserts.applied(spark, path) == 1
    put([], 2)
    put([(7, 9)], 3, rows=5)  # too many rows a bucket: more of them
    content = versions.last(spark, path)[1]
    assert content["buckets"] == 64 and whole() == {**{k: 0 for k in range(200)}, 5: 1, 7: 9, 1000: 1}
    keys = spark.createDataFrame([(5, 0), (6, 0), (4000, 0)], schema)
    found = upserts.lookup(spark, path, keys.schema, keys, ["k"])
    assert {r.k: r.v for r in found.collect()} == {5: 1, 6: 0}
    with pytest.raises(Exception):
        upserts.upsert(spark.range(1).select(F.col("id").alias("k"), F.raise_error(F.lit("no")).cast("long").alias("v")), path, ["k"], 4)
    assert upserts.applied(spark, path) == 3 and whole()[0] == 0


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(spark, path, spark.range(3).write.parquet)
    def write(n):
        try:
            versions.publish(spark, path, spark.range(n).write.parquet)
            return n
        except versions.Conflict:
            return None
    with ThreadPoolExecutor(2) as pool:
        for _ in range(3):
            number = versions.versions(spark, path)[-1]
            won = [n for n in pool.map(write, (5, 7)) if n]
            assert won and versions.versions(spark, path)[-1] == number + len(won) and versions.read(spark, path).count() in won
    number, content = versions.last(spark, path)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, number, content)
    with open(versions.version_path(path, number + 1), "w") as f:  # a writer that died in the middle of its record
        f.write('{"fol')
    assert versions.latest(spark, path) == content["folder"]
    versions.publish(spark, path, spark.range(9).write.parquet)
    assert versions.read(spark, path).count() == 9


def test_incremental_index(spark, corpus, tmp_path):
    work = str(tmp_path / "work")
    assert index.incremental_index(spark, corpus, work).count() == 4
    with open(os.path.join(corpus, "zz", "new.md"), "w") as f:
        f.write("# New")
    docs = {r.path: r.title for r in index.incremental_index(spark, corpus, work).collect()}
    assert len(docs) == 5 and docs["zz/new.md"] == "New"
    for name, text in (("new.md", "# Newer"), ("old.md", "# Old")):
        with open(os.path.join(corpus, "zz", name), "w") as f:
            f.write(text)
    os.utime(os.path.join(corpus, "zz", "old.md"), (1, time.time() - 30 * 86400))
    os.remove(os.path.join(corpus, "root.md"))
    docs = {r.path: r.title for r in index.incremental_index(spark, corpus, work).collect()}
    assert len(docs) == 5 and docs["zz/new.md"] == "Newer" and docs["zz/old.md"] == "Old" and "root.md" not in docs
    again = {r.path: r.title for r in index.incremental_index(spark, corpus, work).collect()}
    assert again == docs


def test_shared_dir_follows_the_cluster_setting(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
