"""The registered queries of the training-data operators: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, divergence, embeddings, encoding, fingerprints, infill, language, near_duplicates, packing, quality, sharding,
               token_counts, toxicity)
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    langs, prob = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs, langs, prob, keep=("doc_id", "held_out"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    lexicon = toxicity.fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, keep=("doc_id", "held_out"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encoding.encode(docs, keep=("doc_id", "text"))
    back = encoding.decode(coded, out="decoded", keep=("doc_id", "text", "ids"))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"),
        F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.crc_of_pieces(packing.pack(table(spark, sf_dir, "documents")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms, above = fingerprints.bands(docs)
    marked = fingerprints.with_next(fingerprints.fingerprints(docs, terms, above=above), "doc_id", ["text", "fingerprint"])
    edited = F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 2) AS INT))"),
                      F.expr("left(next_text, CAST(floor(length(text) / 2) AS INT))"))
    marked = marked.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited).drop("next_text")
    both = fingerprints.with_fingerprint(marked, "edited", "edited_fp", terms, above)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.shown(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.shown(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", chat.text_parts().alias("content"))
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                  "conv_id long, turn long, role string, text string")
    extra = extra.select("conv_id", "turn", "role", chat.text_parts().alias("content"))
    return chat.digests(chat.format_turns(messages.union(extra)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=85)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    learn = docs.filter(~F.col("held_out")).select("doc_id", "text")
    grader = quality.fit(quality.with_rating(learn, table(spark, sf_dir, "labels")))
    if grader is None:  # nothing to learn from: no opinion, everything stays
        return docs.select("doc_id", "held_out", *[F.lit(None).cast("double").alias(c) for c in ("expected_grade", "p_good", "p_best")],
                           F.lit(True).alias("kept"))
    return quality.grade(docs, grader, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "expected_grade", F.col("tails")[0].alias("p_good"), F.element_at("tails", -1).alias("p_best"),
        (F.col("tails")[0] >= 0.5).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    hashed = cut.withColumn("output_sha256", F.sha2("output", 256))
    back = infill.restore(hashed, out="restored", keep=digest)
    return back.select(*digest, F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM d),
 c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
   WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
 g AS (SELECT DISTINCT lang, source FROM d),
 t AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang),
 s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY lang, source),
 p AS (SELECT t.lang, t.source, t.term, t.n, 1 + (1000000000 * (t.n + 5)) // (s.n + 5 * v.v) AS p, 1 + (1000000000 * (t.all_n + 5)) // (v.n + 5 * v.v) AS q
  FROM t JOIN s ON s.lang = t.lang AND s.source = t.source JOIN v ON v.lang = t.lang),
 f AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.term = y.term
   WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
 r AS (SELECT lang, source, 'pair' AS part, item, value FROM f UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, keep=("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_document_fingerprints, op3_chat_formatting, op4_sharding, op5_toxicity, op6_sentencepiece, op7_minhash_near_dedup, op8_packing,
    op9_quality_classifier, op10_embedding_near_dedup, op11_fill_in_middle, op12_source_divergence, op13_token_counts)}
ORACLES: dict[str, str] = {"op11_fill_in_middle": OP11_SQL, "op12_source_divergence": OP12_SQL}
