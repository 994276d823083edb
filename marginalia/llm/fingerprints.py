"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms within a band of inverse document frequency, counted over all documents.
A text keeps its distinct lexicon terms in sorted order; each of several randomised subsets of the
lexicon (a term is in a subset by its hash) gives one hash of the terms left. The fingerprint is the
list of these hashes. Subsets of different sparsity make likeness gradual: broad ones only agree on
texts with the same terms, sparse ones still agree when part of the text has changed.

A bounded number of terms from outside the lexicon is always added, so a text of a small language or
topic, which has few lexicon terms or none, is told by its own words, and one lexicon term more or
less never changes which terms a text is told by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions

# Families of subsets: the share of the lexicon that each subset keeps, in 1024ths, and their number.
# The first finds texts with the same terms; the sparse ones tell how much two texts have in common.
FAMILIES = ((683, 4), (16, 8), (4, 8), (4, 8), (1, 8))
LEAST_SHARE, MOST_SHARE = 0.005, 0.2  # documents that hold a lexicon term; idf 5.3 down to 1.6
EXTRA = 32  # terms below the band that a text adds at most
NOT_TERM = r"[^\p{L}\p{N}]+"


def all_terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.split(F.lower(text), NOT_TERM))


def bands(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> tuple[list[str], list[str]]:
    """(terms of the band, terms above it), sorted. Every document counts. A document has a bounded mean
    of m distinct terms, so there are at most m / least terms in both, however many documents there are."""
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    n = docs.count()
    counted = body.select(F.explode(all_terms(F.col("_t"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = counted.filter((F.col("df") >= max(2.0, least * n)) & (F.col("term") != "")).select("term", (F.col("df") <= most * n).alias("within"))
    found = kept.collect()
    return sorted(r.term for r in found if r.within), sorted(r.term for r in found if not r.within)


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[str]:
    """Terms of the band, sorted."""
    return bands(docs, text, least, most)[0]


def _quoted(terms: list[str]) -> str:
    return ",".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms) or "''"


def with_fingerprint(df: DataFrame, text: str, out: str, terms: list[str], above: list[str] = ()) -> DataFrame:
    """Add the fingerprint of a text column as an array of int, null for a subset without a term; a null
    or blank text has only nulls.

    The terms are those of the lexicon, up to ``EXTRA`` below the band (the first by a hash, so that
    near copies take the same) and, only where both are fewer than ``EXTRA``, so many from ``above``.
    """
    df = df.withColumn("_all", F.filter(all_terms(F.coalesce(F.col(text), F.lit(""))), lambda t: t != ""))
    df = df.withColumn("_in", F.expr(f"filter(_all, _w -> _w IN ({_quoted(terms)}))"))
    df = df.withColumn("_out", F.expr(f"sort_array(transform(array_except(_all, _in), _w -> struct(_w IN ({_quoted(above)}) AS above, "
                                      f"xxhash64(_w, {len(FAMILIES)}) AS h, _w AS t)))"))
    df = df.withColumn("_n", F.expr(f"least({EXTRA}, greatest(size(filter(_out, x -> NOT x.above)), {EXTRA} - size(_in)))"))
    df = df.withColumn("_terms", F.expr("sort_array(concat(_in, slice(_out, 1, _n).t))")).drop("_all", "_in", "_out", "_n")
    for g in range(len(FAMILIES)):
        df = df.withColumn(f"_h{g}", F.expr(f"transform(_terms, t -> xxhash64(t, {g}))"))
    hashed = [F.expr(f"transform(array(filter(_h{g}, h -> (shiftrightunsigned(h, {7 * j}) & 1023) < {share})), "
                     "s -> if(size(s) > 0, hash(s), null))[0]") for g, (share, n) in enumerate(FAMILIES) for j in range(n)]
    return df.withColumn(out, F.array(*hashed)).drop("_terms", *[f"_h{g}" for g in range(len(FAMILIES))])


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term in either fingerprint on which both agree; 1 where neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).when(F.coalesce(x == y, F.lit(False)), 1).otherwise(0))
    known = F.filter(pairs, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0), lambda s, v: s + v)
    return F.when(F.size(known) == 0, F.lit(1.0)).otherwise(total / F.size(known)).cast("double")


def shown(fingerprint: Column) -> Column:
    """A fingerprint as one string: eight hex digits a subset, dashes for one without a term."""
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"),
                                                                    F.lit("--------"))), "")


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: the values of the row that follows by (key, columns), for the last row
    those of the first. Null keys come first; rows with the same key follow their values.

    Rows are cut into ranges of the key (bounds from a quantile sketch of the keys alone) and every
    range gets a copy of the next range's first row, so each range is worked on by itself.
    """
    spark = df.sparkSession
    ranges = 4 * partitions(spark)
    bounds = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    cut = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    df = df.withColumn("_range", F.coalesce(F.size(F.filter(cut, lambda b: b <= F.col(key).cast("double"))), F.lit(0)))
    firsts = {r["_range"]: r["k"] for r in df.groupBy("_range").agg(
        F.min(F.struct(F.col(key).isNotNull().alias("full"), F.col(key).alias("k")))["k"].alias("k")).collect()}  # a row a range
    at = sorted(firsts)
    if not at:
        return df.drop("_range").select("*", *[F.lit(None).cast(dict(df.dtypes)[c]).alias(f"next_{c}") for c in columns])
    before = {r: at[i - 1] for i, r in enumerate(at)}  # the first range's first row closes the last range
    heads = [k for k in firsts.values() if k is not None]
    is_head = F.col(key).isin(heads) if heads else F.lit(False)
    if None in firsts.values():
        is_head = is_head | F.col(key).isNull()
    head = df.filter(is_head).groupBy("_range").agg(F.min(F.struct(*columns)).alias("_s"))
    move = F.element_at(F.create_map(*[F.lit(x) for r, b in before.items() for x in (r, b)]), F.col("_range"))
    guards = head.select(move.alias("_range"), *[F.col(f"_s.{c}").alias(c) for c in columns], F.lit(True).alias("_guard"))
    both = df.withColumn("_guard", F.lit(False)).unionByName(guards, allowMissingColumns=True)
    order = W.partitionBy("_range").orderBy("_guard", F.col(key).asc_nulls_first(), *columns)
    both = both.select("*", F.lead(F.struct(*columns)).over(order).alias("_next"))
    both = both.filter(~F.col("_guard"))
    return both.select(*[c for c in df.columns if c != "_range"], *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, terms: list[str], text: str = "text", key: str = "doc_id", above: list[str] = ()) -> DataFrame:
    """(key, text, fingerprint) of every document; a null text counts as an empty one."""
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_fingerprint(body, "text", "fingerprint", terms, above)
