"""How far the sources of a language differ in their words: a pointer sort, then sums of differences.

Word-start pointers into the Arrow buffers of a batch are sorted by the words they point to, by a
multikey quicksort whose characters are eight bytes wide: slices of pointers that agree so far are
sorted by their next character together, all slices of one depth at the same time, and only those
that still agree go a character deeper. A run of equal words gives the number of its occurrences and
of its documents. Spark adds these up per language, source and term.

Distances between two sources need every kept term, also those that one or both lack. A term that a
source lacks has a share that depends on the source alone, so only terms that both hold are taken
pair by pair; the others come from running sums over a source's shares. See ``_pairs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, staged
from .words import ragged

LEAST_DOCS, TOP, SMOOTHING, SCALE = 30, 50, 5, 1_000_000_000
CELLS = 1 << 21  # pairs of sources that are worked on at once
DEPTHS = 8  # words that agree in so many eight-byte characters are compared whole

_FOLD = np.arange(256, dtype=np.uint8)  # A-Z become a-z, bytes that belong to no word 0
_FOLD[0x41:0x5B] += 0x20
_FOLD[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


def word_pointers(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes (eight zeros behind them) and the start, length and text of every word."""
    folded = np.zeros(len(raw) + 8, dtype=np.uint8)
    folded[:-8] = _FOLD[raw]
    inside = folded[:len(raw)] != 0
    first = np.ones(len(raw), dtype=bool)
    first[1:] = ~inside[:-1]
    border = starts[(starts > 0) & (starts < len(raw))]
    first[border] = True
    begin = np.flatnonzero(inside & first)
    last = np.ones(len(raw), dtype=bool)
    last[:-1] = ~inside[1:]
    last[border - 1] = True
    length = np.flatnonzero(inside & last) + 1 - begin
    return folded, begin, length, np.searchsorted(starts, begin, side="right") - 1


def pointer_sort(folded: np.ndarray, begin: np.ndarray, length: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of (slice, word, place), and which of them start a run of equal words of
    a slice."""
    wide = np.ndarray((len(folded) - 7,), dtype=">u8", buffer=folded, strides=(1,))
    order = np.arange(len(begin))
    new = np.zeros(len(begin), dtype=bool)
    new[:1] = True
    active, group = np.arange(len(begin)), slices
    for depth in range(DEPTHS):
        if not len(active):
            return order, new
        pointer = order[active]
        left = np.clip(length[pointer] - 8 * depth, 0, 8)
        char = wide[np.where(left > 0, begin[pointer] + 8 * depth, 0)].astype(np.uint64)
        off = ((8 - left) * 8).astype(np.uint64)
        char = np.where(left > 0, (char >> off % np.uint64(64)) << off % np.uint64(64), np.uint64(0))
        by = np.lexsort((char, group))
        order[active], char, group = pointer[by], char[by], group[by]
        differs = np.ones(len(active), dtype=bool)
        differs[1:] = (char[1:] != char[:-1]) | (group[1:] != group[:-1])
        new[active] |= differs
        run = np.cumsum(differs) - 1
        deeper = (np.bincount(run)[run] > 1) & ((char & np.uint64(0xFF)) != 0)
        active, group = active[deeper], run[deeper]
    for run in np.split(active, np.flatnonzero(np.diff(group)) + 1) if len(active) else ():
        words = {p: folded[begin[p]:begin[p] + length[p]].tobytes() for p in order[run].tolist()}
        order[run] = ranked = sorted(words, key=words.get)
        new[run[1:]] |= [words[a] != words[b] for a, b in zip(ranked, ranked[1:])]
    return order, new


def equal_runs(raw: np.ndarray, starts: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(slice, term, documents, occurrences) of the texts of a batch; ``slices`` has one number a text."""
    folded, begin, length, text = word_pointers(raw, starts)
    order, new = pointer_sort(folded, begin, length, slices[text])
    first = np.flatnonzero(new)
    if not len(first):
        return first, pa.array([], pa.string()), first, first
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = text[order[1:]] != text[order[:-1]]
    docs = np.add.reduceat((fresh | new).astype(np.int64), first)
    count = np.diff(first, append=len(order))
    head = order[first]
    bounds = np.empty(2 * len(head), dtype=np.int64)
    bounds[0::2], bounds[1::2] = begin[head], begin[head] + length[head]
    data, sizes = ragged(bounds, folded, np.arange(0, len(bounds), 2))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(head), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return slices[text[head]], terms, docs, count


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, docs, n): documents (rows) and occurrences of every term; null text, lang
    and source count as ''. The term '' stands for the group itself: its documents, no occurrence."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{n}") for n, c in
                         (("text", text), ("lang", lang), ("source", source))])

    def run(batches):
        for batch, raw, starts in byte_slices(batches):
            langs, sources = (batch.column(c).dictionary_encode() for c in ("_lang", "_source"))
            slices = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            of, terms, df, n = equal_runs(raw, starts, slices)
            groups, members = np.unique(slices, return_counts=True)
            of = np.concatenate([of, groups])
            columns = [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                       pa.concat_arrays([terms.cast(langs.dictionary.type), pa.array([""] * len(groups), langs.dictionary.type)]),
                       pa.array(np.concatenate([df, members])), pa.array(np.concatenate([n, np.zeros(len(groups), dtype=np.int64)]))]
            for at in range(0, len(of), 65536):
                yield pa.RecordBatch.from_arrays([c.slice(at, 65536) for c in columns], names=["lang", "source", "term", "docs", "n"])

    found = rows.mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: str, total: str, kinds: str, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * kinds)), exact; null without kinds."""
    wide = f"(CAST({count} AS DECIMAL(20,0)) + {smoothing}) * CAST({scale} AS DECIMAL(12,0))"
    return F.expr(f"1 + {wide} div nullif(CAST({total} AS DECIMAL(20,0)) + CAST({kinds} AS DECIMAL(18,0)) * {smoothing}, 0)")


def _common(batches):
    """Partial sums over terms held by both sources of a pair, in blocks of at most ``CELLS`` pairs."""
    for batch in batches:
        lists, names = batch.column("held"), batch.column("lang").dictionary_encode()
        lengths = lists.value_lengths().to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        flat = lists.flatten()
        member, p, p0 = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
        code = names.indices.to_numpy()
        for c, size in set(zip(code.tolist(), lengths.tolist())):
            if size < 2:
                continue
            rows = np.flatnonzero((code == c) & (lengths == size))
            high = max(1, min(size, CELLS // size))  # sources of a block on the first side
            step = max(1, CELLS // (size * high))
            for r in range(0, len(rows), step):
                cell = at[rows[r:r + step]][:, None] + np.arange(size)
                m, a, b = member[cell], p[cell], p0[cell]
                for i in range(0, size, high):
                    one = (slice(None), slice(i, i + high), None)
                    two = (slice(None), None, slice(None))
                    value = -2 * (np.minimum(a[one], a[two]) - np.minimum(a[one], b[two])
                                  - np.minimum(b[one], a[two]) + np.minimum(b[one], b[two]))
                    key = (m[one] << 32) | m[two]
                    later = m[one] < m[two]
                    pairs, inverse = np.unique(key[later], return_inverse=True)
                    total = np.zeros(len(pairs), dtype=np.int64)
                    np.add.at(total, inverse, value[later])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names.dictionary[c].as_py()] * len(pairs), pa.string()), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(total)],
                        names=["lang", "one", "two", "value"])


def _pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, other, p's sum of differences) for every two sources of a language.

    With p a source's share of a term and p0 its share of a term it lacks, the sum over all V kept terms
    of |p - p'| is V |p0 - p0'|, plus for each of the two the sum over the terms it holds of
    |p - p0'| - |p0 - p0'|, plus over the terms both hold what these count wrongly. The second comes from
    running sums over the source's distinct shares (no more than its distinct counts), the third from
    the lists of sources of each term.
    """
    held = rows.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("member", "p", "p0"))).alias("held"))
    both = held.filter(F.size("held") > 1).select("lang", "held").mapInArrow(_common, "lang string, one long, two long, value long")

    ends = groups.select("lang", "member", "p0", "kinds")
    probe = ends.join(ends.select("lang", F.col("member").alias("other"), F.col("p0").alias("x")), "lang").filter("member <> other")
    base = probe.select("lang", F.col("member").alias("one"), F.col("other").alias("two"),
                        F.coalesce(F.col("kinds") * F.abs(F.col("p0") - F.col("x")), F.lit(0)).alias("value"))
    steps = rows.groupBy("lang", "member", "p0", F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    points = steps.withColumn("other", F.lit(None).cast("int")).unionByName(
        probe.filter("kinds > 0").select("lang", "member", "p0", "x", F.lit(0).cast("long").alias("n"), "other"))
    whole = Window.partitionBy("lang", "member")
    so_far = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("x")
    summed = points.select("*", F.sum("n").over(so_far).alias("n_low"), F.sum(mass).over(so_far).alias("m_low"),
                           F.sum("n").over(whole).alias("n_all"), F.sum(mass).over(whole).alias("m_all"))
    apart = (F.col("x") * F.col("n_low") - F.col("m_low") + F.col("m_all") - F.col("m_low") - F.col("x") * (F.col("n_all") - F.col("n_low"))
             - F.col("n_all") * F.abs(F.col("p0") - F.col("x")))
    single = summed.filter("other IS NOT NULL").select("lang", F.col("member").alias("one"), F.col("other").alias("two"), apart.alias("value"))
    lists = single.union(both)
    flipped = lists.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), "value")
    return base.union(lists).union(flipped).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from the other sources of its
    language (part ``pair``), and which terms it uses more than the language (part ``term``, the first
    ``top``).

    A language keeps the terms found in at least ``least_docs`` of its documents. Null text, lang and
    source count as ''. Repeated rows are documents of their own, a text without a word makes its
    group known, an empty table gives no row. Equal values are ordered by item in UTF-8. Other
    columns play no part. Counts are staged once; everything else is read from them.
    """
    counts = term_counts(docs, text, lang, source)
    by_term = staged(counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
        .filter((F.col("docs") >= least_docs) | (F.col("term") == "")), "divergence-terms")
    kept = by_term.filter("term <> ''")
    long = kept.select("lang", "term", "total", F.inline("sources"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("lang_n"))
    known = by_term.filter("term = ''").select("lang", F.inline("sources")).drop("n")
    groups = known.join(langs, "lang", "left").join(
        long.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").na.fill(0, ["kinds", "lang_n", "own_n"])
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("member")
    groups = staged(groups.select("*", numbered, F.when(F.col("kinds") > 0, share("0", "own_n", "kinds")).alias("p0")), "divergence-groups")
    rows = long.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "member", "p0", share("n", "own_n", "kinds").alias("p"), share("total", "lang_n", "kinds").alias("q"))

    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)

    names = groups.select("lang", "member", "source")
    pairs = _pairs(groups, rows).join(names.select("lang", F.col("member").alias("one"), "source"), ["lang", "one"]).join(
        names.select("lang", F.col("member").alias("two"), F.col("source").alias("item")), ["lang", "two"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best_first))
    return pairs.unionByName(terms)
