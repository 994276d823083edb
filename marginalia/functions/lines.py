"""Document-local operators on lines and sections.

A document is one row, so everything that only looks inside one document is a narrow expression
over ``split(content, '\\n')``: no line is exploded, no text is shuffled, and a source with a third
of all documents costs no more than its share. All folds are linear or n log n in the lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .expr import (WS, WS_INLINE, col, first_of_runs, is_blank, let, lines_of, rstrip, run_starts,
                   strip, strip_newlines)
from .text import norm_heading, unnumbered

# A noncharacter that no valid text interchange contains; marks cut positions inside a text.
MARK = "\uffff"
# Cut before every "## " heading line.
H2_CUT = rf"\n(?=##{WS_INLINE})"
# Cut before every fence line; pieces then alternate between outside and inside of a fence.
FENCE_CUT = rf"(?dm)(?=^{WS_INLINE}*```)"

REPEATS = 4
REPEAT_MIN, REPEAT_MAX = 8, 80
# Headings that open the legal tail of a report.
LEGAL = "免责声明|法律声明|分析师声明|版权声明|公司声明"
LEGAL_LINE = rf"(?dm)^(?:#{{1,6}}{WS}*)?[^\n]{{0,20}}(?:{LEGAL})[^\n]{{0,20}}$"
DIGEST_HEADING = "背景速览"
DIGEST_CAP = 3
# Vertical and crossing box-drawing characters.
BOX = "│┼├┤┬┴┃╋╂╞╡╪"
_BOX_LINE = rf"(?!{WS_INLINE}*```)[^\n{BOX}]*+[{BOX}][^\n{BOX}]*+[{BOX}][^\n]*+"
BOX_RUN = rf"(?dm)^{_BOX_LINE}(?:\n{_BOX_LINE}){{2,}}+$"
BOX_OPEN, BOX_CLOSE = "```text\n", "\n```"
IMAGE_TOKEN = rf"\[\[图{WS}*[:：]{WS}*([^\]]+?){WS}*\]\]"
DETAILS = rf"(?s)\n?<details>.*?</details>{WS}*"


def head_line(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def after_head(piece: Column) -> Column:
    return F.when(F.contains(piece, F.lit("\n")),
                  F.substr(piece, F.length(head_line(piece)) + 2)).otherwise("")


def is_h2(line: Column) -> Column:
    return line.rlike(rf"\A##{WS_INLINE}")


def h2_pieces(content: str | Column) -> Column:
    """The text cut before each ``## `` line, as array of (idx, head, body, is_section)."""
    return F.transform(
        F.split(col(content), H2_CUT),
        lambda p, i: F.struct(i.alias("idx"), head_line(p).alias("head"), after_head(p).alias("body"),
                              is_h2(p).alias("is_section"), p.alias("text")))


# ---- repeated lines and legal tail ------------------------------------------------------------

def _sorted_lines(content: Column) -> Column:
    """Lines as (stripped text, position, line), sorted so that equal texts are neighbours."""
    return F.sort_array(F.transform(
        lines_of(content), lambda s, i: F.struct(strip(s).alias("s"), i.alias("i"), s.alias("line"))))


def _line_runs(rows: Column) -> Column:
    """Runs of equal stripped lines as (from, n) over the sorted rows."""
    return let(run_starts(rows, lambda r: r["s"]), lambda starts: F.transform(
        starts, lambda p, k: F.struct(
            p.alias("at"), (F.coalesce(F.get(starts, k + 1), F.size(rows)) - p).alias("n"))))


def _repeats(line: Column, n: Column) -> Column:
    return (n >= REPEATS) & F.length(line).between(REPEAT_MIN, REPEAT_MAX)


def repeated_lines(content: str | Column) -> Column:
    """Lines of 8 to 80 characters that occur at least four times, as array of (line, n)."""
    return let(_sorted_lines(col(content)), lambda rows: F.transform(
        F.filter(_line_runs(rows), lambda r: _repeats(F.get(rows, r["at"])["s"], r["n"])),
        lambda r: F.struct(F.get(rows, r["at"])["s"].alias("line"), r["n"].cast("long").alias("n"))))


def drop_repeats(content: str | Column) -> Column:
    """Keep only the first occurrence of every repeated line."""
    def keep(rows: Column) -> Column:
        groups = F.transform(_line_runs(rows), lambda r: F.slice(
            rows, r["at"] + 1, F.when(_repeats(F.get(rows, r["at"])["s"], r["n"]), 1).otherwise(r["n"])))
        kept = F.sort_array(F.transform(
            F.flatten(groups), lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
        return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return let(_sorted_lines(col(content)), keep)


def cut_legal_tail(text: Column) -> Column:
    """Cut at the first legal heading that starts in the last quarter of ``text``."""
    def cut(t: Column) -> Column:
        offset = F.floor(F.length(t) * 0.75).cast("int")
        at_line_start = (offset == 0) | (F.substr(t, offset, F.lit(1)) == "\n")
        skip = F.when(at_line_start, offset).otherwise(
            F.coalesce(F.nullif(F.position(F.lit("\n"), t, offset + 1), F.lit(0)), F.length(t)))
        hit = F.regexp_instr(F.substr(t, skip + 1), F.lit(LEGAL_LINE))
        return F.when(hit > 0, F.concat(rstrip(F.left(t, skip + hit - 1)), F.lit("\n"))).otherwise(t)
    return let(text, cut)


def trim_boilerplate(content: str | Column) -> Column:
    return cut_legal_tail(drop_repeats(content))


# ---- section merge ----------------------------------------------------------------------------

def merged_sections(content: str | Column, whitelist: list[str] | Column | None = None) -> Column:
    """Sections with equal headings reduced to the longest, in order of first occurrence.

    With a whitelist (a list, or an array such as the headings of a framework document) the sections follow its order and others are dropped, unless nothing matches.
    Returns array of (ord, head, body, key).
    """
    def longest(secs: Column) -> Column:
        best = first_of_runs(F.sort_array(F.transform(secs, lambda s: F.struct(
            norm_heading(s["head"]).alias("key"), (-F.length(s["body"])).alias("neg"),
            s["idx"].alias("idx"), s["head"].alias("head"), s["body"].alias("body")))),
            lambda s: s["key"])
        first = first_of_runs(F.sort_array(F.transform(secs, lambda s: F.struct(
            norm_heading(s["head"]).alias("key"), s["idx"].alias("idx")))), lambda s: s["key"])
        return F.sort_array(let(first, lambda f: F.transform(best, lambda b, k: F.struct(
            F.get(f, k)["idx"].alias("ord"), b["head"].alias("head"), b["body"].alias("body"),
            b["key"].alias("key")))))

    secs = F.filter(h2_pieces(content), lambda p: p["is_section"])
    merged = let(secs, longest)
    if whitelist is None or isinstance(whitelist, list) and not whitelist:
        return merged
    return let(merged, lambda m: align(m, whitelist))


def align(secs: Column, whitelist: list[str] | Column) -> Column:
    """Match sections to whitelist headings: the exact one first, else the first substring either way."""
    names = F.array(*[F.lit(h) for h in whitelist]) if isinstance(whitelist, list) else whitelist
    return let(F.transform(names, lambda h, i: F.struct(i.alias("pos"), unnumbered(norm_heading(h)).alias("w"))),
               lambda allowed: _aligned(secs, allowed))


def _aligned(secs: Column, allowed: Column) -> Column:

    def position(key: Column) -> Column:
        def pick(k: Column) -> Column:
            exact = F.filter(allowed, lambda a: (a["w"] == k) & (k != ""))
            part = F.filter(allowed, lambda a: (k != "") & (a["w"] != "")
                            & (F.contains(k, a["w"]) | F.contains(a["w"], k)))
            return F.coalesce(F.get(exact, F.lit(0))["pos"], F.get(part, F.lit(0))["pos"])
        return let(unnumbered(key), pick)

    ranked = F.transform(secs, lambda s: F.struct(position(s["key"]).alias("pos"), s.alias("sec")))
    return let(ranked, lambda r: let(
        F.filter(r, lambda x: x["pos"].isNotNull()),
        lambda hit: F.when(F.size(hit) > 0, F.transform(F.sort_array(F.transform(hit, lambda x: F.struct(
            x["pos"].alias("pos"), x["sec"]["ord"].alias("ord"), x["sec"].alias("sec")))),
            lambda x: x["sec"])).otherwise(F.transform(r, lambda x: x["sec"]))))


def dedupe_sections(content: str | Column, whitelist: list[str] | Column | None = None) -> Column:
    """Whole text with merged sections; a text without sections stays as it is."""
    def render(text: Column, secs: Column) -> Column:
        first = F.get(F.split(text, H2_CUT), F.lit(0))
        preamble = F.when(is_h2(text), F.lit("")).otherwise(strip_newlines(first))
        parts = F.concat(F.array(preamble), F.transform(
            secs, lambda s: F.concat(s["head"], F.lit("\n"), strip_newlines(s["body"]))))
        return F.when(F.size(secs) == 0, text).otherwise(
            F.array_join(F.filter(parts, lambda p: ~is_blank(p)), "\n\n"))
    return let(col(content), lambda t: let(merged_sections(t, whitelist), lambda s: render(t, s)))


def cap_digest(content: str | Column, cap: int = DIGEST_CAP) -> Column:
    """In a digest section keep the first ``cap`` non-blank lines; everything else is untouched."""
    def shorten(ls: Column) -> Column:
        at = F.get(F.filter(F.transform(ls, lambda s, i: F.when(
            strip(s).rlike(rf"\A##{WS}*{DIGEST_HEADING}\z"), i + 1)), lambda i: i.isNotNull()), F.lit(0))
        return let(F.coalesce(at, F.lit(0)), lambda p: F.when(p == 0, ls).otherwise(F.concat(
            F.slice(ls, F.lit(1), p),
            F.slice(F.filter(F.slice(ls, p + 1, F.size(ls)), lambda s: ~is_blank(s)), 1, cap))))
    return F.array_join(F.transform(
        F.split(col(content), H2_CUT), lambda piece: F.array_join(let(lines_of(piece), shorten), "\n")), "\n")


# ---- fences, table of contents, box tables ----------------------------------------------------

def fence_pieces(content: str | Column) -> Column:
    """The text cut before every fence line, as array of (text, fenced)."""
    def pieces(c: Column) -> Column:
        opens = F.when(c.rlike(rf"\A{WS_INLINE}*```"), 1).otherwise(0)
        return let(opens, lambda shift: F.transform(F.split(c, FENCE_CUT), lambda p, i: F.struct(
            p.alias("text"), ((i + shift) % 2 == 1).alias("fenced"))))
    return let(col(content), pieces)


def fenced_replace(content: str | Column, pattern: str, replacement: str) -> Column:
    """Regular-expression replacement that leaves fenced code alone."""
    return F.array_join(F.transform(fence_pieces(content), lambda p: F.when(p["fenced"], p["text"])
                                    .otherwise(F.regexp_replace(p["text"], pattern, replacement))), "")


def toc_sections(content: str | Column) -> Column:
    """Sections at ``##``/``###`` outside fences, as array of (idx, level, toc_text, text).

    Text before the first heading is a section with level 0.
    """
    heading = rf"(?d)\A(#{{2,3}}){WS_INLINE}+(.+?){WS_INLINE}*(?:\n|\z)"
    marked = fenced_replace(content, rf"(?dm)^(?=#{{2,3}}{WS_INLINE}+.)", MARK)

    def rows(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        starts_with_heading = F.get(pieces, F.lit(0)) == ""
        texts = F.transform(pieces, lambda p, i: F.when(i < last, F.regexp_replace(p, r"\n\z", "")).otherwise(p))
        return F.filter(F.transform(texts, lambda p, i: F.struct(
            i.alias("idx"),
            F.when(i == 0, 0).otherwise(F.length(F.regexp_extract(p, heading, 1))).alias("level"),
            F.when(i == 0, "").otherwise(
                F.regexp_replace(F.regexp_extract(p, heading, 2), r"[*`]", "")).alias("toc_text"),
            p.alias("text"))), lambda s: (s["idx"] > 0) | (F.size(pieces) == 1) | ~starts_with_heading)
    return let(F.split(marked, MARK), rows)


def wrap_box_tables(content: str | Column) -> Column:
    """Put runs of at least three box-drawing lines outside fences into a text fence."""
    return fenced_replace(content, BOX_RUN, f"{BOX_OPEN}$0{BOX_CLOSE}")


def box_tables(content: str | Column) -> Column:
    """The text with its box tables wrapped, and their number, as (wrapped, tables). The pattern runs
    once: every table makes the text longer by the same marks."""
    marks = len(BOX_OPEN + BOX_CLOSE)
    return let(col(content), lambda c: let(wrap_box_tables(c), lambda w: F.struct(
        w.alias("wrapped"), ((F.length(w) - F.length(c)) / marks).cast("int").alias("tables"))))


def split_details(content: str | Column) -> dict[str, Column]:
    """Main text without ``<details>`` blocks, and the blocks."""
    c = col(content)
    return {"main": F.regexp_replace(c, DETAILS, "\n"),
            "blocks": F.transform(F.regexp_extract_all(c, F.lit(DETAILS), F.lit(0)), strip)}


# ---- chunking ---------------------------------------------------------------------------------

def _reach(lengths: np.ndarray, gap: int, base: int, limit: int) -> Iterator[tuple[int, int]]:
    """Spans over parts that lie ``gap`` characters apart from ``base`` on. A span begins at the first
    part that is not empty and reaches to the last end within ``limit``, found by binary search over
    the prefix sums; a part that is longer is cut every ``limit`` characters."""
    ends = np.cumsum(lengths + gap) - gap + base
    filled = np.flatnonzero(lengths)
    part = 0
    while (nth := np.searchsorted(filled, part)) < len(filled):
        part = filled[nth]
        cuts = np.arange(ends[part] - lengths[part], ends[part], limit)
        yield from zip(cuts[:-1], cuts[1:])
        part = np.searchsorted(ends, cuts[-1] + limit, side="right")
        yield cuts[-1], ends[part - 1]


def _plan(sections: np.ndarray, paragraphs: Sequence[np.ndarray | None], limit: int) -> list[dict[str, int]]:
    """Chunks of a text as (at, size). Sections longer than ``limit`` are planned by their paragraphs and
    part the others into runs."""
    begins = np.cumsum(sections + 1) - 1 - sections
    spans: list[tuple[int, int]] = []
    run = 0
    for big in [*np.flatnonzero(sections > limit), len(sections)]:
        if big > run:
            spans += _reach(sections[run:big], 1, begins[run], limit)
        if big < len(sections):
            spans += _reach(np.asarray(paragraphs[big]), 2, begins[big], limit)
        run = big + 1
    return [{"at": int(a), "size": int(b - a)} for a, b in spans]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])))
def _plans(sections: pd.Series, paragraphs: pd.Series, limit: pd.Series) -> pd.Series:
    """The plans of the texts, from lengths alone: the texts stay in the JVM."""
    return pd.Series([None if n is None else _plan(np.asarray(n), p, int(m)) for n, p, m in zip(sections, paragraphs, limit)], dtype=object)


def chunks(content: str | Column, limit: int = 15000) -> Column:
    """Non-blank chunks of a text in order, linear in its length: heading sections packed greedily
    up to ``limit`` characters, oversized sections cut at blank lines or, as a last resort, by length."""
    sections = F.split(col(content), rf"\n(?=#{{1,6}}{WS_INLINE})")
    inner = F.transform(sections, lambda s: F.when(F.length(s) > limit, F.transform(F.split(s, "\n\n"), F.length)))
    plan = _plans(F.transform(sections, F.length), inner, F.lit(limit))
    return F.filter(F.transform(plan, lambda c: F.substr(col(content), c["at"] + 1, c["size"])), lambda t: ~is_blank(t))
