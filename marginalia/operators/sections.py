"""Sections inside documents: parsing them, and batch updates of them.

Parsing and editing are expressions on one document's text. Updates meet documents in one inner
join on the document key and return only the changed documents, so Spark can prune the corpus with
a runtime filter before any text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import WS, WS_CHARS, col, each_present, first_nonempty, let, lines_of, quoted, rstrip, strip
from ..functions.lines import IMAGE_TOKEN
from ..functions.text import squeeze

# Headings and labels of the sections that are read and written.
BATTLE = "⚔️ Battle 记录"
REVIEW = "🧭 行业总文档评审"
ARCHIVE = "新项目评审留档"
PLACEHOLDER = "（待填）"
UNRESOLVED = ["未验证", "部分验证"]
VARIABLE_HEADERS = ["变量", "关键变量", "核心变量", "名称"]
SNAPSHOT_CHARS, SNAPSHOT_VARIABLES = 400, 5
SEPARATOR_ROW = rf"\A{WS}*\|[\-|{WS_CHARS}]+\|{WS}*\z"


def section_pattern(heading: str) -> str:
    """From a ``## `` heading to the next one or the end."""
    return rf"(?dms)^## {quoted(heading)}\n.*?(?=^## |\z)"


def section_text(content: str | Column, heading: str) -> Column:
    """Text of the first such section with its heading; empty without one."""
    return F.regexp_extract(col(content), section_pattern(heading), 0)


def edit_first(content: Column, pattern: str, edit: Callable[[Column, Column, Column], Column],
               otherwise: Column) -> Column:
    """Rewrite around the first match: ``edit(before, match, after)``, or ``otherwise``."""
    def body(c: Column) -> Column:
        return let(F.struct(F.regexp_instr(c, F.lit(pattern)).alias("at"),
                            F.regexp_extract(c, pattern, 0).alias("m")), lambda x: F.when(
            x["at"] > 0, edit(F.left(c, x["at"] - 1), x["m"], F.substr(c, x["at"] + F.length(x["m"])))))
    return F.coalesce(let(content, body), otherwise)


def _appended(content: Column, section: Column) -> Column:
    return F.concat(rstrip(content), F.lit("\n\n---\n\n"), section, F.lit("\n"))


def upsert(content: Column, heading: str, section: Column) -> Column:
    """Replace the section, or append it after a rule."""
    return edit_first(content, section_pattern(heading), lambda a, m, z: F.concat(
        a, rstrip(section), F.lit("\n\n"), F.ltrim(z, F.lit("\n"))), _appended(content, section))


def prepend_log(content: Column, heading: str, state: Column, entry: Column) -> Column:
    """Replace the section by new state and new log entry, keeping the older ``####`` entries."""
    def replace(a: Column, m: Column, z: Column) -> Column:
        old = F.transform(F.regexp_extract_all(m, F.lit(r"(?dms)^#### .+?(?=^#### |\z)"), F.lit(0)), strip)
        section = F.concat(state, entry, F.lit("\n\n"), F.array_join(old, "\n\n"))
        return F.concat(a, rstrip(section), F.lit("\n\n"), F.ltrim(z, F.lit("\n")))
    return edit_first(content, section_pattern(heading), replace, _appended(content, F.concat(state, entry)))


def _subsection(name: str) -> str:
    return rf"(?dmsU)^### \d+\.\d+{WS}+{name}[^\n]*$.*?(?=^#{{2,3}} |\z)"


def append_row(content: Column, name: str, row: Column) -> Column:
    """Append a table row in a numbered sub-section; a lone placeholder row is replaced. Null when
    there is no such table."""
    def edit(ls: Column) -> Column:
        table = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: strip(F.get(ls, i)).startswith("|"))
        def place(t: Column) -> Column:
            data = F.filter(t, lambda i: ~F.get(ls, i).rlike(SEPARATOR_ROW))
            lone = F.when((F.size(data) == 2) & F.contains(F.get(ls, F.get(data, F.lit(1))), F.lit(PLACEHOLDER)),
                          F.get(data, F.lit(1)))
            last = F.element_at(t, -1) + 1
            return F.when(F.size(t) == 0, F.lit(None)).when(
                lone.isNotNull(), F.transform(ls, lambda x, i: F.when(i == lone, row).otherwise(x))).otherwise(
                F.concat(F.slice(ls, F.lit(1), last), F.array(row), F.slice(ls, last + 1, F.size(ls))))
        return let(table, place)

    def rewrite(a: Column, m: Column, z: Column) -> Column:
        return F.concat(a, F.array_join(let(lines_of(m), edit), "\n"), z)
    return edit_first(content, _subsection(name), rewrite, F.lit(None).cast("string"))


def prepend_archive(content: Column, entry: Column) -> Column:
    """Put a dated entry on top of the archive; a text without entries is a placeholder and goes."""
    def edit(a: Column, m: Column, z: Column) -> Column:
        head = F.substring_index(m, "\n", 1)
        rest = F.substr(m, F.length(head) + 1)
        return F.when(F.contains(strip(rest), F.lit("####")),
                      F.concat(a, head, F.lit("\n\n"), entry, F.lit("\n"), rest, z)).otherwise(
            F.concat(a, head, F.lit("\n\n"), entry, F.lit("\n\n"), z))
    missing = F.concat(rstrip(content), F.lit(f"\n\n### {ARCHIVE}\n\n"), entry, F.lit("\n"))
    return edit_first(content, _subsection(ARCHIVE), edit, missing)


def set_header_date(content: Column, day: str) -> Column:
    """Set the first update-date line; null when there is none."""
    return edit_first(content, rf"(?dm)^>{WS}*\*{{0,2}}更新日期\*{{0,2}}：[^\n]*",
                      lambda a, m, z: F.concat(a, F.lit(f"> **更新日期**：{day}"), z), F.lit(None).cast("string"))


def update_docs(docs: DataFrame, updates: DataFrame, key: str, edit: Callable[[Column], Column]) -> DataFrame:
    """Documents that have an update, with their new content; ``edit`` may use update columns and
    returns null for a document it cannot change."""
    rows = docs.join(updates, key)
    return rows.select(*[c for c in rows.columns if c != "content"],
                       each_present(edit(F.col("content"))).alias("content"))


def industry_update(content: Column, day: str, position: Column, variable_rows: list[Column],
                    entry: Column) -> dict[str, Column]:
    """Header date, position row, variable rows and archive entry in one go, with what was found."""
    dated = set_header_date(content, day)
    text = F.coalesce(dated, content)
    placed = append_row(text, "行业坐标", position)
    text = F.coalesce(placed, text)
    all_found = F.lit(True)
    for row in variable_rows:
        grown = append_row(text, "关键变量演进", row)
        all_found, text = all_found & grown.isNotNull(), F.coalesce(grown, text)
    has_archive = text.rlike(_subsection(ARCHIVE))
    return {"content": prepend_archive(text, entry), "ok_date": dated.isNotNull(),
            "ok_position": placed.isNotNull(), "ok_variables": all_found, "ok_archive": has_archive}


def update_industries(docs: DataFrame, updates: DataFrame, key: str, day: str, position: Column,
                      variable_rows: list[Column], entry: Column) -> DataFrame:
    """The updated industry documents with a report of what was found in each; the columns given may
    be those of ``updates``. A part that is not found leaves the document as it is there."""
    done = industry_update(F.col("content"), day, position, variable_rows, entry)
    return docs.join(updates, key).select(key, *[c.alias(n) for n, c in done.items()])


def change_preview(docs: DataFrame, updates: DataFrame, key: str, heading: str = REVIEW) -> DataFrame:
    """What an update would do: the section is added or replaced, table rows and archive entry are
    added, the header date is set. ``updates`` carries ``n_variables``."""
    rows = docs.join(updates, key).select(key, "n_variables", (section_text("content", heading) != "").alias("has"))
    kind = F.struct
    changes = F.array(
        kind(F.lit(0).alias("ord"), F.when(F.col("has"), "mod").otherwise("add").alias("action"),
             F.lit("section").alias("target"), F.lit(1).alias("n")),
        kind(F.lit(1).alias("ord"), F.lit("add").alias("action"), F.lit("position").alias("target"), F.lit(1).alias("n")),
        kind(F.lit(2).alias("ord"), F.lit("add").alias("action"), F.lit("variables").alias("target"),
             F.col("n_variables").cast("int").alias("n")),
        kind(F.lit(3).alias("ord"), F.lit("add").alias("action"), F.lit("archive").alias("target"), F.lit(1).alias("n")),
        kind(F.lit(4).alias("ord"), F.lit("mod").alias("action"), F.lit("date").alias("target"), F.lit(1).alias("n")))
    return rows.select(key, F.inline(F.filter(changes, lambda c: c["n"] > 0)))


# ---- reading sections -------------------------------------------------------------------------

def table_rows(text: Column, header: str) -> Column:
    """Rows of the Markdown table whose first column is ``header``, as array of cell arrays."""
    body = F.regexp_extract(text, rf"\| *{quoted(header)} *\|[^\n]*\n\|[\-|{WS_CHARS}]+\|\n((?:\|[^\n]*\|\n?)++)", 1)
    cells = F.transform(lines_of(strip(body)), lambda s: F.transform(
        F.split(F.btrim(strip(s), F.lit("|")), r"\|"),
        lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|"))))
    return F.filter(cells, lambda row: F.exists(row, lambda c: (c != "") & (c != "—")))


def state_panel(content: str | Column) -> Column:
    """Current state of a debate section: status, confidence, belief, counter-world, tables."""
    def panel(sec: Column) -> Column:
        status = r"\*\*观点状态：(\w+)\*\*（([^）]*)）\s*·\s*置信度\s*(\d+)%\s*→\s*(\d+)%"
        def part(p, i):
            return strip(F.regexp_extract(sec, "(?dU)" + p, i))
        world = r"\*\*反向世界\*\*：(.+?)（当前现实更接近：(.+?)）"
        return F.when(sec != "", F.struct(
            part(status, 1).alias("status"), part(status, 2).alias("status_desc"),
            F.nullif(part(status, 3), F.lit("")).cast("int").alias("conf_from"),
            F.nullif(part(status, 4), F.lit("")).cast("int").alias("conf_to"),
            part(r"\*\*Core Belief\*\*：(.+)", 1).alias("core_belief"),
            part(world, 1).alias("counter_world"), part(world, 2).alias("closer_world"),
            table_rows(sec, "关键假设").alias("assumptions"),
            table_rows(sec, "证伪条件").alias("falsifications")))
    return let(section_text(content, BATTLE), panel)


def state_panels(docs: DataFrame, key: str) -> DataFrame:
    """State panel of every document that has one."""
    return docs.select(key, each_present(state_panel("content")).alias("panel"))


def unresolved(assumptions: DataFrame, group: str, verification: str) -> DataFrame:
    return assumptions.groupBy(group).agg(
        F.count_if(F.col(verification).isin(*UNRESOLVED)).alias("unresolved"))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 70, "高").when(confidence >= 40, "中").otherwise("低")


def section_body(content: str | Column, keyword: str) -> Column:
    """Body of the first level 2 to 4 section whose heading contains the keyword."""
    return F.regexp_extract(
        col(content), rf"(?dms)^#{{2,4}}[^\n]*(?:{keyword})[^\n]*\n(.*?)(?=^#{{2,4}} |\z)", 1)


def section_brief(content: str | Column, keyword: str, limit: int = SNAPSHOT_CHARS) -> Column:
    return F.left(squeeze(section_body(content, keyword)), F.lit(limit))


def industry_snapshot(content: str | Column) -> dict[str, Column]:
    """Stage, position and up to five variables of an industry document."""
    rows = F.filter(F.transform(lines_of(section_body(content, "核心变量|关键变量")), strip),
                    lambda s: s.startswith("|") & ~s.rlike(SEPARATOR_ROW))
    names = F.filter(F.transform(rows, lambda s: F.replace(strip(
        F.substring_index(F.btrim(s, F.lit("|")), "|", 1)), F.lit("**"), F.lit(""))),
        lambda n: (n != "") & ~n.isin(*VARIABLE_HEADERS))
    return {
        "stage": first_nonempty(section_brief(content, "行业阶段"), section_brief(content, "阶段判断")),
        "position": section_brief(content, "行业坐标"),
        "variables": let(names, lambda n: F.when(
            F.size(n) > 1, F.slice(n, 2, SNAPSHOT_VARIABLES)).otherwise(n))}


# ---- images -----------------------------------------------------------------------------------

def used_images(content: str | Column, images: str | Column) -> Column:
    """Available images the text refers to, in order of first reference."""
    return F.array_intersect(F.regexp_extract_all(col(content), F.lit(IMAGE_TOKEN), F.lit(1)), col(images))


def unused_images(content: str | Column, images: str | Column) -> Column:
    return F.array_except(col(images), F.regexp_extract_all(col(content), F.lit(IMAGE_TOKEN), F.lit(1)))


def inline_images(content: Column, images: Column, folder: Column) -> Column:
    """Replace tokens of available images by references; other tokens stay."""
    def swap(text: Column, name: Column) -> Column:
        page = F.regexp_extract(name, r"\Ap(\d+)_", 1)
        caption = F.when(page != "", F.concat(F.lit("p."), page)).otherwise("")
        link = F.concat(F.lit("!["), caption, F.lit(" 图表]("), folder, F.lit("/"), name, F.lit(")"))
        shown = F.regexp_replace(link, r"([\\$])", r"\\$1")
        token = F.concat(F.lit(rf"\[\[图{WS}*[:：]{WS}*\Q"), name, F.lit(rf"\E{WS}*\]\]"))
        return F.regexp_replace(text, token, shown)
    return F.aggregate(used_images(content, images), content, swap)


def headings(content: str | Column) -> Column:
    """Heading lines of a framework document, the whitelist of merged documents."""
    return F.filter(F.transform(lines_of(content), strip), lambda s: s.rlike(rf"\A#{{1,6}}{WS}"))

