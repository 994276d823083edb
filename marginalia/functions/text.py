"""Scalar text functions: normalisation, truncation, names, fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import WS, WS_CHARS, col, is_blank, lines_of, lookup, or_else, strip

NAME_LIMIT = 60
# What stands for the rest of a long document, and for an empty one.
TRUNCATED = "\n……（文档过长，已截断）"
EMPTY_DOC = "（文档为空）"

# Enumeration prefixes of section headings, after normalisation.
HEADING_NUMBER = r"^(?:\d+[.、]|[一二三四五六七八九十]+[、.]|模块\d+[:：]|附录[a-z][:：])"
# Phrases with which a user ends a session.
CLOSING = r"(今天|今日).{0,4}(到|先).{0,2}这|到此为止|收工|先聊到这|就到这"


def norm_title(c: str | Column) -> Column:
    """Duplicate key of a title: letters and digits of any script, lower case."""
    return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]+", ""))


def norm_heading(c: str | Column) -> Column:
    """Merge key of a heading; the section number is part of the key."""
    bare = F.regexp_replace(strip(c), rf"\A#{{1,6}}{WS}*", "")
    return F.lower(F.replace(F.replace(bare, F.lit("："), F.lit(":")), F.lit(" "), F.lit("")))


def unnumbered(key: Column) -> Column:
    """A normalised heading without its enumeration prefix (for whitelist matching only)."""
    return F.regexp_replace(key, HEADING_NUMBER, "")


def strip_fence(c: str | Column) -> Column:
    """Remove every code-fence marker."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)```\w*", ""))


def strip_outer_fence(c: str | Column) -> Column:
    """Remove only the fence that wraps the whole text."""
    opened = F.regexp_replace(strip(c), rf"\A```[a-zA-Z]*{WS}*\n", "")
    return strip(F.regexp_replace(opened, rf"\n```{WS}*\z", ""))


def safe_name(c: str | Column, fallback: str | Column = "未命名技术", limit: int = NAME_LIMIT) -> Column:
    """File name without path separators, wildcards or white space, at most ``limit`` characters."""
    name = F.btrim(F.regexp_replace(strip(c), rf'[\\/:*?"<>|{WS_CHARS}]+', "_"), F.lit("_"))
    return F.left(or_else(name, fallback), F.lit(limit))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """File name without its last extension; leading dots are not an extension."""
    return F.regexp_replace(name, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def slug(name: str | Column) -> Column:
    """Folder-safe form of a file name."""
    return or_else(F.left(F.regexp_replace(stem(base_name(col(name))), r"(?U)[^\w.-]", "_"),
                          F.lit(NAME_LIMIT)), "doc")


def truncate(c: str | Column, limit: int, marker: str = TRUNCATED) -> Column:
    """Cut at ``limit`` characters and say so."""
    text = col(c)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def prompt_text(c: str | Column, limit: int) -> Column:
    """Document text as handed to an external service: placeholder when empty, marked when cut."""
    return truncate(or_else(col(c), EMPTY_DOC), limit)


def md_cell(c: str | Column) -> Column:
    """Text made safe for a Markdown table cell."""
    one_line = F.replace(F.replace(col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return or_else(strip(one_line), "—")


def session_key(path: str | Column) -> Column:
    return F.left(F.md5(col(path)), F.lit(12))


def squeeze(c: str | Column) -> Column:
    """White-space runs become one blank, ends trimmed."""
    return strip(F.regexp_replace(col(c), rf"{WS}+", " "))


def closes_session(c: str | Column) -> Column:
    return col(c).rlike(CLOSING)


def bullet_items(c: str | Column) -> Column:
    """Non-blank lines of a field without their bullet signs."""
    return F.transform(F.filter(lines_of(strip(c)), lambda x: ~is_blank(x)),
                       lambda x: F.ltrim(strip(x), F.lit("-·• ")))


def words(c: str | Column) -> Column:
    """Lower-cased tokens split at any white space, as an array."""
    return F.filter(F.split(F.lower(col(c)), rf"{WS}+"), lambda w: w != "")


def visible_text(c: str | Column) -> Column:
    """Text without HTML comments."""
    return F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")


# Named character references that occur in article pages.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def unescape(c: Column) -> Column:
    """Decode the common references; ``&amp;`` last so that nothing is decoded twice."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


# Display labels of stored codes.
EVENT_LABELS = {"Technology": "技术", "Market": "市场", "Capital": "资本",
                "Competitive": "竞争", "Policy": "政策"}
FEATURE_LABELS = {"battle": "论文之战", "review": "新项目评审", "radar": "投资雷达",
                  "ingest": "文件归档", "tech": "技术提取", "unknown": "其他"}


def label(c: str | Column, labels: dict[str, str]) -> Column:
    return lookup(col(c), labels, col(c))
