"""Metadata read from the head of a Markdown document (its first 30 lines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import NON_WS, WS, WS_CHARS, col, first_nonempty, let, lines_of, lookup, or_else, quoted, strip
from .text import squeeze, stem

HEAD_LINES = 30
PROFILE_CHARS = 5000
GIST_CHARS = 150

# File types by extension, and the status buckets.
FILE_TYPES = {".md": "markdown", ".txt": "text"}
STATUS_DEFAULT = "跟踪中"
# Order matters: an exit outranks an investment, which outranks a rejection.
STATUS_RULES = [
    ("已退出", ["退出"]),
    ("已投资", ["已投"]),
    ("已放弃", ["放弃", "否决", "Pass"]),
    ("推进中", ["推进", "CDD", "DD", "尽调"]),
]

# Labels that introduce a field, in order of preference.
TITLE = rf"(?dm)^#{WS}+(.+)$"
TAGS = [rf"(?i)Tags?[:：]{WS}*([\p{{L}}\p{{N}}_,/#{WS_CHARS}]+)", rf"标签[:：]{WS}*([\p{{L}}\p{{N}}_,/#{WS_CHARS}]+)"]
PROJECT = [rf"(?di)\*\*Deal Type\*\*.*?\|{WS}*\*\*([^|*]+)\*\*", rf"项目[:：]{WS}*({NON_WS}+)"]
STATUS = [rf"(?i)Status\*{{0,2}}[:：]{WS}*([^\n|]+)", rf"状态\*{{0,2}}[:：]{WS}*([^\n|]+)"]
UPDATED = [rf"(?iU)Last Updated[:：]{WS}*(\d{{4}}-\d{{2}}-\d{{2}})",
           rf"(?U)更新时间[:：]{WS}*(\d{{4}}-\d{{2}}-\d{{2}})",
           rf"(?U)更新日期[:：]{WS}*(\d{{4}}-\d{{2}}-\d{{2}})"]


def head(content: str | Column) -> Column:
    """The first 30 lines; the rest of the document is never scanned."""
    return F.substring_index(col(content), "\n", HEAD_LINES)


def _first_match(text: Column, patterns: list[str]) -> Column:
    return strip(first_nonempty(*[F.regexp_extract(text, p, 1) for p in patterns]))


def title(content: str | Column) -> Column:
    return strip(F.regexp_extract(head(content), TITLE, 1))


def subtitle(content: str | Column) -> Column:
    quotes = F.filter(lines_of(head(content)), lambda s: s.startswith("> ") & ~s.startswith("> **"))
    return F.array_join(F.transform(F.slice(quotes, 1, 2), lambda s: strip(F.substr(s, F.lit(3)))), " ")


def tags(content: str | Column) -> Column:
    """Tag list of the first labelled line. The class of tag characters includes line breaks, so
    the last tag runs on until a character outside the class."""
    found = first_nonempty(*[F.regexp_extract(head(content), p, 1) for p in TAGS])
    return F.filter(F.transform(F.split(found, ","), strip), lambda t: t != "")


def project(content: str | Column) -> Column:
    return _first_match(head(content), PROJECT)


def status_detail(content: str | Column) -> Column:
    return _first_match(head(content), STATUS)


def last_updated(content: str | Column) -> Column:
    return _first_match(head(content), UPDATED)


def normalize_status(raw: str | Column) -> Column:
    return let(col(raw), _status_bucket)


def _status_bucket(text: Column) -> Column:
    out = None
    for bucket, needles in STATUS_RULES:
        hit = F.contains(text, F.lit(needles[0]))
        for needle in needles[1:]:
            hit = hit | F.contains(text, F.lit(needle))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise(STATUS_DEFAULT)


def file_type(name: str | Column) -> Column:
    n = col(name)
    extension = F.when(n.rlike(r"(?s)\A\.*[^.].*\.[^.]*\z"),
                       F.concat(F.lit("."), F.substring_index(n, ".", -1))).otherwise("")
    return lookup(F.lower(extension), FILE_TYPES, "unknown")


def display_title(title_: str | Column, name: str | Column) -> Column:
    return or_else(col(title_), F.replace(col(name), F.lit(".md"), F.lit("")))


def display_date(updated: str | Column, modified: str | Column) -> Column:
    return or_else(col(updated), F.left(col(modified), F.lit(10)))


def page_slug(path: str | Column) -> Column:
    return F.concat(F.replace(F.replace(col(path), F.lit("/"), F.lit("__")), F.lit(".md"), F.lit("")),
                    F.lit(".html"))


def doc_profile(content: str | Column, name: str | Column, section: str = "技术原理") -> dict[str, Column]:
    """Title, one-line tagline and the gist of one named section, from the first 5000 characters."""
    text = F.left(col(content), F.lit(PROFILE_CHARS))
    body = F.regexp_extract(
        text, rf"(?dms)^##{WS}*{quoted(section)}{WS}*\n(.+?)(?=^##{WS}|\z)", 1)
    return {
        "title": or_else(strip(F.regexp_extract(text, TITLE, 1)), stem(col(name))),
        "tagline": strip(F.regexp_extract(text, rf"(?dm)^>{WS}*(.+)$", 1)),
        "gist": F.left(squeeze(body), F.lit(GIST_CHARS)),
    }


def extract_all(content: str | Column) -> dict[str, Column]:
    """All head fields of a document by column name."""
    return {"title": title(content), "subtitle": subtitle(content), "tags": tags(content),
            "project": project(content), "status_detail": status_detail(content),
            "status": normalize_status(status_detail(content)), "last_updated": last_updated(content)}
