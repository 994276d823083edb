"""Article web pages to columns: title, account, date, body text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import col, first_nonempty, lines_of, strip
from ..functions.text import unescape


def meta(page: Column, name: str) -> Column:
    """Content of a meta element, with its attributes in either order."""
    n = re.escape(name)
    named_first = rf"""<meta[^>]+(?:property|name)=["']{n}["'][^>]+content=["']([^"']*)"""
    content_first = rf"""<meta[^>]+content=["']([^"']*)["'][^>]+(?:property|name)=["']{n}["']"""
    return strip(unescape(F.when(page.rlike(named_first), F.regexp_extract(page, named_first, 1))
                          .otherwise(F.regexp_extract(page, content_first, 1))))


def visible_lines(fragment: Column) -> Column:
    """Text of an HTML fragment, one line per run of text, blank lines dropped."""
    bare = F.regexp_replace(F.regexp_replace(fragment, r"(?s)<script.*?</script>", ""), r"(?s)<style.*?</style>", "")
    text = unescape(F.regexp_replace(bare, r"<[^>]+>", "\n"))
    broken = F.regexp_replace(text, r"\r\n|[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n")
    return F.array_join(F.filter(F.transform(lines_of(broken), strip), lambda s: s != ""), "\n")


def article(page: str | Column, heading: str = r"""<h1[^>]*class="rich_media_title"[^>]*>""",
            body_start: str = r"""id="js_content"[^>]*>""",
            body_end: str = r"""<script[\s>]|<div class="rich_media_tool\"""") -> dict[str, Column]:
    """Title, account, publication date and body; what is missing is the empty string.

    The three patterns describe the page layout; the defaults are those of the article pages the
    pool is fed from.
    """
    p = col(page)
    h1 = F.replace(visible_lines(F.regexp_extract(p, rf"(?s){heading}(.*?)</h1>", 1)), F.lit("\n"), F.lit(" "))
    nickname = strip(F.regexp_extract(p, r"""var nickname = (?:htmlDecode\()?"([^"]+)\"""", 1))
    epoch = F.regexp_extract(p, r"""var ct = "?(\d{9,11})"?""", 1)
    fragment = F.regexp_extract(p, rf"(?s){body_start}(.*?)(?:{body_end}|\z)", 1)
    return {
        "title": first_nonempty(meta(p, "og:title"), h1),
        "account": first_nonempty(nickname, meta(p, "og:article:author"), meta(p, "author")),
        "date": F.when(epoch != "", F.date_format(F.timestamp_seconds(epoch.try_cast("bigint")), "yyyy-MM-dd"))
        .otherwise(""),
        "text": visible_lines(fragment)}
