"""Small expression helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() and str.split() treat as white space.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# The same set as Java regex classes: any white space, and white space inside one line. Spelled
# out, because the Unicode mode of the regex engine slows down every other class of a pattern.
_WIDE = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = rf"\s{_WIDE}"
WS = rf"[{WS_CHARS}]"
WS_INLINE = rf"[\t\x0b\f\r {_WIDE}]"
NON_WS = rf"[^{WS_CHARS}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A lambda variable holds the evaluated value, so it is not recomputed for every element of
    the array functions inside ``body`` (the optimizer may inline a plain column there).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each_present(value: Column) -> Column:
    """Generator that keeps the row with ``value`` when it is not null and drops it otherwise.

    A filter on a computed column would be pushed below the projection and compute it once more.
    """
    return F.explode(F.filter(F.array(value), lambda v: v.isNotNull()))


def quoted(text: str) -> str:
    """Regular expression that matches exactly this text."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def strip_newlines(c: Column) -> Column:
    return F.btrim(c, F.lit("\n"))


def is_blank(c: str | Column) -> Column:
    return strip(c) == ""


def or_else(c: Column, default: str | Column) -> Column:
    """``c`` unless it is missing or the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def lookup(c: Column, table: dict[str, str], default: Column | str) -> Column:
    """Constant map lookup with a default; the table is part of the plan."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c),
                      F.lit(default) if isinstance(default, str) else default)


def one_of(c: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def lines_of(c: str | Column) -> Column:
    return F.split(col(c), "\n")


def run_starts(items: Column, key: Callable[[Column], Column]) -> Column:
    """Zero-based positions at which a sorted array starts a run of equal keys."""
    return let(items, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.filter(
        F.sequence(F.lit(0), F.size(a) - 1),
        lambda i: (i == 0) | (key(F.get(a, i - 1)) != key(F.get(a, i))))))


def first_of_runs(items: Column, key: Callable[[Column], Column]) -> Column:
    """Of a sorted array keep the first element of every run of equal keys (linear)."""
    return let(items, lambda a: F.filter(
        a, lambda x, i: (i == 0) | (key(F.get(a, i - 1)) != key(x))))
