"""Small string helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a text is stripped.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Line breaks other than a plain newline.
OTHER_BREAK = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Java flags that make a pattern behave on Unicode text as the rules expect:
# d = only \n ends a line, U = Unicode word and space classes.
UNICODE = "(?dU)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression that a lambda refers to is evaluated again for every
    element. Bound like this it is a plain lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def _split_lines(c: Column | str) -> Column:
    """Split at every kind of line break.

    Splitting at a single character is several times faster than at a
    pattern, so the rare other breaks are turned into newlines first.
    """
    c = col(c)
    plain = F.when(c.rlike(OTHER_BREAK), F.regexp_replace(c, OTHER_BREAK, "\n")).otherwise(c)
    return F.split(plain, "\n")


def lines(c: Column | str) -> Column:
    """Split into lines without a trailing empty line; an empty text has none."""
    return let(
        _split_lines(c),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def nonblank_lines(c: Column | str) -> Column:
    """Stripped lines with the empty ones removed."""
    stripped = F.transform(_split_lines(c), strip)
    return F.filter(stripped, lambda line: line != "")


def count_char(c: Column | str, char: str) -> Column:
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a literal pattern, compiled once per task."""
    return F.regexp_extract_all(col(c), F.lit(UNICODE + pattern), F.lit(group))


def find_first(c: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match, or null when there is none."""
    c = col(c)
    return F.when(c.rlike(UNICODE + pattern), F.regexp_extract(c, UNICODE + pattern, group))


def ellipsis(c: Column | str, limit: int = 150) -> Column:
    """Cut at ``limit`` characters and mark the cut."""
    c = col(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit("No description available."))
        .when(F.length(c) <= limit, c)
        .otherwise(F.concat(F.substring(c, 1, limit), F.lit("...")))
    )
