"""String expressions used for identity matching (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` treats as whitespace
# (tab, LF, VT, FF, CR, FS, GS, RS, US, space, NEL, NBSP, Ogham space mark,
# the U+2000..U+200A spaces, line and paragraph separators, narrow NBSP,
# medium mathematical space, ideographic space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_whitespace(column: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` over a char set)."""
    return F.trim(column, F.lit(WHITESPACE))


def lookup_alias(column: Column) -> Column:
    """The alias text used for lookups: null becomes empty, edges are stripped."""
    return strip_whitespace(F.coalesce(column.cast("string"), F.lit("")))


def normalize_alias(column: Column) -> Column:
    """Normalized alias: stripped, spaces removed, ``_`` → ``-``, upper case."""
    stripped = lookup_alias(column)
    return F.upper(F.replace(F.replace(stripped, F.lit(" "), F.lit("")), F.lit("_"), F.lit("-")))


def default_text(column: Column, default: str) -> Column:
    """Null or empty text becomes ``default``."""
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit(default)).otherwise(column)


def numeric_suffix(column: Column) -> Column:
    """Trailing ``-``-separated part of an id as a number (null when not numeric)."""
    return F.element_at(F.split(column, "-"), -1).try_cast("bigint")
