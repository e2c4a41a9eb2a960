"""Small string helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# White space as the source data's own trimming understands it: every Unicode
# blank and the ASCII separators, not only the plain blank (fixed values).
_PLAIN = " "
_OTHER = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space."""
    return F.trim(text, F.lit(_PLAIN + _OTHER))


def collapse_space(text: Column) -> Column:
    """Trim, and turn every inner run of white space into one blank."""
    plain = F.trim(F.translate(text, _OTHER, _PLAIN * len(_OTHER)))
    # Runs are rare, so the pattern is only tried where there is one.
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """``table[key]``, null on a miss. The table is a literal map in the plan."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to_null(text: Column) -> Column:
    """The trimmed text, or null when nothing is left of it."""
    return F.nullif(strip(text), F.lit(""))
