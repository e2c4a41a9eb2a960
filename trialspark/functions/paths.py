"""Reading a study by JSON path, and checking that a quoted value really is there."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.text import strip


def path_first(path: str, root: Column | None = None) -> Column:
    """Value at a dotted path of the nested record; ``name[]`` takes element 0."""
    return _walk(path.split("."), root, every=False)


def path_all(path: str) -> Column:
    """Array of the leaves at a dotted path; ``name[]`` goes through every element.

    A list leaf stays one leaf (an array inside the array). A list on the way
    that is absent or empty gives ``[null]``, as an absent leaf does.
    """
    return _walk(path.split("."), None, every=True)


def _step(column: Column | None, name: str) -> Column:
    return F.col(name) if column is None else column.getField(name)


def _walk(parts: list[str], column: Column | None, every: bool) -> Column:
    for position, part in enumerate(parts):
        if not part.endswith("[]"):
            column = _step(column, part)
            continue
        items = _step(column, part[:-2])
        rest = parts[position + 1 :]
        if not every:
            return _walk(rest, F.get(items, 0), every) if rest else F.get(items, 0)
        if not rest:
            leaves = items
        elif any(p.endswith("[]") for p in rest):
            leaves = F.flatten(F.transform(items, lambda x: _walk(rest, x, every)))
        else:
            leaves = F.transform(items, lambda x: _walk(rest, x, False))
        return F.when(F.size(items) > 0, leaves).otherwise(F.array(F.lit(None)))
    return F.array(column) if every else column


# --- quotes -----------------------------------------------------------------------

# Flat column behind every alias that a citation can point at.
_FLAT = {
    "nctId": "nct_id",
    "studyType": "study_type",
    "overallStatus": "overall_status",
    "sponsorClass": "sponsor_class",
    "sponsorName": "sponsor_name",
    **fixed.DATE_COLUMNS,
}


def flat_values(alias: str) -> Column:
    """The record's values at an alias as ``array<string>``, from the flat table."""
    if alias == "phase":
        return F.coalesce(F.col("phases"), F.array().cast("array<string>"))
    if alias == "country":
        return F.coalesce(F.col("countries_raw"), F.array().cast("array<string>"))
    if alias in ("interventionType", "interventionName"):
        # Field access on the array, not a lambda, so that the scan reads this part only.
        part = "type" if alias == "interventionType" else "name"
        return F.coalesce(F.col(f"interventions.{part}"), F.array().cast("array<string>"))
    column = F.col(_FLAT[alias])
    return F.when(column.isNotNull(), F.array(column)).otherwise(F.array().cast("array<string>"))


def flat_columns(alias: str) -> tuple[str, ...]:
    """Flat columns that :func:`flat_values` reads."""
    if alias == "phase":
        return ("phases",)
    if alias == "country":
        return ("countries_raw",)
    if alias in ("interventionType", "interventionName"):
        return ("interventions",)
    return (_FLAT[alias],)


def quoted_in(quote: Column, value: Column, is_array: Column) -> Column:
    """Is ``quote`` a legitimate quote of ``value`` (an ``array<string>``)?

    Nothing is a quote of an absent value only; a list is quoted by one whole
    element; a scalar by any part of its text.
    """
    present = F.filter(value, lambda v: v.isNotNull())
    absent = (F.size(present) < 1) | (~is_array & (F.get(present, 0) == ""))
    part = F.exists(present, lambda v: F.contains(v, quote))
    return F.when(quote == "", F.coalesce(absent, F.lit(True))).otherwise(
        F.coalesce(
            F.when(is_array, F.array_contains(present, quote)).otherwise(part), F.lit(False)
        )
    )


def path_quotes(path: Column, quote: Column, fields: Iterable[str] = tuple(fixed.FIELD_PATHS)) -> Column:
    """Does ``quote`` occur at ``path`` in the flat record? Null for an unknown path.

    Only the phase list is one list-valued leaf, quoted by a whole element. The
    ``[]`` fields are text met once per list element, quoted by a part of it.
    """
    found = F.lit(None).cast("boolean")
    for alias in fields:
        known, values = fixed.FIELD_PATHS[alias], flat_values(alias)
        absent = F.size(F.filter(values, lambda v: v.isNotNull())) < 1
        here = F.when(quote == "", absent).otherwise(
            quoted_in(quote, values, F.lit(alias == "phase"))
        )
        found = F.when(path == known, here).otherwise(found)
    return found


def first_value(value: Column) -> Column:
    """The literal value at a path as text: a list's first element, "" when absent."""
    return F.coalesce(F.get(value, 0), F.lit(""))


def title_excerpt(title: Column, matched: Column) -> Column:
    """Brief title, or the matched value for a record that has none."""
    return F.coalesce(F.nullif(title, F.lit("")), matched)


def clean(text: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(strip(text), F.lit(""))
