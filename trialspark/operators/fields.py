"""How each chartable field is keyed, labelled, ordered and cited.

A :class:`FieldSpec` is data: register another one to chart another field; the
grouping code does not change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions import names, phases
from trialspark.functions.paths import flat_values


def _no_tokens(value: Column) -> Column:
    return F.lit(None).cast("array<string>")


def by_count() -> list[Column]:
    """Ranked bars: real values by falling count, then name; sentinels last."""
    return [
        F.col("value").isin(*fixed.SENTINELS).cast("int").asc(),
        F.col("count_trials").desc(),
        F.col("value").asc(),
    ]


def by_phase() -> list[Column]:
    return [c.asc() for c in phases.phase_order(F.col("value"))]


@dataclass(frozen=True)
class FieldSpec:
    """``key`` gives one bucket value (combine) or an array of distinct ones (explode);
    an empty or null array puts the trial into the ``UNKNOWN`` bucket.

    ``evidence`` is the record's own value as ``array<string>``, ``matched``
    picks the quote of a bucket's value from the record, and ``tokens`` lists
    the members of a composite bucket found in the record.
    """

    alias: str
    path: str
    mode: str
    columns: tuple[str, ...]
    key: Callable[[], Column]
    label: Callable[[Column], Column]
    order: Callable[[], list[Column]] = by_count
    top_n: int | None = None
    noun: str = "categories"
    evidence: Callable[[], Column] | None = None
    matched: Callable[[Column], Column] | None = None
    tokens: Callable[[Column], Column] = _no_tokens
    known_tokens: tuple[str, ...] | None = None
    is_list: bool = False


def _one(column: str) -> Column:
    """A scalar column, blank as absent."""
    return F.nullif(F.col(column), F.lit(""))


def _types() -> Column:
    named = F.filter(flat_values("interventionType"), lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(named)


def _countries() -> Column:
    canonical = F.transform(F.col("countries_raw"), names.canonical_country)
    return F.array_distinct(F.filter(canonical, lambda c: c.isNotNull()))


def _phase_matched(value: Column) -> Column:
    members = phases.phase_tokens(value)
    return F.when(F.size(members) > 1, F.get(members, 0)).otherwise(
        F.coalesce(F.get(F.col("phases"), 0), F.lit(""))
    )


def _phase_tokens(value: Column) -> Column:
    members = phases.phase_tokens(value)
    found = F.filter(members, lambda t: F.array_contains(F.col("phases"), t))
    return F.when(F.size(members) > 1, found)


def _scalar(alias: str, column: str, label, known: tuple[str, ...]) -> FieldSpec:
    return FieldSpec(
        alias=alias,
        path=fixed.FIELD_PATHS[alias],
        mode="combine",
        columns=(column,),
        key=lambda: F.coalesce(_one(column), F.lit(fixed.UNKNOWN)),
        label=label,
        evidence=lambda: flat_values(alias),
        matched=lambda value: F.coalesce(F.col(column), F.lit("")),
        known_tokens=known,
    )


FIELDS: dict[str, FieldSpec] = {
    "phase": FieldSpec(
        alias="phase",
        path=fixed.FIELD_PATHS["phase"],
        is_list=True,
        mode="combine",
        columns=("phases",),
        key=lambda: phases.phase_key(F.col("phases")),
        label=phases.phase_label,
        order=by_phase,
        evidence=lambda: flat_values("phase"),
        matched=_phase_matched,
        tokens=_phase_tokens,
    ),
    "overallStatus": _scalar("overallStatus", "overall_status", names.status_label, fixed.STATUS_TOKENS),
    "sponsorClass": _scalar("sponsorClass", "sponsor_class", names.title_case, fixed.SPONSOR_CLASS_TOKENS),
    "interventionType": FieldSpec(
        alias="interventionType",
        path=fixed.FIELD_PATHS["interventionType"],
        is_list=True,
        mode="explode",
        columns=("interventions",),
        key=_types,
        label=names.intervention_type_label,
        evidence=_types,
        matched=lambda value: value,
        known_tokens=fixed.INTERVENTION_TYPE_TOKENS,
    ),
    "country": FieldSpec(
        alias="country",
        path=fixed.FIELD_PATHS["country"],
        is_list=True,
        mode="explode",
        columns=("countries_raw",),
        key=_countries,
        label=names.country_label,
        noun="countries",
        # The record's own spelling is quoted, not the canonical one.
        evidence=lambda: flat_values("country"),
        matched=lambda value: F.get(
            F.filter("countries_raw", lambda c: names.canonical_country(c) == value), 0
        ),
    ),
}


def field_spec(field: str | FieldSpec) -> FieldSpec:
    if isinstance(field, FieldSpec):
        return field
    if field not in FIELDS:
        raise ValueError(f"unknown field {field!r}; known: {sorted(FIELDS)}")
    return FIELDS[field]


def date_spec(date_field: str) -> FieldSpec:
    """The citation half of a date field; its buckets are years or durations."""
    if date_field not in fixed.DATE_COLUMNS:
        raise ValueError(f"unknown date field {date_field!r}; known: {sorted(fixed.DATE_COLUMNS)}")
    column = fixed.DATE_COLUMNS[date_field]
    return FieldSpec(
        alias=date_field,
        path=fixed.FIELD_PATHS[date_field],
        mode="combine",
        columns=(column,),
        key=lambda: F.col(column),
        label=lambda value: value,
        evidence=lambda: flat_values(date_field),
        matched=lambda value: F.coalesce(F.col(column), F.lit("")),
    )
