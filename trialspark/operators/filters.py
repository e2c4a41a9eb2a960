"""Filters over the flat study table. All are AND-composed.

Arguments are checked while the query is built: an unknown key, token or year
raises ``ValueError`` before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.dates import ct_year
from trialspark.sources.layout import YEAR_PART, year_folders

class Filter(NamedTuple):
    """A named filter: the columns it reads, the check of its value, and its clauses."""

    columns: tuple[str, ...]
    check: Callable[[object], object]
    clauses: Callable[[object], list[Column]]


def _one_of(kind: str, known: tuple[str, ...]) -> Callable[[object], object]:
    def check(value: object) -> object:
        if value not in known:
            raise ValueError(f"{value!r} is no {kind} token; known: {list(known)}")
        return value

    return check


def _some_of(kind: str, known: tuple[str, ...]) -> Callable[[object], object]:
    one = _one_of(kind, known)
    return lambda value: [one(v) for v in (value if isinstance(value, list | tuple) else [value])]


def _year(value: object) -> object:
    low, high = fixed.YEAR_FENCE
    if type(value) is not int or value not in range(low, high + 1):
        raise ValueError(f"a year is an integer from {low} to {high}, not {value!r}")
    return value


def _equals(column: str) -> Callable[[object], list[Column]]:
    return lambda value: [F.col(column) == value]


_STATUS = Filter(("overall_status",), _one_of("status", fixed.STATUS_TOKENS), _equals("overall_status"))

FILTERS = {
    "overallStatus": _STATUS,
    "status": _STATUS,
    "interventional_only": Filter(
        ("study_type",), lambda value: value is True, lambda on: [F.col("study_type") == "INTERVENTIONAL"] if on else []
    ),
    "studyType": Filter(("study_type",), _one_of("study type", fixed.STUDY_TYPE_TOKENS), _equals("study_type")),
    "phase": Filter(
        ("phases",),
        _some_of("phase", fixed.PHASE_TOKENS),
        lambda tokens: [F.arrays_overlap("phases", F.array(*map(F.lit, tokens)))] if tokens else [],
    ),
    "sponsorClass": Filter(("sponsor_class",), _one_of("sponsor class", fixed.SPONSOR_CLASS_TOKENS), _equals("sponsor_class")),
    "interventionType": Filter(
        ("interventions",),
        _one_of("intervention type", fixed.INTERVENTION_TYPE_TOKENS),
        lambda token: [F.array_contains("interventions.type", token)],
    ),
    "start_year": Filter(("start_date",), _year, lambda year: [ct_year(F.col("start_date")) >= year]),
    "end_year": Filter(("start_date",), _year, lambda year: [ct_year(F.col("start_date")) <= year]),
}

SEARCH_COLUMNS = {
    "cond": ("conditions",),
    "intr": ("interventions",),
    "spons": ("sponsor_name",),
    "locn": ("countries_raw",),
    "term": ("brief_title", "conditions", "interventions", "sponsor_name"),
}


def filter_columns(filters: Mapping | None = None, search: Mapping | None = None) -> set[str]:
    """Flat columns the given filters and search terms read."""
    names = {c for key in (filters or {}) if key in FILTERS for c in FILTERS[key].columns}
    return names | {c for key in (search or {}) for c in SEARCH_COLUMNS.get(search_area(key), ())}


def _filters(filters: Mapping) -> list[Column]:
    """The clauses of all given filters. A null value is no filter; of the two status names the longer wins."""
    strange = filters.keys() - FILTERS.keys()
    if strange:
        raise ValueError(f"no such filters: {sorted(strange)}; known: {sorted(FILTERS)}")
    shadowed = {"status"} if "overallStatus" in filters else set()
    checked = {k: FILTERS[k].check(v) for k, v in filters.items() if v is not None and k not in shadowed}
    if checked.get("start_year", 0) > checked.get("end_year", checked.get("start_year", 0)):
        raise ValueError(f"the years {checked['start_year']} to {checked['end_year']} run backwards")
    return [clause for key in FILTERS if key in checked for clause in FILTERS[key].clauses(checked[key])]


def search_area(name: str) -> str:
    area = fixed.DIMENSION_AREAS.get(name, name)
    if area not in fixed.SEARCH_AREAS:
        raise ValueError(f"unknown search area {name!r}; known: {sorted(fixed.DIMENSION_AREAS)}")
    return area


def _search(area: str, value: str) -> Column:
    """Case-insensitive literal substring over the columns of a search area.

    Operator words and brackets in the value are ordinary text. There is no
    synonym expansion.
    """
    needle = F.lit(value.lower())

    def has(text: Column) -> Column:
        return F.contains(F.lower(text), needle)

    interventions = [
        F.exists("interventions.name", has),
        F.exists(F.flatten(F.filter("interventions.otherNames", lambda o: o.isNotNull())), has),
    ]
    clauses = {
        "cond": [F.exists("conditions", has)],
        "intr": interventions,
        "spons": [has(F.col("sponsor_name"))],
        "locn": [F.exists("countries_raw", has)],
    }
    clauses["term"] = [has(F.col("brief_title")), *clauses["cond"], *clauses["intr"], *clauses["spons"]]
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in clauses[area]])


def predicate(filters: Mapping | None = None, search: Mapping | None = None) -> Column:
    """One boolean column for all filters and search terms; never null.

    ``search`` maps an area or a dimension name to text; empty text is skipped.
    """
    clauses = _filters(filters or {})
    clauses += [_search(search_area(area), value) for area, value in (search or {}).items() if value]
    return F.coalesce(reduce(lambda a, b: a & b, clauses, F.lit(True)), F.lit(False))


def filter_trials(
    trials: DataFrame, filters: Mapping | None = None, search: Mapping | None = None
) -> DataFrame:
    """The matching trials. Each scalar clause is a separate filter, so it reaches the scan.

    Of trials stored by year, a year range opens the folders that can hold it.
    """
    years = [(filters or {}).get(key) for key in ("start_year", "end_year")]
    if YEAR_PART in trials.columns and any(year is not None for year in years):
        trials = trials.filter(year_folders(*years))
    for clause in _filters(filters or {}):
        trials = trials.filter(clause)
    for area, value in (search or {}).items():
        clause_area = search_area(area)
        if value:
            trials = trials.filter(_search(clause_area, value))
    return trials
