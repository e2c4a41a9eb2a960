"""Comparing arms: several filtered, possibly overlapping populations side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark import fixed_values as fixed
from trialspark.operators.fields import FieldSpec, field_spec
from trialspark.operators.filters import filter_columns, predicate
from trialspark.operators.grouping import FROM_SPEC, distribution
from trialspark.sources.schema import CITATION


@dataclass(frozen=True)
class Arm:
    """One arm: a label, its search terms, and filters laid over the common ones."""

    label: str
    search: Mapping[str, str] = dataclass_field(default_factory=dict)
    filters: Mapping[str, object] = dataclass_field(default_factory=dict)


def cap_arms(arms: Sequence[Arm], limit: int | None = None) -> tuple[list[Arm], list[str]]:
    """The first ``limit`` arms (all without one), and the labels of the ones left out."""
    kept = list(arms if limit is None else arms[:limit])
    return kept, [a.label for a in arms[len(kept):]]


def percent(count: Column, total: Column) -> Column:
    """Share in percent, one decimal, halves rounded up; 0.0 without a total.

    Integer arithmetic up to the last step, so no tie depends on how a binary
    fraction happens to fall.
    """
    tenths = F.floor((count * 2000 + total) / (total * 2))
    return F.when(total > 0, tenths.cast("double") / 10).otherwise(F.lit(0.0))


def arm_rows(trials: DataFrame, arms: Sequence[Arm], common: Mapping | None = None) -> DataFrame:
    """Every trial once per arm it belongs to, tagged ``arm``; one scan for all arms.

    Common filters apply to each arm, the interventional toggle included; an
    arm's own filters win key by key.
    """
    member = [
        F.when(predicate({**(common or {}), **arm.filters}, arm.search), F.lit(i))
        for i, arm in enumerate(arms)
    ]
    # Outer, then filtered: a plain explode would evaluate all predicates twice.
    listed = F.array_compact(F.array(*member))
    return trials.withColumn("arm", F.explode_outer(listed)).filter(F.col("arm").isNotNull())


def compare(
    trials: DataFrame,
    field: str | FieldSpec,
    arms: Sequence[Arm],
    *,
    common: Mapping | None = None,
    unique_ids: bool = False,
    order_column: str | None = None,
    top_n: int | None = FROM_SPEC,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
    max_arms: int | None = None,
) -> DataFrame:
    """Every category for every arm, with counts and the percentage within the arm.

    A category an arm lacks is a zero row. Categories come in the order the
    arms first show them, then the arms in the order given. With ``max_arms``
    only the first ones are compared; :func:`compare_summary` names the others.
    """
    arms, _ = cap_arms(arms, max_arms)
    if len(arms) < 2:
        raise ValueError("a comparison needs at least two arms")
    spec = field_spec(field)
    rows = arm_rows(trials, arms, common)
    buckets = distribution(
        rows,
        spec,
        unique_ids=unique_ids,
        order_column=order_column,
        top_n=top_n,
        evidence_limit=evidence_limit,
        by=["arm"],
        sort=False,
    )

    # Bucket tables from here on: categories x arms.
    place = F.row_number().over(Window.partitionBy("arm").orderBy(*spec.order()))
    placed = buckets.withColumn("place", place)
    shown = F.row_number().over(Window.partitionBy("value").orderBy("arm", "place", "label"))
    first = placed.withColumn("_shown", shown).filter(F.col("_shown") == 1).select("value", F.struct("arm", "place", "label").alias("first"))
    every = F.array(*[F.struct(F.lit(i).alias("arm"), F.lit(a.label).alias("series")) for i, a in enumerate(arms)])
    grid = first.select("value", "first", F.inline(every)).join(arm_totals(rows, unique_ids), "arm", "left")
    filled = grid.join(placed.drop("label", "place"), ["arm", "value"], "left")
    count = F.coalesce(F.col("count_trials"), F.lit(0))
    total = F.coalesce(F.col("arm_total"), F.lit(0))
    return filled.select(
        "value",
        F.col("first.label").alias("label"),
        "series",
        count.alias("count_trials"),
        F.coalesce("count_mentions", F.lit(0)).alias("count_mentions"),
        percent(count, total).alias("percent"),
        total.alias("arm_total"),
        F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
        _empty_citations().alias("citations"),
        F.coalesce("citations_truncated", F.lit(False)).alias("citations_truncated"),
        F.coalesce("contributing_count", F.lit(0)).alias("contributing_count"),
        F.coalesce("derived", F.lit(False)).alias("derived"),
        "members",
        F.col("first.arm").alias("category_arm"),
        F.col("first.place").alias("category_place"),
        "arm",
    ).orderBy("category_arm", "category_place", "arm")


def _empty_citations() -> Column:
    return F.coalesce("citations", F.array().cast(f"array<{CITATION.simpleString()}>"))


def arm_totals(rows: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Distinct trials per arm: the denominator of its percentages."""
    total = F.count("nct_id") if unique_ids else F.count_distinct("nct_id")
    return rows.groupBy("arm").agg(total.alias("arm_total"))


def compare_summary(
    trials: DataFrame,
    arms: Sequence[Arm],
    *,
    common: Mapping | None = None,
    declared: Mapping[str, int] | None = None,
    unique_ids: bool = False,
    max_arms: int | None = None,
) -> DataFrame:
    """One row per arm asked for: its total, its drift from a declared total, and
    whether it was dropped by the arm limit. ``status`` is ``empty`` when no arm matches.
    """
    kept, _ = cap_arms(arms, max_arms)
    rows = arm_rows(trials, kept, common)
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("arm"),
                F.lit(a.label).alias("series"),
                F.lit(i >= len(kept)).alias("dropped"),
                F.lit((declared or {}).get(a.label)).cast("long").alias("declared_total"),
            )
            for i, a in enumerate(arms)
        ]
    )
    listed = trials.sparkSession.range(1).select(F.inline(table))
    totals = listed.join(arm_totals(rows, unique_ids), "arm", "left")
    found = F.when(~F.col("dropped"), F.coalesce("arm_total", F.lit(0)))
    return totals.select(
        "arm",
        "series",
        "dropped",
        found.alias("arm_total"),
        (F.col("declared_total") - found).alias("drift"),
        F.when(F.max(found).over(Window.partitionBy(F.lit(0))) == 0, "empty").otherwise("ok").alias("status"),
    ).orderBy("arm")


def compare_columns(field: str | FieldSpec, arms: Sequence[Arm], common: Mapping | None = None) -> set[str]:
    """Flat columns a comparison reads, to project or build before it runs."""
    names = {"nct_id", "brief_title", *field_spec(field).columns} | filter_columns(common)
    for arm in arms:
        names |= filter_columns(arm.filters, arm.search)
    return names
