"""Trials per year: gap-filled, with planned, partial and missing rows flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.dates import ct_year, is_future
from trialspark.operators.evidence import bucket_evidence, with_evidence
from trialspark.operators.fields import date_spec
from trialspark.operators.grouping import keyed_rows
from trialspark.session import cut_lineage


def timeseries(
    trials: DataFrame,
    date_field: str = "startDate",
    *,
    current_year: int,
    grain: str = "year",
    unique_ids: bool = False,
    order_column: str | None = None,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
) -> DataFrame:
    """One row per year from the first to the last non-future year, then planned years,
    then one ``MISSING`` row without a period for trials whose date is unusable.

    ``current_year`` is an argument, so a stored query gives the same answer
    next year.
    """
    spec = date_spec(date_field)
    if grain != "year":
        raise ValueError(f"unknown grain {grain!r}; known: ['year']")
    rows = keyed_rows(trials, spec, (), unique_ids, order_column)
    rows = rows.withColumn("year", ct_year(F.col(spec.columns[0])))
    # Stored: a row per year, read for the range, the gaps and the bars; the trials are read once more for evidence.
    counts = cut_lineage(rows.groupBy("year").agg(F.count("nct_id").alias("count_trials")), "years")

    # Gaps lie inside the non-future years. With no such year the range is null
    # and explodes to nothing; it never counts down.
    seen = counts.filter(~is_future(F.col("year"), current_year)).agg(
        F.min("year").alias("low"), F.max("year").alias("high")
    )
    years = seen.select(F.explode(F.sequence("low", "high")).alias("year"))
    gaps = years.join(counts, "year", "left_anti").withColumn("count_trials", F.lit(0).cast("long"))

    text = F.col("year").cast("string")
    planned = F.coalesce(is_future(F.col("year"), current_year), F.lit(False))
    partial = F.coalesce(F.col("year") == current_year, F.lit(False)) & (F.col("count_trials") > 0)
    label = (
        F.when(F.col("year").isNull(), fixed.MISSING_DATE_LABEL)
        .when(planned, F.concat(text, F.lit(" (planned)")))
        .when(partial, F.concat(text, F.lit(" (partial)")))
        .otherwise(text)
    )
    buckets = counts.unionByName(gaps).select(
        "year",
        F.coalesce(text, F.lit(fixed.MISSING)).alias("value"),
        label.alias("label"),
        text.alias("period"),
        "count_trials",
        F.col("count_trials").alias("count_mentions"),
        planned.alias("planned"),
        partial.alias("partial_year"),
    )
    evidence = None
    if evidence_limit:
        sources = rows.withColumn("value", F.coalesce(text, F.lit(fixed.MISSING)))
        evidence = bucket_evidence(sources.withColumn("member", F.col("value")), spec, ["value"], evidence_limit)
    return with_evidence(buckets, evidence, ["value"]).orderBy(F.col("year").asc_nulls_last()).drop("year")


def series_summary(series: DataFrame) -> DataFrame:
    """One row: whether one point is all there is, and what the notes disclose."""
    has_period = F.col("period").isNotNull()
    points = F.count_if(has_period & (F.col("count_trials") > 0))
    return series.agg(
        (points <= 1).alias("degrade"),
        points.alias("plotted_points"),
        F.count_if(has_period & (F.col("count_trials") == 0)).alias("gap_years"),
        F.count_if("planned").alias("planned_years"),
        F.count_if("partial_year").alias("partial_years"),
        F.coalesce(F.sum(F.when(~has_period, F.col("count_trials"))), F.lit(0)).alias("missing_trials"),
        F.coalesce(F.sum("count_trials"), F.lit(0)).alias("sum_trials"),
    )
