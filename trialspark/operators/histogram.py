"""Study duration, start to completion in months, in half-open bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.dates import bin_index, bin_label, duration_months
from trialspark.operators.evidence import bucket_evidence, with_evidence
from trialspark.operators.fields import date_spec
from trialspark.operators.grouping import keyed_rows


def duration_histogram(
    trials: DataFrame,
    *,
    bins: Sequence[tuple[int | None, int | None]] | None = None,
    start_field: str = "startDate",
    end_field: str = "completionDate",
    unique_ids: bool = False,
    order_column: str | None = None,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
) -> DataFrame:
    """Every bin, empty ones included, then an ``UNDATED`` row when it is needed.

    Undated are the trials without both dates, with a completion before the
    start, or with a duration outside all bins. The evidence quotes the start.
    """
    edges = list(fixed.DURATION_BINS) if bins is None else [(lo, hi, bin_label(lo, hi)) for lo, hi in bins]
    spec = date_spec(start_field)
    end_column = date_spec(end_field).columns[0]
    start_column = spec.columns[0]
    wanted = _also(spec, end_column)
    rows = keyed_rows(trials, wanted, (), unique_ids, order_column)
    rows = rows.withColumn("months", duration_months(F.col(start_column), F.col(end_column)))
    # Bins go by position; -1 collects the undated.
    rows = rows.withColumn("bin", F.coalesce(bin_index(F.col("months"), edges), F.lit(-1)))
    counts = rows.groupBy("bin").agg(F.count("nct_id").alias("n"))

    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"),
                F.lit(label).alias("value"),
                F.lit(label).alias("label"),
                F.lit(lo).cast("double").alias("bin_start"),
                F.lit(hi).cast("double").alias("bin_end"),
            )
            for i, (lo, hi, label) in enumerate(edges)
        ],
        F.struct(
            F.lit(-1).alias("bin"),
            F.lit(fixed.UNDATED).alias("value"),
            F.lit(fixed.UNDATED_LABEL).alias("label"),
            F.lit(None).cast("double").alias("bin_start"),
            F.lit(None).cast("double").alias("bin_end"),
        ),
    )
    every_bin = trials.sparkSession.range(1).select(F.inline(table))
    buckets = (
        every_bin.join(counts, "bin", "left")
        .withColumn("count_trials", F.coalesce("n", F.lit(0)).cast("long"))
        .filter((F.col("bin") >= 0) | (F.col("count_trials") > 0))
        .withColumn("count_mentions", F.col("count_trials"))
        .drop("n")
    )
    evidence = None
    if evidence_limit:
        sources = rows.withColumn("member", F.col("bin").cast("string"))
        evidence = bucket_evidence(sources, wanted, ["bin"], evidence_limit)
    undated_last = F.when(F.col("bin") < 0, len(edges)).otherwise(F.col("bin"))
    return with_evidence(buckets, evidence, ["bin"]).orderBy(undated_last).drop("bin")


def _also(spec, column: str):
    """``spec`` with one more column carried along."""
    return replace(spec, columns=tuple(dict.fromkeys((*spec.columns, column))))
