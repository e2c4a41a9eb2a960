"""Counting trials per bucket: totals, distributions, the tail fold, per-token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.names import title_case
from trialspark.operators.evidence import bucket_evidence, citation, collect_citations, first_per_bucket, with_evidence
from trialspark.operators.fields import FIELDS, FieldSpec, field_spec
from trialspark.session import cut_lineage
from trialspark.sources.reader import dedupe_trials, first_row

FROM_SPEC = -1


# --- totals -------------------------------------------------------------------------


def count_trials(trials: DataFrame, unique_ids: bool = False) -> DataFrame:
    """One row: the exact number of distinct trials, which every result reconciles to.

    With ``unique_ids`` it is a plain count and shuffles nothing but partial counts.
    """
    total = F.count("nct_id") if unique_ids else F.count_distinct("nct_id")
    return trials.agg(total.alias("count_trials"))


def single_value(trials: DataFrame, evidence_limit: int = fixed.EVIDENCE_LIMIT, unique_ids: bool = False) -> DataFrame:
    """One card row: the count, its label, the yes/no text and a sample of members.

    The sample is the trials with the smallest ids. With ``unique_ids`` each task
    keeps its own smallest ones and nothing else is shuffled; else ids are made
    distinct first, without their titles. A count of zero is a result like any other.
    """
    path = fixed.FIELD_PATHS["nctId"]
    rows = trials.filter(F.col("nct_id").isNotNull()).select("nct_id", "brief_title")
    if unique_ids:
        sample = rows.orderBy("nct_id").limit(evidence_limit)
    else:
        ids = rows.select("nct_id").distinct().orderBy("nct_id").limit(evidence_limit)
        sample = rows.join(F.broadcast(ids), "nct_id").groupBy("nct_id").agg(F.min("brief_title").alias("brief_title"))
    cited = sample.select(
        citation(path, F.array("nct_id"), False, F.col("nct_id")).alias("citation")
    )
    packed = cited.agg(F.sort_array(F.collect_list("citation")).alias("citations"))
    total = F.col("count_trials")
    grouped = F.format_number(total, 0)
    answer = F.when(total == 0, "No trials match this query.").otherwise(
        F.concat(
            F.lit("Yes — "), grouped, F.when(total == 1, " trial").otherwise(" trials"), F.lit(" match this query.")
        )
    )
    return packed.select("citations", count_trials(trials, unique_ids).scalar().alias("count_trials")).select(
        total.cast("string").alias("value"),
        F.concat(grouped, F.lit(" trials")).alias("label"),
        total,
        total.alias("contributing_count"),
        F.col("citations.nct_id").alias("source_ids"),
        "citations",
        (F.size("citations") < total).alias("citations_truncated"),
        answer.alias("answer"),
    )


# --- keyed rows -----------------------------------------------------------------------


def keyed_rows(
    trials: DataFrame,
    spec: FieldSpec,
    by: Sequence[str] = (),
    unique_ids: bool = False,
    order_column: str | None = None,
) -> DataFrame:
    """``by``, ``nct_id``, ``values`` (the trial's bucket values) and what evidence needs.

    Combine fields put a trial into one bucket, so it is reduced to one row
    first; only the columns used here travel through that shuffle. Titles and
    field columns are pruned from any plan that only counts.
    """
    order = [order_column] if order_column else []
    kept = dict.fromkeys([*by, "nct_id", *order, "brief_title", *spec.columns])
    rows = trials.select(*[c for c in kept if c in trials.columns])
    if "brief_title" not in rows.columns:
        rows = rows.withColumn("brief_title", F.lit(None).cast("string"))
    if spec.mode == "explode":
        found = rows.withColumn("_found", spec.key())
        values = F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.lit(fixed.UNKNOWN)))
        return found.withColumn("values", values).drop("_found")
    rows = rows.filter(F.col("nct_id").isNotNull())
    if not unique_ids:
        rows = first_row_per_trial(rows, by, order_column)
    return rows.withColumn("values", F.array(spec.key()))


def first_row_per_trial(rows: DataFrame, keys: Sequence[str], order_column: str | None) -> DataFrame:
    """One row per (keys, trial), the first in walk order. Rows without an id drop out."""
    if not keys:
        return dedupe_trials(rows, order_column)
    return first_row(rows.filter(F.col("nct_id").isNotNull()), [*keys, "nct_id"], order_column)


def bucket_rows(rows: DataFrame, fold: Column | None = None) -> DataFrame:
    """One row per (trial, bucket): ``value``, ``member`` and ``mentions``.

    With ``fold``, an array of the values that keep a bucket of their own, all
    other values of a trial become one row of "Other", quoted by the first of
    them in the trial's list.
    """
    if fold is None:
        # Never empty, so the outer form drops nothing; the plain form would add a
        # not-empty filter that computes the values a second time.
        exploded = rows.select("*", F.explode_outer("values").alias("value")).drop("values")
        return exploded.select("*", F.col("value").alias("member"), F.lit(1).alias("mentions"))
    marked = rows.withColumn("_kept", F.array_intersect("values", fold)).withColumn(
        "_tail", F.array_except("values", fold)
    )

    def entry(value: Column, member: Column, mentions: Column) -> Column:
        return F.struct(value.alias("value"), member.alias("member"), mentions.alias("mentions"))

    own = F.transform("_kept", lambda v: entry(v, v, F.lit(1)))
    other = F.array(entry(F.lit(fixed.OTHER), F.get("_tail", 0), F.size("_tail")))
    buckets = F.when(F.size("_tail") > 0, F.concat(own, other)).otherwise(own)
    return marked.select("*", F.inline_outer(buckets)).drop("values", "_kept", "_tail")


def count_buckets(rows: DataFrame, spec: FieldSpec, by: Sequence[str] = (), unique_ids: bool = False) -> DataFrame:
    """Distinct trials and mentions per bucket, pre-aggregated ahead of each shuffle."""
    distinct = spec.mode == "combine" or unique_ids
    trials = F.count("nct_id") if distinct else F.count_distinct("nct_id")
    return rows.groupBy(*by, "value").agg(
        trials.alias("count_trials"), F.sum("mentions").alias("count_mentions")
    )


# --- distribution -----------------------------------------------------------------------


def distribution(
    trials: DataFrame,
    field: str | FieldSpec,
    *,
    unique_ids: bool = False,
    order_column: str | None = None,
    top_n: int | None = FROM_SPEC,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
    by: Sequence[str] = (),
    inline_members: bool = False,
    sort: bool = True,
    stored: bool = False,
) -> DataFrame:
    """Trials per bucket of a field, labelled, ordered, folded and cited.

    Parameters
    ----------
    unique_ids
        The table is known to hold one row per trial. Saves the reduction.
    order_column
        Names the walk order when it is not unique; the first row wins.
    top_n
        Keep that many real buckets and fold the rest; ``None`` keeps all. The
        default is the field's own.
    evidence_limit
        Citations per bucket; 0 leaves them out, and with them a second scan.
    by
        Extra leading group columns (the arms of a comparison).
    inline_members
        List the folded values on the "Other" row, for a field whose vocabulary
        is small. Otherwise :func:`fold_members` is the table of them.
    stored
        The trials are a table that is cheap to read: two more short passes keep
        the evidence of hot buckets from being sorted. A fold makes them anyway.
    """
    spec = field_spec(field)
    top_n = spec.top_n if top_n == FROM_SPEC else top_n
    rows = keyed_rows(trials, spec, by, unique_ids, order_column)
    if top_n is None:
        exploded = bucket_rows(rows)
        counts = count_buckets(exploded, spec, by, unique_ids)
        buckets = counts.select(
            "*",
            spec.label(F.col("value")).alias("label"),
            F.lit(False).alias("derived"),
            F.lit(None).cast("array<string>").alias("members"),
        )
    else:
        # Stored: the values of a trial are made once, not in each of the passes below.
        rows = cut_lineage(rows, "keyed")
        # Stored: the kept values, the folded ones and their number all come from it.
        every = cut_lineage(count_buckets(bucket_rows(rows), spec, by, unique_ids), "buckets")
        exploded = bucket_rows(rows, _own_bucket(every, top_n, by))
        # Kept values have their counts; only the trials of the tail are counted again.
        other = count_buckets(exploded.filter(F.col("value") == fixed.OTHER), spec, by, unique_ids)
        own = F.array_contains(_own_bucket(every, top_n, by), F.col("value")) & (F.col("value") != fixed.OTHER)
        counts = every.filter(own).unionByName(other)
        buckets = _label_folded(counts, every, spec, top_n, by, inline_members)
    evidence = None
    if evidence_limit:
        repeated = spec.mode == "explode" and not unique_ids
        sources = first_row_per_trial(exploded, [*by, "value"], order_column) if repeated else exploded
        ids = trials.select("nct_id") if (stored or top_n is not None) and not repeated else None
        evidence = bucket_evidence(sources, spec, [*by, "value"], evidence_limit, ids)
    result = with_evidence(buckets, evidence, [*by, "value"])
    return result.orderBy(*by, *spec.order()) if sort else result


def with_position(buckets: DataFrame, field: str | FieldSpec, by: Sequence[str] = ()) -> DataFrame:
    """Number the buckets in their display order, from 0.

    For bucket tables only: they are as large as the field's vocabulary (or as
    the fold leaves them), never as large as the data.
    """
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*field_spec(field).order())
    return buckets.withColumn("position", F.row_number().over(window) - 1)


# --- top-N and "Other" --------------------------------------------------------------------


def _sentinel() -> Column:
    return F.col("value").isin(*fixed.SENTINELS)


def kept_values(counts: DataFrame, top_n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``top_n`` real values by count, then name; per group when there are groups."""
    real = counts.filter(~_sentinel())
    order = [F.col("count_trials").desc(), F.col("value").asc()]
    if not by:
        return real.orderBy(*order).limit(top_n).select("value")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return real.withColumn("_place", place).filter(F.col("_place") <= top_n).select(*by, "value")


def _own_bucket(counts: DataFrame, top_n: int, by: Sequence[str]) -> Column:
    """Array of the values that keep a bucket, for the current row's group.

    A scalar subquery of at most top_n values per arm, so the fold itself is a
    narrow step over the trials: no join, no shuffle.
    """
    kept = kept_values(counts, top_n, by)
    sentinels = F.array(*[F.lit(s) for s in fixed.SENTINELS])
    if not by:
        return F.concat(kept.agg(F.collect_list("value")).scalar(), sentinels)
    per_group = kept.groupBy(F.struct(*by).alias("g")).agg(F.collect_list("value").alias("v"))
    table = per_group.agg(F.map_from_entries(F.collect_list(F.struct("g", "v")))).scalar()
    own = F.try_element_at(table, F.struct(*by))
    return F.concat(F.coalesce(own, F.array().cast("array<string>")), sentinels)


def fold_members(counts: DataFrame, top_n: int, by: Sequence[str] = ()) -> DataFrame:
    """The folded values with their counts, as a table of any size."""
    return counts.filter(~F.array_contains(_own_bucket(counts, top_n, by), F.col("value")))


def _label_folded(counts, every, spec, top_n, by, inline_members) -> DataFrame:
    """Label the buckets; "Other" says how many values it holds, and lists them."""
    ranked = F.struct((-F.col("count_trials")).alias("n"), F.col("value").alias("v"))
    listed = F.transform(F.sort_array(F.collect_list(ranked)), lambda m: m["v"])
    own = F.array_contains(_own_bucket(every, top_n, by), F.col("value"))
    bucket = F.when(own, F.col("value")).otherwise(F.lit(fixed.OTHER))
    folded = every.groupBy(*by, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("_folded"),
        (listed if inline_members else F.lit(None).cast("array<string>")).alias("_members"),
    )
    folded = folded.withColumnRenamed("bucket", "value")
    other = F.col("value") == fixed.OTHER
    label = F.when(other, F.format_string(f"Other (%d {spec.noun})", "_folded")).otherwise(
        spec.label(F.col("value"))
    )
    return counts.join(folded, [*by, "value"], "left").select(
        *by,
        "value",
        "count_trials",
        "count_mentions",
        label.alias("label"),
        other.alias("derived"),
        F.when(other, F.col("_members")).alias("members"),
    )


# --- exact counts per known token -----------------------------------------------------------


def token_counts(
    trials: DataFrame,
    field: str | FieldSpec,
    *,
    unique_ids: bool = False,
    order_column: str | None = None,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
) -> DataFrame:
    """One row per known token with at least one trial, in alphabetical order.

    Labels are plain title case. A single-valued field gets a derived "Missing"
    row for the trials that carry no known token, so the rows still add up.
    """
    spec = field_spec(field)
    if spec.known_tokens is None:
        known = sorted(name for name, s in FIELDS.items() if s.known_tokens)
        raise ValueError(f"{spec.alias} has no closed token set; choose one of {known}")
    rows = bucket_rows(keyed_rows(trials, spec, (), unique_ids, order_column))
    # A value that was made up for an absent field is not a token of the record.
    recorded = F.array_contains(spec.evidence(), F.col("value"))
    known = recorded & F.col("value").isin(*spec.known_tokens)
    if spec.mode == "combine":
        rows = rows.withColumn("value", F.when(known, F.col("value")))
    else:
        rows = rows.filter(known)
    # Stored: a row per token, read for the tokens and for the residual.
    counts = cut_lineage(count_buckets(rows, spec, (), unique_ids), "tokens").withColumn("count_mentions", F.col("count_trials"))
    tokens = counts.filter(F.col("value").isNotNull()).select(
        "*", title_case(F.col("value")).alias("label"), F.lit(False).alias("derived")
    )
    evidence = None
    if evidence_limit:
        sources = rows.filter(F.col("value").isNotNull())
        if not unique_ids and spec.mode == "explode":
            sources = first_row_per_trial(sources, ["value"], order_column)
        sampled = first_per_bucket(sources, ["value"], evidence_limit)
        quoted = citation(spec.path, spec.evidence(), spec.is_list, F.col("member"))
        evidence = collect_citations(sampled.withColumn("citation", quoted), ["value"])
    result = with_evidence(tokens, evidence, ["value"])
    if spec.mode == "combine":
        residual = counts.filter(F.col("value").isNull() & (F.col("count_trials") > 0)).select(
            F.lit("Missing").alias("value"),
            "count_trials",
            "count_mentions",
            F.lit(fixed.MISSING_LABEL).alias("label"),
            F.lit(True).alias("derived"),
        )
        residual = with_evidence(residual, None, ["value"]).withColumn("citations_truncated", F.lit(False))
        result = result.unionByName(residual)
    return result.orderBy("derived", "value")


# --- summaries and gates --------------------------------------------------------------------


def count_basis(buckets: DataFrame, distinct_trials: int | None = None) -> DataFrame:
    """One row: the trial total (the anchor, else the sum of bars) and the mention total."""
    trials = F.lit(distinct_trials) if distinct_trials is not None else F.coalesce(F.sum("count_trials"), F.lit(0))
    return buckets.agg(trials.cast("long").alias("trials"), F.sum("count_mentions").alias("mentions"))


def group_summary(
    trials: DataFrame, field: str | FieldSpec, *, unique_ids: bool = False, order_column: str | None = None
) -> DataFrame:
    """One row: distinct trials (the anchor), sum of bars, mentions and number of buckets."""
    spec = field_spec(field)
    rows = bucket_rows(keyed_rows(trials, spec, (), unique_ids, order_column))
    buckets = count_buckets(rows, spec, (), unique_ids)
    totals = buckets.agg(
        F.coalesce(F.sum("count_trials"), F.lit(0)).alias("sum_trials"),
        F.coalesce(F.sum("count_mentions"), F.lit(0)).alias("mentions"),
        F.count(F.lit(1)).alias("buckets"),
    )
    return totals.select(
        count_trials(trials, unique_ids).scalar().alias("distinct_trials"), "sum_trials", "mentions", "buckets"
    )


def population_gate(trials: DataFrame, unique_ids: bool = False) -> DataFrame:
    """One row: the exact total, and ``empty`` or ``ok``. No population is too large to chart."""
    total = F.col("count_trials")
    status = F.when(total == 0, "empty").otherwise("ok")
    return count_trials(trials, unique_ids).select(total.alias("of_total"), status.alias("status"))


def partial_note(distinct: Column, total: Column, truncated: Column) -> Column:
    """True only when the input was cut short and trials really are missing."""
    return truncated & (distinct < total)
