"""Evidence: a bounded, deterministic sample of supporting records per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.paths import title_excerpt
from trialspark.operators.fields import FieldSpec
from trialspark.session import BROADCAST_ROWS, cut_lineage
from trialspark.sources.schema import CITATION

# A hot bucket's candidates meet in this many tasks before they meet in one.
_MERGE_GROUPS = 64
# Ids from which the cuts of hot buckets are taken.
_CUT_SAMPLE = 1 << 16


def first_per_bucket(rows: DataFrame, bucket: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows of each bucket with the smallest ``nct_id``.

    Each scan task keeps k rows per bucket ahead of the shuffle (a partial
    window group limit). Those meet by groups of scan tasks, k rows per group
    survive, and only they meet in the bucket's own task. The choice of group
    does not affect which rows win.
    """
    groups = Window.partitionBy(*bucket, "_group").orderBy("nct_id")
    final = Window.partitionBy(*bucket).orderBy("nct_id")
    return (
        rows.withColumn("_group", F.spark_partition_id() % _MERGE_GROUPS)
        .withColumn("_place", F.row_number().over(groups))
        .filter(F.col("_place") <= k)
        .withColumn("_place", F.row_number().over(final))
        .filter(F.col("_place") <= k)
        .drop("_group", "_place")
    )


def near_rows(rows: DataFrame, ids: DataFrame, bucket: Sequence[str], k: int) -> DataFrame:
    """``rows`` without those that cannot be among the ``k`` of their bucket with the smallest ``nct_id``.

    ``ids`` are the ids of a stored table that ``rows`` come from. Buckets with k
    rows in a small beginning of the table have their sample there, so the rest
    of them never reaches a sort; all other buckets keep all rows.
    """
    cuts = id_cuts(ids, k)
    if not cuts:
        return rows
    cut = cuts[max(0, len(cuts) - 3)]
    counted = rows.filter(F.col("nct_id") <= cut).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    keys = [F.col(c).alias(f"_full{i}") for i, c in enumerate(bucket)]
    full = cut_lineage(counted.filter(F.col("n") >= k).select(*keys, F.lit(True).alias("_full")), "full")
    if not 0 < full.count() <= BROADCAST_ROWS:
        return rows
    same = [F.col(c).eqNullSafe(F.col(f"_full{i}")) for i, c in enumerate(bucket)]
    needed = F.col("_full").isNull() | F.col("nct_id").isNull() | (F.col("nct_id") <= cut)
    return rows.join(F.broadcast(full), same, "left").filter(needed).select(*rows.columns)


def id_cuts(ids: DataFrame, k: int, column: str = "nct_id") -> list[str]:
    """Ids that split a table into ever smaller beginnings, each a quarter of the next, smallest first.

    Taken from a bounded sample drawn by a hash of the id; the first is where
    ``k`` rows of the whole table, or of the sample's grain, end.
    """
    count = ids.count()
    share = min(1.0, _CUT_SAMPLE / count) if count else 1.0
    drawn = ids.filter(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < share * (1 << 30))
    places, place = [], max(1, int(k * share))
    while place < _CUT_SAMPLE:
        places.append(place)
        place *= 4
    row = drawn.agg(F.array_sort(F.collect_list(column)).alias("ids")).select(*[F.get("ids", p - 1) for p in places]).first()
    return [cut for cut in row if cut is not None]


def below_cut(cuts: Sequence[str], k: int, column: str = "nct_id") -> tuple[list[Column], Column, Column]:
    """Aggregates that find where the ``k`` smallest ids of a bucket end, for the pass that counts it.

    (the aggregates, ``until``, ``below``): rows of a bucket with ids up to
    ``until`` are ``below`` rows and hold its ``k`` smallest; no ``until``, no cut.
    """
    counted = [F.count_if(F.col(column) <= cut).alias(f"_until{i}") for i, cut in enumerate(cuts)]
    until, below = F.lit(None).cast("string"), F.lit(None).cast("long")
    for i, cut in reversed(list(enumerate(cuts))):
        until = F.when(F.col(f"_until{i}") >= k, F.lit(cut)).otherwise(until)
        below = F.when(F.col(f"_until{i}") >= k, F.col(f"_until{i}")).otherwise(below)
    return counted, until.alias("until"), below.alias("below")


def citation(
    path: Column | str,
    value: Column,
    is_array: bool,
    matched: Column,
    tokens: Column | None = None,
    title: Column | None = None,
) -> Column:
    """A citation struct for the current row."""
    title = F.col("brief_title") if title is None else title
    return F.struct(
        F.col("nct_id").alias("nct_id"),
        title_excerpt(title, matched).alias("excerpt"),
        (F.lit(path) if isinstance(path, str) else path).alias("field_path"),
        value.alias("value"),
        F.lit(is_array).alias("is_array"),
        matched.alias("matched_value"),
        (F.lit(None).cast("array<string>") if tokens is None else tokens).alias("matched_tokens"),
    ).cast(CITATION)


def cite(spec: FieldSpec, member: str = "member") -> Column:
    """Citation of a bucket's member value by the current record.

    Where the record has no value, the bucket is one of absence: nothing is
    quoted, against nothing.
    """
    value = F.col(member)
    if spec.mode == "explode":
        absent = value == fixed.UNKNOWN
        empty = F.array().cast("array<string>")
        return citation(
            spec.path,
            F.when(absent, empty).otherwise(spec.evidence()),
            spec.is_list,
            F.when(absent, F.lit("")).otherwise(spec.matched(value)),
        )
    return citation(
        spec.path, spec.evidence(), spec.is_list, spec.matched(value), spec.tokens(value)
    )


def collect_citations(sampled: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """Sampled rows with a ``citation`` -> one row per bucket; at most k citations each."""
    packed = F.sort_array(F.collect_list("citation"))
    return (
        sampled.groupBy(*bucket)
        .agg(packed.alias("citations"))
        .withColumn("source_ids", F.col("citations.nct_id"))
    )


def bucket_evidence(
    rows: DataFrame,
    spec: FieldSpec,
    bucket: Sequence[str] = ("value",),
    k: int = fixed.EVIDENCE_LIMIT,
    ids: DataFrame | None = None,
) -> DataFrame:
    """``citations`` and ``source_ids`` per bucket; with ``ids`` by way of :func:`near_rows`.

    ``rows`` holds one row per (bucket, trial): the bucket columns, ``member``
    (the value to quote), ``nct_id``, ``brief_title`` and the field's columns.
    """
    sampled = first_per_bucket(rows if ids is None else near_rows(rows, ids, bucket, k), bucket, k)
    return collect_citations(sampled.withColumn("citation", cite(spec)), bucket)


def with_evidence(counts: DataFrame, evidence: DataFrame | None, bucket: Sequence[str]) -> DataFrame:
    """Bucket counts joined with their evidence; the counts stay exact."""
    empty_ids = F.array().cast("array<string>")
    empty = F.array().cast(f"array<{CITATION.simpleString()}>")
    if evidence is None:
        joined = counts.withColumn("citations", empty).withColumn("source_ids", empty_ids)
    else:
        joined = counts.join(evidence, list(bucket), "left")
    return (
        joined.withColumn("citations", F.coalesce("citations", empty))
        .withColumn("source_ids", F.coalesce("source_ids", empty_ids))
        .withColumn("contributing_count", F.col("count_trials"))
        .withColumn("citations_truncated", F.col("count_trials") > F.size("citations"))
    )


def citations_index(rows: DataFrame, position: Column) -> DataFrame:
    """One citation per trial over a whole result: the first seen, by ``position``.

    ``position`` is the order of the result's rows; inside a row the sample
    order decides.
    """
    seen = rows.select(position.alias("row_position"), F.posexplode("citations").alias("place", "citation"))
    seen = seen.select(F.col("citation.nct_id").alias("nct_id"), "row_position", "place", "citation")
    first = F.row_number().over(Window.partitionBy("nct_id").orderBy("row_position", "place", "citation"))
    return seen.withColumn("_first", first).filter(F.col("_first") == 1).drop("_first")
