"""Trials stored one row per trial, bucketed and sorted by id.

Bucketing by ``nct_id`` is paid once, when rows arrive. From then on counts of
distinct trials, joins of claims with their records and further batches need no
shuffle of the stored rows: a batch is shuffled to the buckets it belongs to
and meets them in a merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.dates import ct_year
from trialspark.sources.reader import dedupe_trials

BUCKETS = 200


def store_trials(trials: DataFrame, table: str, path: str, *, order_column: str | None = None, buckets: int = BUCKETS, unique_ids: bool = False) -> DataFrame:
    """Write ``trials`` as a bucketed, sorted table in ``path`` and return it; rows without an id drop out.

    Repeated ids are reduced to the first by ``order_column``, unless
    ``unique_ids`` says that there are none.
    """
    rows = trials.filter(F.col("nct_id").isNotNull()) if unique_ids else dedupe_trials(trials, order_column)
    # One task per bucket, so that a bucket is one sorted file.
    placed = rows.repartition(buckets, "nct_id")
    placed.write.bucketBy(buckets, "nct_id").sortBy("nct_id").option("path", path).format("parquet").saveAsTable(table)
    return trials.sparkSession.table(table)


def open_trials(spark: SparkSession, table: str, path: str, schema, buckets: int = BUCKETS) -> DataFrame:
    """A stored table in a session that does not know it yet."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (nct_id) SORTED BY (nct_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def merge_trials(stored: DataFrame, batch: DataFrame, order_column: str | None = None) -> DataFrame:
    """``stored`` with the rows of ``batch``, still one row per trial: the first by ``order_column``, then by content.

    Only the batch is shuffled. Store the result under a new name, in the same
    number of buckets, and drop the old table once nothing reads it.
    """
    order = [c for c in (order_column,) if c] + [c for c in stored.columns if c not in ("nct_id", order_column)]
    new = dedupe_trials(batch.select(*stored.columns), order_column)

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("nct_id", F.struct(*order).alias(name))

    both = packed(stored, "_own").join(packed(new, "_new"), "nct_id", "full")
    merged = both.select("nct_id", F.coalesce(F.least("_own", "_new"), "_own", "_new").alias("_row"))
    return merged.select(*[F.col("nct_id") if c == "nct_id" else F.col(f"_row.`{c}`").alias(c) for c in stored.columns])


# --- by start year --------------------------------------------------------------------

YEAR_PART = "start_year_part"
# The folder of years that no filter can name.
_OTHER_YEARS = 0


def store_by_year(trials: DataFrame, path: str) -> DataFrame:
    """Write ``trials`` in a folder per start year, so that a year range reads its own folders only.

    A start date is text of any precision and its year cannot be pushed to a
    scan; the folder's year can. Dates without a year have a folder of their
    own, and so have years outside the range that filters accept, however many
    they are. Hot years are spread over tasks by id.
    """
    year = ct_year(F.col("start_date"))
    low, high = fixed.YEAR_FENCE
    part = F.when(year.between(low, high), year).when(year.isNotNull(), F.lit(_OTHER_YEARS)).cast("int")
    trials.withColumn(YEAR_PART, part).write.partitionBy(YEAR_PART).parquet(path)
    return read_by_year(trials.sparkSession, path)


def read_by_year(spark: SparkSession, path: str) -> DataFrame:
    """The stored trials, their ``start_year_part`` as a last column that :func:`filter_trials` uses."""
    return spark.read.parquet(path)


def year_folders(start: int | None, end: int | None) -> Column:
    """The folders that can hold trials of a year range; what they hold is still to be filtered."""
    part = F.col(YEAR_PART)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (part >= start)
    if end is not None:
        inside = inside & (part <= end)
    # Years beyond the accepted ones match where the range is open.
    return inside if start is not None and end is not None else inside | (part == _OTHER_YEARS)
