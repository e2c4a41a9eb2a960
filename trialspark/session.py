"""Session helpers: cutting lineage on shared storage, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table with at most this many rows may be shipped to every executor.
BROADCAST_ROWS = 200_000
# The same for tables with long texts, whose size is measured.
BROADCAST_BYTES = 32 << 20

# Paths of stored tables, and the tables that read them.
_STORED: dict[str, DataFrame] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Where nothing is set, a
    folder of the warehouse is used, which driver and executors share as well.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each write within as soon as it ends.

    Otherwise they stay on the executors' disks until the driver collects garbage.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from it.

    A lost executor then costs a re-read instead of a recomputation, and later
    steps scan only the columns they need. :func:`drop_table` deletes one of
    these tables, :func:`drop_stored` all.
    """
    return cut_lineages([df], name)


def cut_lineages(parts: list[DataFrame], name: str = "table") -> DataFrame:
    """One table of :func:`cut_lineage` from parts with equal columns, written one after the other.

    Each part's shuffle files are gone before the next part shuffles.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{checkpoint_dir(spark)}/trialspark-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        for part in parts:
            part.write.mode("append").parquet(path)
    _STORED[path] = spark.read.schema(schema).parquet(path)
    return _STORED[path]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(table: DataFrame) -> None:
    """Delete a table of :func:`cut_lineage` that nothing reads any more; leave other tables alone."""
    for path in [p for p, stored in _STORED.items() if stored is table]:
        del _STORED[path]
        _delete(table.sparkSession, path)


def drop_stored(spark: SparkSession) -> int:
    """Delete what :func:`cut_lineage` wrote in this session; results that still read it end.

    Returns the number of tables deleted.
    """
    paths = list(_STORED)
    _STORED.clear()
    for path in paths:
        _delete(spark, path)
    return len(paths)


def broadcast_if_small(df: DataFrame, rows: int, size: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the known row count, and size in bytes, prove ``df`` small.

    Above the limits the join stays a shuffle join, and AQE splits skewed keys.
    Without a ``size`` rows must be narrow: a few ids or keys.
    """
    return F.broadcast(df) if rows <= limit and (size or 0) <= BROADCAST_BYTES else df
