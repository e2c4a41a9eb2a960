"""Stored results: write result rows, graph edges and their meta rows; read them back.

A write is repeatable: every result has a folder per version, and a manifest,
written last, names the version of each result that readers see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from trialspark import fixed_values as fixed
from trialspark.operators.grouping import partial_note
from trialspark.sources.schema import EDGES, RESULT_META, RESULT_ROW, struct

_KINDS = {"rows": RESULT_ROW, "edges": EDGES, "meta": RESULT_META}
MANIFEST = struct(result_id=T.StringType(), version=T.StringType(), number=T.LongType())
#: Rows in one stored file, at most.
FILE_ROWS = 100_000


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; channels it lacks become null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def result_rows(df: DataFrame, result_id: str) -> DataFrame:
    """Any operator's chart rows in the common contract, tagged with a result id."""
    return conform(df, RESULT_ROW).withColumn("result_id", F.lit(result_id))


def result_edges(df: DataFrame, result_id: str) -> DataFrame:
    """Graph edges in the common contract, tagged with a result id."""
    return conform(df, EDGES).withColumn("result_id", F.lit(result_id))


def result_meta(
    rows: DataFrame, result_id: str, *, chart_type: str, mode: str, total: DataFrame, distinct: DataFrame | None = None,
    truncated: bool = False, reconcile: bool = True,
) -> DataFrame:
    """The meta row of a result, from its rows and its exact totals.

    ``total`` is the one-row count of all matching trials, ``distinct`` that of
    the trials counted (the same unless the input was cut short). Notes tell of
    overlapping bars, of a folded tail and of a cut.
    """
    seen = total if distinct is None else distinct
    facts = rows.agg(
        F.coalesce(F.sum("count_mentions"), F.lit(0)).alias("mentions"),
        F.count_if(F.coalesce("derived", F.lit(False))).alias("derived"),
        F.count(F.lit(1)).alias("bars"),
    )
    facts = facts.select("*", total.select("count_trials").scalar().alias("total"), seen.select("count_trials").scalar().alias("seen"))
    cut = F.lit(truncated)
    partial = partial_note(F.col("seen"), F.col("total"), cut)
    notes = F.array_compact(F.array(
        F.when(F.lit(mode == "explode"), F.lit(fixed.OVERLAP_NOTE)),
        F.when(F.col("derived") > 0, F.lit(fixed.FOLD_NOTE)),
        F.when(partial, F.format_string(fixed.CUT_NOTE, "seen", "total")),
    ))
    row = facts.select(
        F.lit(result_id).alias("result_id"), F.when(F.col("total") == 0, "empty").otherwise("ok").alias("status"),
        F.lit(chart_type).alias("chart_type"), F.lit(mode).alias("mode"), F.col("total").alias("count_total"),
        F.col("seen").alias("distinct_trials"), "mentions", cut.alias("truncated"), partial.alias("partial"),
        F.lit(reconcile).alias("reconcile"), notes.alias("notes"),
    )
    return conform(row, RESULT_META)


def write_results(df: DataFrame, path: str, kind: str, version: str = "1") -> None:
    """Write results (tagged with ``result_id``) of one kind: ``rows``, ``edges`` or ``meta``.

    A result's rows lie in a folder of their own, by result and ``version``, and
    replace what an earlier attempt at that version left there. Readers do not
    see them before :func:`commit_results`.
    """
    _known(kind)
    tagged = df.withColumn("version", F.lit(version))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("result_id", "version").parquet(f"{path}/{kind}")


def commit_results(spark: SparkSession, path: str, version: str = "1") -> None:
    """Let readers see the results whose meta rows were written as ``version``; the last step of a write.

    The manifest only grows, by one file per commit, and the commit with the
    highest number is the one that counts: so a write that stops anywhere leaves
    the results as they were, and repeating one changes nothing.
    """
    known = _table(spark, f"{path}/manifest", MANIFEST)
    number = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"] + 1
    meta = spark.read.schema(_partitioned("meta")).parquet(f"{path}/meta").filter(F.col("version") == version)
    rows = meta.select("result_id", "version").distinct().withColumn("number", F.lit(number).cast("long"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def store_results(path: str, rows: DataFrame, meta: DataFrame, edges: DataFrame | None = None, version: str | None = None) -> str:
    """Write results whole and commit them; a retry under the same ``version`` replaces what a failed attempt left."""
    version = version or uuid.uuid4().hex
    write_results(rows, path, "rows", version)
    if edges is not None:
        write_results(edges, path, "edges", version)
    write_results(meta, path, "meta", version)
    commit_results(meta.sparkSession, path, version)
    return version


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(``result_id``, ``version``) that readers see: the last committed version of each result."""
    manifest = _table(spark, f"{path}/manifest", MANIFEST)
    last = manifest.groupBy("result_id").agg(F.max("number").alias("number"))
    return manifest.join(last, ["result_id", "number"]).groupBy("result_id").agg(F.max("version").alias("version"))


def stored_problems(spark: SparkSession, path: str) -> DataFrame:
    """(``result_id``, ``version``, ``kind``, ``problem``): committed files that break the contract.

    Read from the footer of every file, before any schema is laid over it. The
    files are opened in tasks; :data:`FILE_ROWS` bounds their size.
    """
    found = None
    for kind in _KINDS:
        folder = f"{path}/{kind}"
        if not _exists(spark, folder):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        one = files.select("path", "content").mapInArrow(_footer_problems(kind), "path string, problem string").withColumn("kind", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "result_id string, version string, kind string, problem string")

    def named(key: str) -> Column:
        return F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{key}=([^/]*)/", 1), "[+]", "%2B"))

    problems = found.select(named("result_id").alias("result_id"), named("version").alias("version"), "kind", "problem")
    return problems.join(committed(spark, path), ["result_id", "version"], "left_semi").distinct()


def _footer_problems(kind: str):
    schema = T.StructType([f for f in _KINDS[kind].fields if f.name != "result_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    physical = pq.read_schema(pa.BufferReader(content.as_buffer()))
                    problems = differences({f.name: from_arrow_type(f.type).simpleString() for f in physical}, schema)
                except (pa.ArrowInvalid, UnsupportedOperationException) as unreadable:
                    problems = [f"unreadable file: {type(unreadable).__name__}"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(problems), pa.string()), pa.array(problems, pa.string())], ["path", "problem"])

    return run


def read_results(spark: SparkSession, path: str, kind: str, without: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """The committed results of one kind, under the declared contract.

    ``without`` names (result, version) folders that are not opened, as their
    files break it.
    """
    _known(kind)
    table = _table(spark, f"{path}/{kind}", _partitioned(kind))
    for result, version in without:
        table = table.filter(~((F.col("result_id") == result) & (F.col("version") == version)))
    seen = table.join(F.broadcast(committed(spark, path)), ["result_id", "version"], "left_semi")
    order = _KINDS[kind].fieldNames() + ([] if kind == "meta" else ["result_id"])
    return seen.select(*order)


def _known(kind: str) -> None:
    if kind not in _KINDS:
        raise ValueError(f"unknown result kind {kind!r}; known: {sorted(_KINDS)}")


def _partitioned(kind: str) -> T.StructType:
    own = [f for f in _KINDS[kind].fields if f.name != "result_id"]
    return T.StructType([*own, T.StructField("result_id", T.StringType()), T.StructField("version", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; empty before its first write."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def differences(present: dict[str, str], schema: T.StructType) -> list[str]:
    """What columns, given with their types, lack of a schema; empty when they conform."""
    problems = []
    for field in schema.fields:
        expected = field.dataType.simpleString()
        if field.name not in present:
            problems.append(f"missing column {field.name}")
        elif present[field.name] != expected:
            problems.append(f"column {field.name} is {present[field.name]}, expected {expected}")
    return problems


def schema_conforms(df: DataFrame, schema: T.StructType) -> list[str]:
    """Differences between a table's columns and the contract; empty when it conforms."""
    return differences({f.name: f.dataType.simpleString() for f in df.schema.fields}, schema)
