from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from trialspark.sources.schema import TRIALS


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-tests-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        # Plans over a handful of rows: compiling them costs more than running them.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def study_table(spark):
    """Flat study rows from dicts; what a dict leaves out is null."""

    def build(records: list[dict], partitions: int = 3):
        rows = [tuple(r.get(name) for name in TRIALS.fieldNames()) for r in records]
        return spark.createDataFrame(rows, TRIALS).repartition(partitions)

    return build


def nct(number: int) -> str:
    return f"NCT{number:08d}"


def drug(name: str | None, others=None, kind: str | None = "DRUG") -> tuple:
    return (kind, name, others)


def evaluate(spark, column_of, values: list, kind: str = "string") -> list:
    """The column function applied to each value, in order."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    done = rows.select("i", column_of(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(done, key=lambda r: r["i"])]
