"""Study sources: scan, flatten, validate ids, and reduce to one row per trial."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from trialspark import fixed_values as fixed
from trialspark.sources.schema import INTERVENTION, LENIENT_STUDY, STUDY

_SECTION = "protocolSection"


def read_studies(spark: SparkSession, path: str, source: str = "json") -> DataFrame:
    """Nested study records from JSON lines or Parquet, under the declared schema.

    A record is never an error: fields of the wrong shape read as null, a bare
    string where a list belongs reads as a list of one, an element of the wrong
    kind drops out of its list, and lines that hold no study drop out.
    """
    if source == "json":
        # Only JSON sources can have mixed shapes; columnar files carry a schema.
        return _lenient(spark.read.schema(LENIENT_STUDY).option("mode", "PERMISSIVE").json(path))
    if source in ("parquet", "orc"):
        return spark.read.schema(STUDY).format(source).load(path).filter(F.col(_SECTION).isNotNull())
    raise ValueError(f"unknown study source {source!r}; known: json, orc, parquet")


def parse_studies(lines: DataFrame, column: str, *carried: str) -> DataFrame:
    """Nested study records from a column of JSON text, as :func:`read_studies` reads a file of them."""
    parsed = F.from_json(column, LENIENT_STUDY, {"mode": "PERMISSIVE"})[_SECTION].alias(_SECTION)
    return _lenient(lines.select(*carried, parsed), *carried)


def _lenient(studies: DataFrame, *carried: str) -> DataFrame:
    return studies.filter(F.col(_SECTION).isNotNull()).select(
        *carried,
        F.col(_SECTION)
        .withField("designModule", _with(f"{_SECTION}.designModule", "phases", _text_list))
        .withField(
            "armsInterventionsModule",
            _with(f"{_SECTION}.armsInterventionsModule", "interventions", _interventions),
        )
        .withField(
            "contactsLocationsModule",
            _with(f"{_SECTION}.contactsLocationsModule", "locations", _locations),
        )
        .alias(_SECTION),
    )


def _with(struct: str, field: str, build) -> Column:
    column = F.col(struct)
    return F.when(column.isNotNull(), column.withField(field, build(column[field])))


def _text_list(text: Column) -> Column:
    """JSON text of a list, or a bare string standing for a list of one."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
        text.isNotNull() & (text != ""), F.array(text)
    )


def _interventions(items: Column) -> Column:
    parsed = F.transform(
        items,
        lambda i: F.from_json(i, "struct<type:string,name:string,otherNames:string>"),
    )
    kept = F.filter(parsed, lambda i: i["type"].isNotNull() | i["name"].isNotNull())
    return F.transform(
        kept,
        lambda i: F.struct(
            i["type"].alias("type"),
            i["name"].alias("name"),
            _text_list(i["otherNames"]).alias("otherNames"),
        ),
    ).cast(T.ArrayType(INTERVENTION))


def _locations(items: Column) -> Column:
    parsed = F.transform(items, lambda i: F.from_json(i, "struct<country:string>"))
    return F.filter(parsed, lambda i: i["country"].isNotNull())


# --- flat working form --------------------------------------------------------------

_ID = f"{_SECTION}.identificationModule"
_STATUS = f"{_SECTION}.statusModule"
_LEAD = f"{_SECTION}.sponsorCollaboratorsModule.leadSponsor"

_FLAT_SOURCES = {
    "nct_id": f"{_ID}.nctId",
    "brief_title": f"{_ID}.briefTitle",
    "phases": f"{_SECTION}.designModule.phases",
    "study_type": f"{_SECTION}.designModule.studyType",
    "overall_status": f"{_STATUS}.overallStatus",
    "start_date": f"{_STATUS}.startDateStruct.date",
    "primary_completion_date": f"{_STATUS}.primaryCompletionDateStruct.date",
    "completion_date": f"{_STATUS}.completionDateStruct.date",
    "first_post_date": f"{_STATUS}.studyFirstPostDateStruct.date",
    "last_update_date": f"{_STATUS}.lastUpdatePostDateStruct.date",
    "sponsor_name": f"{_LEAD}.name",
    "sponsor_class": f"{_LEAD}.class",
    "interventions": f"{_SECTION}.armsInterventionsModule.interventions",
    "countries_raw": f"{_SECTION}.contactsLocationsModule.locations.country",
    "conditions": f"{_SECTION}.conditionsModule.conditions",
}


def flatten_studies(studies: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Nested records -> flat working form. Nested pruning keeps the scan narrow."""
    wanted = list(columns or _FLAT_SOURCES)
    return studies.select(*[F.col(_FLAT_SOURCES[name]).alias(name) for name in wanted])


def nest_studies(trials: DataFrame) -> DataFrame:
    """Flat working form -> nested records, the inverse of :func:`flatten_studies`."""
    return trials.select(
        F.struct(
            F.struct(F.col("nct_id").alias("nctId"), F.col("brief_title").alias("briefTitle")).alias(
                "identificationModule"
            ),
            F.struct("phases", F.col("study_type").alias("studyType")).alias("designModule"),
            F.struct(
                F.col("overall_status").alias("overallStatus"),
                *[
                    F.struct(F.col(column).alias("date")).alias(f"{alias}Struct")
                    for alias, column in fixed.DATE_COLUMNS.items()
                ],
            ).alias("statusModule"),
            F.struct(
                F.struct(
                    F.col("sponsor_name").alias("name"), F.col("sponsor_class").alias("class")
                ).alias("leadSponsor")
            ).alias("sponsorCollaboratorsModule"),
            F.struct("interventions").alias("armsInterventionsModule"),
            F.struct("conditions").alias("conditionsModule"),
            F.struct(
                F.transform("countries_raw", lambda c: F.struct(c.alias("country"))).alias("locations")
            ).alias("contactsLocationsModule"),
        ).alias(_SECTION)
    )


def read_trials(
    spark: SparkSession, path: str, source: str = "json", columns: Iterable[str] | None = None
) -> DataFrame:
    """Scan studies and return the flat working form."""
    return flatten_studies(read_studies(spark, path, source), columns)


# --- identity -----------------------------------------------------------------------


def is_valid_nct_id(nct_id: Column) -> Column:
    """Exactly ``NCT`` and eight ASCII digits."""
    return F.coalesce(nct_id.rlike(fixed.NCT_ID_PATTERN), F.lit(False))


def split_valid_ids(trials: DataFrame, id_column: str = "nct_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a well-formed id, quarantined rows)."""
    valid = is_valid_nct_id(F.col(id_column))
    return trials.filter(valid), trials.filter(~valid)


def dedupe_trials(trials: DataFrame, order_column: str | None = None) -> DataFrame:
    """One row per trial: the first in walk order. Rows without an id drop out.

    Tables have no walk order, so ``order_column`` names it. Ties (and the
    default, no order) fall to the smallest row content, so the result does not
    depend on how the data is partitioned. Project first: only the columns
    still present travel through the shuffle.
    """
    known = trials.filter(F.col("nct_id").isNotNull())
    if trials.columns == ["nct_id"]:
        return known.distinct()
    return first_row(known, ["nct_id"], order_column)


def first_row(rows: DataFrame, keys: Sequence[str], order_column: str | None = None) -> DataFrame:
    """The first row of each key by ``order_column``, then by content, nulls first.

    Every task keeps one row of a key ahead of the shuffle, so a key that
    repeats without end costs a row per task.
    """
    order = [c for c in (order_column,) if c] + [c for c in rows.columns if c not in (*keys, order_column)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
