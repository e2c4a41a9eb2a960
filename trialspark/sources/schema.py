"""Schemas: the nested study record, the flat study table, and result tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOLEAN = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INTERVENTION = struct(type=STRING, name=STRING, otherNames=STRINGS)


def _study(phases: T.DataType, intervention: T.DataType, location: T.DataType) -> T.StructType:
    date = struct(date=STRING)
    return struct(
        protocolSection=struct(
            identificationModule=struct(nctId=STRING, briefTitle=STRING),
            designModule=struct(phases=phases, studyType=STRING),
            statusModule=struct(
                overallStatus=STRING,
                startDateStruct=date,
                primaryCompletionDateStruct=date,
                completionDateStruct=date,
                studyFirstPostDateStruct=date,
                lastUpdatePostDateStruct=date,
            ),
            sponsorCollaboratorsModule=struct(leadSponsor=struct(name=STRING, **{"class": STRING})),
            armsInterventionsModule=struct(interventions=T.ArrayType(intervention)),
            conditionsModule=struct(conditions=STRINGS),
            contactsLocationsModule=struct(locations=T.ArrayType(location)),
        )
    )


# The study record as published: one nested document per trial.
STUDY = _study(STRINGS, INTERVENTION, struct(country=STRING))

# The same record with the lists registries fill inconsistently left as JSON
# text, so that one bad element does not void its whole list.
LENIENT_STUDY = _study(STRING, STRING, STRING)

# The flat working form every operator takes.
TRIALS = struct(
    nct_id=STRING,
    brief_title=STRING,
    phases=STRINGS,
    study_type=STRING,
    overall_status=STRING,
    start_date=STRING,
    primary_completion_date=STRING,
    completion_date=STRING,
    first_post_date=STRING,
    last_update_date=STRING,
    sponsor_name=STRING,
    sponsor_class=STRING,
    interventions=T.ArrayType(INTERVENTION),
    countries_raw=STRINGS,
    conditions=STRINGS,
)

CITATION = struct(
    nct_id=STRING,
    excerpt=STRING,
    field_path=STRING,
    value=STRINGS,
    is_array=BOOLEAN,
    matched_value=STRING,
    matched_tokens=STRINGS,
)

# One chart row, whatever the chart. Operators that do not use a channel leave
# it null, so all results share this contract.
RESULT_ROW = struct(
    value=STRING,
    label=STRING,
    period=STRING,
    series=STRING,
    bin_start=DOUBLE,
    bin_end=DOUBLE,
    count_trials=LONG,
    count_mentions=LONG,
    percent=DOUBLE,
    planned=BOOLEAN,
    partial_year=BOOLEAN,
    source_ids=STRINGS,
    citations=T.ArrayType(CITATION),
    citations_truncated=BOOLEAN,
    contributing_count=LONG,
    derived=BOOLEAN,
    members=STRINGS,
)

NODES = struct(id=STRING, label=STRING, kind=STRING, degree=LONG)

EDGES = struct(
    source=STRING, target=STRING, weight=LONG, source_ids=STRINGS, citations=T.ArrayType(CITATION)
)

# One row per stored result, beside its rows (or edges).
RESULT_META = struct(
    result_id=STRING,
    status=STRING,
    chart_type=STRING,
    mode=STRING,
    count_total=LONG,
    distinct_trials=LONG,
    mentions=LONG,
    truncated=BOOLEAN,
    partial=BOOLEAN,
    reconcile=BOOLEAN,
    notes=STRINGS,
)
