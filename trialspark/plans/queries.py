"""The registered queries: every operator over the study table of a data folder.

Each query builds only the study columns it reads. Lists are joined to text so
that a result is made of scalars.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions import dates, names, paths, phases
from trialspark.operators import audit, network
from trialspark.operators.compare import Arm, compare, compare_columns, compare_summary
from trialspark.operators.components import connected_components, merge_components
from trialspark.operators.evidence import citations_index
from trialspark.operators.fields import FIELDS, FieldSpec
from trialspark.operators.filters import filter_columns, filter_trials
from trialspark.operators.grouping import (
    bucket_rows,
    count_basis,
    count_buckets,
    count_trials,
    distribution,
    fold_members,
    group_summary,
    keyed_rows,
    population_gate,
    single_value,
    token_counts,
    with_position,
)
from trialspark.operators.histogram import duration_histogram
from trialspark.operators.series import series_summary, timeseries
from trialspark.session import checkpoint_dir, cut_lineage
from trialspark.sources.adapter import coded_trials_from_orders, nct_id, stored_trials_from_orders, trials_from_orders
from trialspark.sources.layout import merge_trials, store_by_year, store_trials
from trialspark.sources.reader import dedupe_trials, flatten_studies, is_valid_nct_id, nest_studies, parse_studies, split_valid_ids
from trialspark.sources.schema import TRIALS
from trialspark.sources.search_index import build_search_index, search_trials
from trialspark.sources.sink import conform, read_results, result_edges, result_meta, result_rows, store_results, stored_problems, write_results

CURRENT_YEAR = 2000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _trials(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return trials_from_orders(spark, sf_dir, dict.fromkeys(("nct_id", *columns)))


def _stored(trials: DataFrame) -> DataFrame:
    """The derived studies as a stored table, for queries that scan them more than once."""
    return cut_lineage(trials, "trials")


def _for_fields(spark: SparkSession, sf_dir: str, *fields: str, extra: Iterable[str] = ()) -> DataFrame:
    columns = [c for f in fields for c in FIELDS[f].columns]
    return _trials(spark, sf_dir, *columns, *extra)


def _join(values: Column | str, separator: str = ",") -> Column:
    return F.array_join(values, separator)


def _ids(spark: SparkSession, sf_dir: str, filters: dict | None = None, search: dict | None = None) -> DataFrame:
    trials = _trials(spark, sf_dir, *sorted(filter_columns(filters, search)))
    return filter_trials(trials, filters, search).select("nct_id")


# --- sources ----------------------------------------------------------------------------


@query
def study_records(spark, sf_dir):
    """Every study column, through the nested record form and back."""
    studies = nest_studies(trials_from_orders(spark, sf_dir))
    trials = flatten_studies(studies)
    items = F.transform(
        "interventions",
        lambda i: F.concat(i["type"], F.lit(":"), i["name"], F.lit("["), _join(i["otherNames"], "+"), F.lit("]")),
    )
    scalars = [f.name for f in TRIALS.fields if f.dataType.simpleString() == "string"]
    return trials.select(
        *scalars,
        _join("phases", "|").alias("phases"),
        _join(items, ";").alias("interventions"),
        _join("countries_raw", ";").alias("countries"),
        _join("conditions", ";").alias("conditions"),
    )


@query
def nested_source(spark, sf_dir):
    """Study records as JSON text, some damaged: what survives the lenient schema, and its phases."""
    trials = trials_from_orders(spark, sf_dir, ("nct_id", "overall_status", "phases"))
    kind = F.expr("substring(nct_id, 4)").cast("long") % 8
    whole = nest_studies(conform(trials, TRIALS))
    text = whole.select(paths.path_first(fixed.FIELD_PATHS["nctId"]).alias("nct_id"), F.to_json(F.struct("protocolSection")).alias("json"))
    one_phase = F.concat(F.lit('{"protocolSection":{"identificationModule":{"nctId":"'), F.col("nct_id"), F.lit('"},"designModule":{"phases":"PHASE2"}}}'))
    no_list = F.concat(F.lit('{"protocolSection":{"identificationModule":{"nctId":"'), F.col("nct_id"), F.lit('"},"designModule":{"phases":7}}}'))
    line = (
        F.when(kind == 1, "{not json").when(kind == 2, '{"other":1}').when(kind == 3, F.lit(None)).when(kind == 4, one_phase)
        .when(kind == 5, no_list).when(kind == 6, "").otherwise(F.col("json"))
    )
    lines = text.select(kind.alias("kind"), line.alias("line"))
    sent = lines.groupBy("kind").agg(F.count(F.lit(1)).alias("sent"))
    section = "protocolSection"
    read = parse_studies(lines, "line", "kind").select(
        "kind", F.col(f"{section}.identificationModule.nctId").alias("nct_id"), F.col(f"{section}.designModule.phases").alias("phases")
    )
    survived = read.groupBy("kind").agg(F.count("nct_id").alias("survived"), F.count_if(F.array_contains("phases", "PHASE2")).alias("phase2"))
    counted = sent.join(survived, "kind", "left")
    return counted.select("kind", "sent", F.coalesce("survived", F.lit(0)).alias("survived"), F.coalesce("phase2", F.lit(0)).alias("phase2"))


@query
def nested_paths(spark, sf_dir):
    """First-element and every-element reads by JSON path."""
    columns = ("phases", "overall_status", "interventions", "countries_raw", "brief_title", "study_type",
               "sponsor_name", "sponsor_class", "conditions", *fixed.DATE_COLUMNS.values())
    studies = nest_studies(_trials(spark, sf_dir, *columns))
    path = fixed.FIELD_PATHS
    return studies.select(
        paths.path_first(path["nctId"]).alias("nct_id"),
        paths.path_first(path["country"]).alias("first_country"),
        paths.path_first(path["interventionName"]).alias("first_intervention"),
        F.array_join(paths.path_all(path["country"]), ";", "-").alias("all_countries"),
        F.array_join(paths.path_all(path["interventionType"]), ";", "-").alias("all_types"),
        F.array_join(paths.path_all(path["overallStatus"]), ";", "-").alias("all_statuses"),
        F.size(F.get(paths.path_all(path["phase"]), 0)).cast("long").alias("phases"),
    )


@query
def id_validity(spark, sf_dir):
    """Well-formed ids among damaged ones: case, line feed, length, blank, foreign digit."""
    key = F.col("o_orderkey")
    good = nct_id(key)
    damaged = (
        F.when(key % 8 == 1, F.lower(good))
        .when(key % 8 == 2, F.concat(good, F.lit("\n")))
        .when(key % 8 == 3, F.substring(good, 1, 10))
        .when(key % 8 == 4, F.concat(F.lit(" "), good))
        .when(key % 8 == 6, F.concat(F.substring(good, 1, 10), F.lit("９")))
        .otherwise(good)
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("k"), damaged.alias("nct_id"))
    valid, quarantined = split_valid_ids(orders)
    marked = valid.unionByName(quarantined)
    return marked.select("k", is_valid_nct_id(F.col("nct_id")).alias("valid"))


def _with_repeats(trials: DataFrame) -> DataFrame:
    """Repeat a quarter of the rows later in the walk, some of them without an id."""
    number = F.expr("substring(nct_id, 4)").cast("long")
    walk = trials.withColumns({"walk": 2 * number, "repeat": F.lit(False)})
    later = walk.filter(number % 4 == 0).withColumns({"walk": F.col("walk") + 1, "repeat": F.lit(True)})
    return walk.unionByName(
        later.withColumn("nct_id", F.when(number % 28 != 0, F.col("nct_id")))
    )


@query
def first_row_wins(spark, sf_dir):
    """One row per trial, the first in walk order, from a table with repeats."""
    trials = _with_repeats(_trials(spark, sf_dir, "overall_status"))
    changed = trials.withColumn(
        "overall_status", F.when(F.col("repeat"), "WITHDRAWN").otherwise(F.col("overall_status"))
    )
    return dedupe_trials(changed, "walk").select("nct_id", "overall_status")


@query
def stored_trials(spark, sf_dir):
    """The same rows from a bucketed table that got them in two batches, the later rows first."""
    trials = _with_repeats(_trials(spark, sf_dir, "overall_status", "start_date"))
    changed = trials.withColumn("overall_status", F.when(F.col("repeat"), "WITHDRAWN").otherwise(F.col("overall_status")))
    made, folder = f"trials_{uuid.uuid4().hex}", f"{checkpoint_dir(spark)}/stored-trials-{uuid.uuid4().hex}"
    first = store_trials(changed.filter("repeat"), f"{made}_1", f"{folder}/1", order_column="walk", buckets=8)
    merged = merge_trials(first, changed.filter("NOT repeat"), "walk")
    second = store_trials(merged, f"{made}_2", f"{folder}/2", buckets=8, unique_ids=True)
    total = count_trials(second).select("count_trials").scalar()
    return second.select("nct_id", "overall_status", "start_date", total.alias("trials"))


# --- filters ------------------------------------------------------------------------------

_FILTERS = {
    "status": {"overallStatus": "RECRUITING"},
    "interventional": {"interventional_only": True},
    "study_type": {"studyType": "OBSERVATIONAL"},
    "phase": {"phase": ["PHASE1", "EARLY_PHASE1"]},
    "sponsor_class": {"sponsorClass": "INDUSTRY"},
    "intervention_type": {"interventionType": "DEVICE"},
    "years": {"start_year": 1996, "end_year": 1998},
    "since_year": {"start_year": 1999},
    "stacked": {
        "overallStatus": "COMPLETED", "interventional_only": True, "phase": "PHASE2", "sponsorClass": "NIH",
        "interventionType": "DRUG", "end_year": 1999,
    },
}

_SEARCHES = {
    "condition": {"condition": "Promo Dis"},
    "drug": {"drug": "CODE-12"},
    "sponsor": {"sponsor": "merck"},
    "country": {"country": "russia"},
    "term": {"term": "widget, 25MG"},
    "operators_are_text": {"term": "red OR blue"},
}


def _register_filters() -> None:
    for name, filters in _FILTERS.items():
        QUERIES[f"filter_{name}"] = lambda spark, sf_dir, f=filters: _ids(spark, sf_dir, f)
    for name, search in _SEARCHES.items():
        QUERIES[f"search_{name}"] = lambda spark, sf_dir, s=search: _ids(spark, sf_dir, None, s)


_register_filters()


@query
def search_indexed(spark, sf_dir):
    """All searches again, through a stored trigram index; one needle is too short for it."""
    wanted = {**_SEARCHES, "short": {"term": "mg"}}
    columns = set().union(*(filter_columns(None, s) for s in wanted.values()))
    trials = stored_trials_from_orders(spark, sf_dir, dict.fromkeys(("nct_id", *sorted(columns))))
    index = build_search_index(trials, f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
    found = [search_trials(index, trials, s).select(F.lit(name).alias("search"), "nct_id") for name, s in wanted.items()]
    return reduce(DataFrame.unionByName, found)


@query
def filter_years_stored(spark, sf_dir):
    """A closed and an open range over trials in a folder per start year, some years out of the ordinary."""
    trials = _trials(spark, sf_dir, "start_date")
    number = F.expr("substring(nct_id, 4)").cast("long")
    odd = F.when(number % 50 == 0, "12000-01").when(number % 50 == 1, F.lit(None)).when(number % 50 == 2, "no date").otherwise(F.col("start_date"))
    stored = store_by_year(trials.withColumn("start_date", odd), f"{checkpoint_dir(spark)}/trials-by-year-{uuid.uuid4().hex}")
    closed = filter_trials(stored, _FILTERS["years"]).select("nct_id", F.lit("closed").alias("years"))
    return closed.unionByName(filter_trials(stored, _FILTERS["since_year"]).select("nct_id", F.lit("open").alias("years")))


# --- scalar functions -----------------------------------------------------------------------


@query
def date_parts(spark, sf_dir):
    date = F.col("start_date")
    return _trials(spark, sf_dir, "start_date").select(
        "nct_id",
        dates.ct_year(date).alias("year"),
        dates.ct_month(date).alias("month"),
        dates.ct_precision(date).alias("precision"),
        dates.is_future(dates.ct_year(date), CURRENT_YEAR).alias("future"),
    )


@query
def country_names(spark, sf_dir):
    """Raw spellings, their canonical names, and how many trials use each."""
    raw = _trials(spark, sf_dir, "countries_raw").select("nct_id", F.explode("countries_raw").alias("raw"))
    counted = raw.groupBy("raw").agg(F.count_distinct("nct_id").alias("trials"))
    return counted.select(
        "raw",
        names.canonical_country(F.col("raw")).alias("canonical"),
        names.country_alias(F.col("raw")).isNotNull().alias("aliased"),
        "trials",
    )


_PHASE_TEXTS = (
    "Phase 1/2", "phase II", "1-2", "1 and 2", "Early Phase 1", "Phase 0", "N/A", "not applicable", "PHASE3",
    "early phase1", "IV", "phase 5", "II/iii", "Phase 2, Phase 2", "unknown", "Phase-4.",
)


@query
def phase_text(spark, sf_dir):
    """Free phase text to tokens; text that names no phase is rejected."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    texts = F.array(*[F.lit(t) for t in _PHASE_TEXTS])
    text = F.get(texts, (F.col("o_orderkey") % len(_PHASE_TEXTS)).cast("int"))
    listed = orders.select(F.col("o_orderkey").alias("k"), text.alias("text"))
    tokens = phases.normalize_phase_text(F.col("text"))
    return listed.select("k", "text", _join(tokens, "|").alias("tokens"), tokens.isNull().alias("rejected"))


@query
def durations(spark, sf_dir):
    trials = _trials(spark, sf_dir, "start_date", "completion_date")
    months = trials.withColumn("months", dates.duration_months(F.col("start_date"), F.col("completion_date")))
    return months.select("nct_id", "months", dates.bin_index(F.col("months"), fixed.DURATION_BINS).alias("bin"))


@query
def drug_names(spark, sf_dir):
    """Ingredient key, node id and name tests of every distinct intervention name."""
    items = _trials(spark, sf_dir, "interventions").select(F.explode("interventions").alias("i"))
    name = F.col("name")
    return (
        items.groupBy(F.col("i.name").alias("name"))
        .agg(F.max(names.is_placebo(F.col("i.name"), F.col("i.otherNames"))).alias("placebo"))
        .select(
            "name",
            names.drug_key(name).alias("key"),
            network.node_id("drug", names.drug_key(name)).alias("node"),
            "placebo",
            names.is_combination(name).alias("combination"),
        )
    )


@query
def sponsor_names(spark, sf_dir):
    name = F.col("sponsor_name")
    sponsors = _trials(spark, sf_dir, "sponsor_name").filter(name.isNotNull())
    return sponsors.groupBy("sponsor_name").agg(F.count(F.lit(1)).alias("trials")).select(
        "sponsor_name", names.sponsor_key(name).alias("key"),
        network.node_id("sponsor", names.sponsor_key(name)).alias("node"), "trials",
    )


@query
def excerpts(spark, sf_dir):
    """First literal value at a field, and the title or that value as excerpt."""
    matched = paths.first_value(paths.flat_values("phase"))
    return _trials(spark, sf_dir, "brief_title", "phases").select(
        "nct_id", matched.alias("matched"), paths.title_excerpt(F.col("brief_title"), matched).alias("excerpt")
    )


# --- counts ------------------------------------------------------------------------------------


@query
def trial_count(spark, sf_dir):
    return count_trials(_with_repeats(_trials(spark, sf_dir)))


@query
def trial_card(spark, sf_dir):
    """Single value with its evidence."""
    trials = _trials(spark, sf_dir, "overall_status", "brief_title")
    card = single_value(filter_trials(trials, {"overallStatus": "RECRUITING"}), unique_ids=True)
    return card.select(
        "value", "label", "count_trials", _join("source_ids").alias("source_ids"), "citations_truncated", "answer"
    )


@query
def empty_card(spark, sf_dir):
    """A count of zero is a result."""
    trials = _trials(spark, sf_dir, "overall_status", "brief_title")
    card = single_value(filter_trials(trials, {"overallStatus": "WITHHELD"}), unique_ids=True)
    return card.select("value", "label", "count_trials", F.size("citations").alias("cited"), "answer")


@query
def population_gates(spark, sf_dir):
    """The exact total, and whether there is anything to chart."""
    trials = _for_fields(spark, sf_dir, "overallStatus")
    gates = [
        population_gate(trials, unique_ids=True),
        population_gate(filter_trials(trials, {"overallStatus": "WITHHELD"}), unique_ids=True),
    ]
    table = gates[0].withColumn("gate", F.lit(0))
    for place, gate in enumerate(gates[1:], 1):
        table = table.unionByName(gate.withColumn("gate", F.lit(place)))
    return table


def _bars(buckets: DataFrame, field: str) -> DataFrame:
    return with_position(buckets, field).select("position", "value", "label", "count_trials", "count_mentions")


def _register_distributions() -> None:
    for name, field in (
        ("phase", "phase"), ("status", "overallStatus"), ("sponsor_class", "sponsorClass"),
        ("intervention_type", "interventionType"), ("country", "country"),
    ):
        def bars(spark, sf_dir, f=field):
            trials = _for_fields(spark, sf_dir, f)
            trials = _stored(trials) if FIELDS[f].top_n else trials
            return _bars(distribution(trials, f, unique_ids=True, evidence_limit=0, sort=False), f)

        def cited(spark, sf_dir, f=field):
            trials = _stored(_for_fields(spark, sf_dir, f, extra=["brief_title"]))
            return _evidence(distribution(trials, f, unique_ids=True, sort=False, stored=True))

        QUERIES[f"distribution_{name}"] = bars
        QUERIES[f"evidence_{name}"] = cited
    for name, field in (
        ("status", "overallStatus"), ("sponsor_class", "sponsorClass"), ("intervention_type", "interventionType"),
    ):
        def tokens(spark, sf_dir, f=field):
            trials = _for_fields(spark, sf_dir, f, extra=["brief_title"])
            return token_counts(trials, f, unique_ids=True).select(
                "value", "label", "count_trials", "count_mentions", "derived", "citations_truncated",
                _join("source_ids").alias("source_ids"),
            )

        QUERIES[f"token_counts_{name}"] = tokens


def _evidence(buckets: DataFrame, *keys: str) -> DataFrame:
    """The evidence of each bucket as text, with the quotes checked on the way."""
    return buckets.select(
        *(keys or ("value",)),
        "contributing_count",
        "citations_truncated",
        _join("source_ids").alias("source_ids"),
        _join(F.col("citations.matched_value"), ";").alias("matched"),
        _join(F.transform("citations", lambda c: F.coalesce(_join(c["matched_tokens"], "+"), F.lit("-"))), ";").alias("tokens"),
        _join(F.col("citations.excerpt"), ";").alias("excerpts"),
        F.forall("citations", audit.citation_ok).alias("quotes_hold"),
    )


_register_distributions()


@query
def distribution_country_top10(spark, sf_dir):
    """The fold: ten countries, one derived "Other" row of distinct trials, sentinels."""
    trials = _stored(_for_fields(spark, sf_dir, "country"))
    buckets = distribution(trials, "country", unique_ids=True, top_n=10, evidence_limit=0, inline_members=True, sort=False)
    return with_position(buckets, "country").select(
        "position", "value", "label", "count_trials", "count_mentions", "derived", _join("members").alias("members")
    )


@query
def evidence_country_top3(spark, sf_dir):
    """Evidence of a folded bar; "Other" quotes each record's own folded country."""
    trials = _stored(_for_fields(spark, sf_dir, "country", extra=["brief_title"]))
    return _evidence(distribution(trials, "country", unique_ids=True, top_n=3, sort=False))


@query
def country_fold_members(spark, sf_dir):
    rows = bucket_rows(keyed_rows(_for_fields(spark, sf_dir, "country"), FIELDS["country"], unique_ids=True))
    counts = count_buckets(rows, FIELDS["country"], unique_ids=True)
    return fold_members(counts, 10).select("value", "count_trials", "count_mentions")


@query
def distribution_country_repeats(spark, sf_dir):
    """Repeated rows and rows without an id raise mentions, never trials."""
    trials = _stored(_with_repeats(_for_fields(spark, sf_dir, "country")))
    buckets = distribution(trials, "country", order_column="walk", top_n=5, evidence_limit=0, sort=False)
    return _bars(buckets, "country")


@query
def distribution_status_repeats(spark, sf_dir):
    """A repeated trial counts once, in the bucket of its first row."""
    trials = _with_repeats(_for_fields(spark, sf_dir, "overallStatus"))
    changed = trials.withColumn(
        "overall_status", F.when(F.col("repeat"), "WITHDRAWN").otherwise(F.col("overall_status"))
    )
    return _bars(distribution(changed, "overallStatus", order_column="walk", evidence_limit=0, sort=False), "overallStatus")


CONDITION = FieldSpec(
    alias="condition",
    path="protocolSection.conditionsModule.conditions",
    mode="explode",
    columns=("conditions",),
    key=lambda: F.col("conditions"),
    label=F.initcap,
    evidence=lambda: F.col("conditions"),
    matched=lambda value: value,
    is_list=True,
)


@query
def distribution_custom_field(spark, sf_dir):
    """A field added from outside, without touching the grouping code."""
    trials = _trials(spark, sf_dir, "conditions")
    buckets = distribution(trials, CONDITION, unique_ids=True, evidence_limit=0, sort=False)
    return buckets.select("value", "label", "count_trials", "count_mentions")


@query
def count_bases(spark, sf_dir):
    """Dual counts: the trial total beside the mention total, per field."""
    trials = _stored(_for_fields(spark, sf_dir, *FIELDS))
    table = None
    for field in sorted(FIELDS):
        one = group_summary(trials, field, unique_ids=True).withColumn("field", F.lit(field))
        table = one if table is None else table.unionByName(one)
    return table


@query
def bars_basis(spark, sf_dir):
    """Without an anchor the basis is the sum of the bars."""
    trials = _for_fields(spark, sf_dir, "interventionType")
    return count_basis(distribution(trials, "interventionType", unique_ids=True, evidence_limit=0))


@query
def citation_index(spark, sf_dir):
    """One citation per trial over a whole result, the first seen."""
    trials = _for_fields(spark, sf_dir, "interventionType", extra=["brief_title"])
    buckets = with_position(distribution(trials, "interventionType", unique_ids=True, sort=False), "interventionType")
    return citations_index(buckets, F.col("position")).select(
        "nct_id", F.col("citation.matched_value").alias("matched"), F.col("citation.excerpt").alias("excerpt")
    )


# --- time series and histogram --------------------------------------------------------------------


def _series(series: DataFrame) -> DataFrame:
    return series.select(
        "value", "label", "period", "count_trials", "planned", "partial_year", "citations_truncated",
        _join("source_ids").alias("source_ids"),
    )


def _register_series() -> None:
    for name, field in (
        ("start", "startDate"), ("primary_completion", "primaryCompletionDate"), ("completion", "completionDate"),
        ("first_post", "studyFirstPostDate"), ("last_update", "lastUpdatePostDate"),
    ):
        def series(spark, sf_dir, f=field):
            trials = _trials(spark, sf_dir, fixed.DATE_COLUMNS[f])
            return _series(timeseries(trials, f, current_year=CURRENT_YEAR, unique_ids=True))

        QUERIES[f"series_{name}"] = series


_register_series()


def _without_some_years(spark, sf_dir) -> DataFrame:
    trials = _trials(spark, sf_dir, "start_date")
    year = dates.ct_year(F.col("start_date"))
    return trials.filter(F.coalesce(~year.isin(1997, 1998), F.lit(True)))


@query
def series_with_gap(spark, sf_dir):
    """Years nobody started in are zero rows between the first and last non-future year."""
    return _series(timeseries(_without_some_years(spark, sf_dir), current_year=CURRENT_YEAR, unique_ids=True))


@query
def series_notes(spark, sf_dir):
    trials = _without_some_years(spark, sf_dir)
    return series_summary(timeseries(trials, current_year=CURRENT_YEAR, unique_ids=True, evidence_limit=0))


@query
def series_one_year(spark, sf_dir):
    """Events of a single year: one point is not a trend."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        nct_id(F.col("event_id")).alias("nct_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("start_date"),
    )
    return series_summary(timeseries(events, current_year=2030, unique_ids=True, evidence_limit=0))


def _bins(histogram: DataFrame) -> DataFrame:
    return histogram.select(
        "value", "label", "bin_start", "bin_end", "count_trials", "citations_truncated",
        _join("source_ids").alias("source_ids"),
        _join(F.col("citations.matched_value"), ";").alias("matched"),
    )


@query
def histogram_duration(spark, sf_dir):
    trials = _stored(_trials(spark, sf_dir, "start_date", "completion_date", "brief_title"))
    return _bins(duration_histogram(trials, unique_ids=True))


@query
def histogram_custom(spark, sf_dir):
    trials = _stored(_trials(spark, sf_dir, "start_date", "completion_date", "brief_title"))
    return _bins(duration_histogram(trials, bins=[(0, 12), (12, 36), (60, None)], unique_ids=True))


# --- comparison -------------------------------------------------------------------------------------

_STATUS_ARMS = (
    Arm("Observational", filters={"studyType": "OBSERVATIONAL"}),
    Arm("Russia", search={"country": "russia"}),
    Arm("Nobody", search={"sponsor": "no such sponsor"}),
)
_COMMON_ARMS = (
    Arm("Early", filters={"end_year": 1997}),
    Arm("Industry", filters={"sponsorClass": "INDUSTRY"}),
    Arm("Own phase", filters={"phase": ["NA"]}),
)
_COMMON = {"interventional_only": True, "phase": ["PHASE1", "PHASE2"]}
_MANY_ARMS = tuple(Arm(f"Since {y}", filters={"start_year": y}) for y in range(1995, 2002))


def _compared(spark, sf_dir, field, arms, common=None, top_n=None) -> DataFrame:
    trials = _stored(trials_from_orders(spark, sf_dir, compare_columns(field, arms, common) - {"brief_title"}))
    bars = compare(trials, field, arms, common=common, unique_ids=True, top_n=top_n)
    return bars.select(
        "value", "label", "series", "count_trials", "count_mentions", "percent", "arm_total",
        "category_arm", "category_place", "derived", _join("source_ids").alias("source_ids"),
    )


@query
def compare_status(spark, sf_dir):
    """Three overlapping arms, one of them empty, zero-filled."""
    return _compared(spark, sf_dir, "overallStatus", _STATUS_ARMS)


@query
def compare_phase_common(spark, sf_dir):
    """Common filters in every arm; an arm's own filter wins per key."""
    return _compared(spark, sf_dir, "phase", _COMMON_ARMS, _COMMON)


@query
def compare_country_top5(spark, sf_dir):
    """Each arm folds its own tail."""
    return _compared(spark, sf_dir, "country", _COMMON_ARMS[:2], top_n=5)


@query
def compare_arms(spark, sf_dir):
    """Totals of seven arms, two of them with a declared total."""
    trials = trials_from_orders(spark, sf_dir, compare_columns("phase", _MANY_ARMS) - {"brief_title"})
    return compare_summary(trials, _MANY_ARMS, declared={"Since 1995": 10, "Since 1996": 20}, unique_ids=True)


@query
def compare_arms_capped(spark, sf_dir):
    """The option to compare the first five arms only; the others are named as dropped."""
    trials = trials_from_orders(spark, sf_dir, compare_columns("phase", _MANY_ARMS) - {"brief_title"})
    return compare_summary(trials, _MANY_ARMS, declared={"Since 1995": 10}, unique_ids=True, max_arms=5)


# --- network ----------------------------------------------------------------------------------------


def _drug_trials(spark, sf_dir, columns: Iterable[str] = network.TRIAL_COLUMNS) -> DataFrame:
    return _stored(_trials(spark, sf_dir, *columns))


@query
def drug_interventions(spark, sf_dir):
    """Drug rows of every trial, placebo arms excluded."""
    rows = network.drug_rows(_trials(spark, sf_dir, "interventions"))
    return rows.groupBy("nct_id").agg(
        F.count(F.lit(1)).alias("drugs"), F.sum(F.size("other_names")).alias("other_names"),
        F.count_distinct("name").alias("names"),
    )


@query
def drug_alias_pairs(spark, sf_dir):
    return network.alias_pairs(network.drug_mentions(_trials(spark, sf_dir, "interventions")))


def _components(spark, sf_dir):
    mentions = cut_lineage(network.drug_mentions(_trials(spark, sf_dir, "interventions")), "mentions")
    return mentions, connected_components(network.alias_pairs(mentions))


@query
def drug_components(spark, sf_dir):
    """Merged drug keys and the smallest key of their component."""
    return _components(spark, sf_dir)[1][0]


@query
def drug_components_in_batches(spark, sf_dir):
    """The same components, kept up to date over three batches of alias pairs."""
    mentions = cut_lineage(network.drug_mentions(_trials(spark, sf_dir, "interventions")), "mentions")
    pairs = cut_lineage(network.alias_pairs(mentions), "pairs")
    batch = F.pmod(F.crc32(F.concat("a", F.lit("|"), "b").cast("binary")), F.lit(3))
    stars, _ = connected_components(pairs.filter(batch == 0))
    for i in (1, 2):
        stars, _ = merge_components(stars, pairs.filter(batch == i))
    return stars


@query
def drug_display_labels(spark, sf_dir):
    return network.drug_labels(*_components(spark, sf_dir))


@query
def sponsor_display_labels(spark, sf_dir):
    return network.sponsor_labels(_trials(spark, sf_dir, "sponsor_name"))


def _graph(spark, sf_dir, kind, **options) -> network.Network:
    return network.build_network(_drug_trials(spark, sf_dir), kind, unique_ids=True, **options)


def _uncited_graph(spark, sf_dir, kind, **options) -> network.Network:
    """A graph of which no edge or bar is shown: its trials need no titles or drug names, and no sponsors unless they are nodes."""
    columns = ("nct_id", *(["sponsor_name"] if kind == "sponsor_drug" else []), "interventions")
    trials, items = coded_trials_from_orders(spark, sf_dir, columns, network.item_codes)
    return network.build_network(_stored(trials), kind, unique_ids=True, cited=False, items=items, **options)


def _edge_text(edges: DataFrame) -> DataFrame:
    return edges.select(
        "source", "target", "weight", _join("source_ids").alias("source_ids"),
        F.col("citations")[0]["matched_value"].alias("source_quote"),
        F.col("citations")[1]["matched_value"].alias("target_quote"),
        F.col("citations")[0]["excerpt"].alias("source_excerpt"),
        _join(F.col("citations")[1]["value"], ";").alias("drug_names"),
        F.forall("citations", audit.citation_ok).alias("quotes_hold"),
    )


@query
def drug_drug_nodes(spark, sf_dir):
    return _uncited_graph(spark, sf_dir, "drug_drug").nodes


@query
def drug_drug_edges(spark, sf_dir):
    return _edge_text(_graph(spark, sf_dir, "drug_drug").edges)


@query
def drug_drug_nodes_capped(spark, sf_dir):
    """The options of a small picture: 60 nodes, edges of two trials or more, trials of up to 25 drugs."""
    return _uncited_graph(spark, sf_dir, "drug_drug", max_nodes=60, min_edge_weight=2, max_drugs_per_trial=25).nodes


@query
def drug_drug_guarded(spark, sf_dir):
    """The options to leave out, set low: what they leave out is counted."""
    return _uncited_graph(spark, sf_dir, "drug_drug", max_drugs_per_trial=3, min_edge_weight=4, max_nodes=30).summary


@query
def sponsor_drug_nodes(spark, sf_dir):
    return _uncited_graph(spark, sf_dir, "sponsor_drug").nodes


@query
def sponsor_drug_edges(spark, sf_dir):
    return _edge_text(_graph(spark, sf_dir, "sponsor_drug").edges)


@query
def sponsor_drug_summary(spark, sf_dir):
    return _uncited_graph(spark, sf_dir, "sponsor_drug").summary


@query
def drug_frequency_fallback(spark, sf_dir):
    """The bar shown when a graph is degenerate: drugs by distinct trials, and the totals."""
    return _frequencies(_graph(spark, sf_dir, "drug_drug").frequencies())


@query
def drug_frequency_top25(spark, sf_dir):
    """The option to show the 25 most frequent drugs only."""
    return _frequencies(_graph(spark, sf_dir, "drug_drug").frequencies(25))


def _frequencies(bars: DataFrame) -> DataFrame:
    return bars.select(
        "value", "count_trials", "citations_truncated", "drugs_total", "trials_total", "buckets_truncated",
        _join("source_ids").alias("source_ids"),
        _join(F.col("citations.matched_value"), ";").alias("matched"),
    )


# --- audits -----------------------------------------------------------------------------------------


def _status_result(spark, sf_dir) -> DataFrame:
    trials = _for_fields(spark, sf_dir, "overallStatus", extra=["brief_title"])
    return distribution(trials, "overallStatus", unique_ids=True, sort=False)


def _country_result(spark, sf_dir) -> DataFrame:
    trials = _stored(_for_fields(spark, sf_dir, "country", extra=["brief_title"]))
    return distribution(trials, "country", unique_ids=True, top_n=10, sort=False)


def _stored_rows(spark, sf_dir) -> DataFrame:
    """A sound result, a sound overlapping one, and copies damaged one way each."""
    status = cut_lineage(result_rows(_status_result(spark, sf_dir), "status"), "result")
    country = cut_lineage(result_rows(_country_result(spark, sf_dir), "country"), "result")

    def damaged(name: str, column: str, value: Column) -> DataFrame:
        hit = F.col("value") == "COMPLETED"
        return status.withColumn("result_id", F.lit(name)).withColumn(
            column, F.when(hit, value).otherwise(F.col(column))
        )

    forged = F.transform("citations", lambda c: c.withField("matched_value", F.lit("ATLANTIS")))
    both = F.transform(
        "citations", lambda c: c.withField("matched_value", F.lit("ATLANTIS")).withField("value", F.array(F.lit("ATLANTIS")))
    )
    copies = [
        damaged("forged_quote", "citations", forged),
        damaged("forged_value", "citations", both),
        damaged("inflated_bar", "count_trials", F.col("count_trials") + 1),
        damaged("uncited", "citations", F.slice("citations", 1, 0)),
        damaged("low_contributing", "contributing_count", F.lit(1).cast("long")),
        damaged("loose_source", "source_ids", F.array(F.lit("NCT99999999"))),
        damaged("negative", "count_trials", F.lit(-1).cast("long")),
    ]
    table = status.unionByName(country)
    for copy in copies:
        table = table.unionByName(copy)
    return table


# result_id -> (chart type, mode)
_STORED = {
    "status": ("bar", "combine"),
    "country": ("bar", "explode"),
    "forged_quote": ("bar", "combine"),
    "forged_value": ("bar", "combine"),
    "inflated_bar": ("bar", "combine"),
    "uncited": ("bar", "combine"),
    "low_contributing": ("bar", "combine"),
    "loose_source": ("bar", "combine"),
    "negative": ("network_graph", "network"),
}


def _stored_meta(spark, sf_dir) -> DataFrame:
    """The meta rows beside them, with the true totals, and variants of the sound result."""
    totals = _trials(spark, sf_dir).agg(F.count_distinct("nct_id").alias("n"))
    mentions = F.lit(None).cast("long")
    rows = [
        F.struct(
            F.lit(name).alias("result_id"), F.lit("ok").alias("status"), F.lit(chart).alias("chart_type"),
            F.lit(mode).alias("mode"),
            F.array(
                F.lit("Each trial is counted once per country." if mode == "explode" else "One bar per status."),
                F.concat(F.lit("Total "), F.col("n").cast("string")), F.lit("Fabricated 987654321"),
            ).alias("notes"),
        )
        for name, (chart, mode) in _STORED.items()
    ]
    listed = totals.select("n", F.inline(F.array(*rows)))
    return listed.select(
        "result_id", "status", "chart_type", "mode", F.col("n").alias("count_total"),
        F.col("n").alias("distinct_trials"), mentions.alias("mentions"), F.lit(False).alias("truncated"),
        F.lit(False).alias("partial"), F.lit(True).alias("reconcile"), "notes",
    )


@query
def stored_results(spark, sf_dir):
    """Three results with the meta rows built from them, written, read back and verified."""
    trials = _stored(_for_fields(spark, sf_dir, "overallStatus", "country", extra=["brief_title"]))
    total = count_trials(trials, unique_ids=True)
    made = {
        "status": ("combine", distribution(trials, "overallStatus", unique_ids=True, sort=False)),
        "country": ("explode", distribution(trials, "country", unique_ids=True, top_n=10, sort=False)),
        "cut_short": ("combine", distribution(trials.filter(F.col("overall_status") == "COMPLETED"), "overallStatus", unique_ids=True, sort=False)),
    }
    path = f"{checkpoint_dir(spark)}/stored-results-{uuid.uuid4().hex}"
    for name, (mode, buckets) in made.items():
        rows = cut_lineage(result_rows(buckets, name), "result")
        seen = rows.agg(F.sum("count_trials").alias("count_trials")) if name == "cut_short" else total
        meta = result_meta(rows, name, chart_type="bar", mode=mode, total=total, distinct=seen, truncated=name == "cut_short")
        store_results(path, rows, meta)
    rows, meta = read_results(spark, path, "rows"), read_results(spark, path, "meta")
    verdicts = audit.verify_results(rows, meta).join(audit.release_check(rows, meta).drop("ok", "disclosure"), "result_id")
    return verdicts.join(meta.select("result_id", "count_total", "distinct_trials", "mentions", "truncated", "partial", F.size("notes").alias("n_notes")), "result_id")


@query
def stored_files(spark, sf_dir):
    """Results stored by sound, damaged, retried, replaced and broken-off writes, verified from their files."""
    trials = _stored(_for_fields(spark, sf_dir, "overallStatus", extra=["brief_title"]))
    rows = cut_lineage(result_rows(distribution(trials, "overallStatus", unique_ids=True, sort=False), "sound"), "result")
    meta = cut_lineage(result_meta(rows, "sound", chart_type="bar", mode="combine", total=count_trials(trials, unique_ids=True)), "meta")
    path = f"{checkpoint_dir(spark)}/stored-files-{uuid.uuid4().hex}"

    def named(df: DataFrame, *results: str) -> DataFrame:
        return df.withColumn("result_id", F.explode(F.array(*map(F.lit, results))))

    for attempt in range(2):  # the second is a retry
        store_results(path, named(rows, "sound", "replaced", "broken_off"), named(meta, "sound", "replaced", "broken_off"), version=f"first {attempt // 2}")
    write_results(named(rows.unionAll(rows), "broken_off"), path, "rows", "second")  # neither meta row nor commit follows
    store_results(path, named(rows.filter("value <> 'COMPLETED'"), "replaced"), named(meta, "replaced"), version="third")
    store_results(path, named(rows.drop("contributing_count", "members"), "missing_column"), named(meta, "missing_column"))
    store_results(path, named(rows.withColumn("count_trials", F.col("count_trials").cast("string")), "mistyped_column"), named(meta, "mistyped_column"))
    store_results(path, named(rows, "short_meta"), named(meta.drop("notes"), "short_meta"))
    found = cut_lineage(stored_problems(spark, path), "problems")
    verdicts = audit.verify_stored(spark, path, found)
    broken = [(r["result_id"], r["version"]) for r in found.select("result_id", "version").distinct().collect()]
    bars = read_results(spark, path, "rows", broken).groupBy("result_id").agg(F.count(F.lit(1)).alias("bars"), F.sum("count_trials").alias("bar_sum"))
    problems = found.groupBy("result_id").agg(_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))
    return verdicts.join(bars, "result_id", "left").join(problems, "result_id", "left")


@query
def audit_quotes(spark, sf_dir):
    """Citations that do not quote their own value, over sound and forged results."""
    bad = audit.audit_citations(_stored_rows(spark, sf_dir), "result_id", "value")
    return bad.groupBy("result_id", "value").agg(F.count(F.lit(1)).alias("bad_citations"))


@query
def audit_quotes_in_records(spark, sf_dir):
    """Citations whose quote is not in the cited record, found even when self-consistent."""
    trials = _for_fields(spark, sf_dir, "overallStatus", "country")
    bad = audit.audit_citations_against(
        _stored_rows(spark, sf_dir), trials, "result_id", "value", fields=("overallStatus", "country")
    )
    return bad.groupBy("result_id", "value").agg(F.count(F.lit(1)).alias("bad_citations"))


@query
def audit_edge_quotes(spark, sf_dir):
    """Edge citations against the records they cite; a sound graph has none to report."""
    trials = _drug_trials(spark, sf_dir)
    graph = network.build_network(trials, "sponsor_drug", unique_ids=True)
    edges = cut_lineage(result_edges(graph.edges, "graph"), "result")
    bad = audit.audit_citations_against(edges, trials, "source", "target", fields=("sponsorName", "interventionName"))
    checked = audit.cited(edges).agg(F.count(F.lit(1)).alias("citations"))
    return checked.select("citations", bad.agg(F.count(F.lit(1)).alias("n")).scalar().alias("failed"))


@query
def audit_release(spark, sf_dir):
    """The first rule each result breaks, over sound, damaged and drifting results."""
    rows = cut_lineage(_stored_rows(spark, sf_dir), "rows")
    meta = _stored_meta(spark, sf_dir)
    status = meta.filter(F.col("result_id") == "status")
    sound = rows.filter(F.col("result_id") == "status")

    def variant(name: str, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
        return (
            sound.withColumn("result_id", F.lit(name)),
            status.withColumn("result_id", F.lit(name)).withColumn(column, value),
        )

    total = F.col("count_total")
    for name, column, value in (
        ("small_drift", "count_total", total + 2),
        ("large_drift", "count_total", total + 21),
        ("no_total", "count_total", F.lit(None).cast("long")),
        ("waived", "reconcile", F.lit(False)),
        ("partial_only", "partial", F.lit(True)),
        ("refused", "status", F.lit("too_large")),
    ):
        more_rows, more_meta = variant(name, column, value)
        rows, meta = rows.unionByName(more_rows), meta.unionByName(more_meta)
    return audit.release_check(rows, meta)


@query
def audit_bookkeeping(spark, sf_dir):
    return audit.audit_counts(cut_lineage(_stored_rows(spark, sf_dir), "rows"))


@query
def audit_note_numbers(spark, sf_dir):
    """Notes whose numbers are not among the result's own."""
    rows = cut_lineage(_stored_rows(spark, sf_dir), "rows")
    meta = _stored_meta(spark, sf_dir)
    notes = meta.select("result_id", F.explode("notes").alias("note"))
    return audit.audit_notes(notes, rows, meta)


@query
def audit_stored_results(spark, sf_dir):
    """PASS / FAIL / SKIP per invariant and result."""
    rows = cut_lineage(_stored_rows(spark, sf_dir), "rows")
    return audit.verify_results(rows, cut_lineage(_stored_meta(spark, sf_dir), "meta"))
