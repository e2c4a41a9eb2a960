from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from conftest import drug, nct
from pyspark.sql import functions as F, types as T

from trialspark import fixed_values as fixed, session
from trialspark.functions import paths
from trialspark.operators import network
from trialspark.operators.audit import verify_stored
from trialspark.operators.filters import filter_trials
from trialspark.sources import adapter, search_index
from trialspark.sources.layout import merge_trials, open_trials, store_by_year, store_trials
from trialspark.sources.reader import (
    dedupe_trials,
    flatten_studies,
    nest_studies,
    read_studies,
    read_trials,
    split_valid_ids,
)
from trialspark.sources.search_index import build_search_index, candidates, search_trials
from trialspark.sources.schema import RESULT_META, RESULT_ROW, STUDY, TRIALS
from trialspark.sources.sink import conform, read_results, result_rows, schema_conforms, store_results, stored_problems, write_results


def _study(number, **modules):
    return {"protocolSection": {"identificationModule": {"nctId": nct(number)}, **modules}}


def test_messy_json_never_fails(spark, tmp_path):
    lines = [
        _study(1, designModule={"phases": ["PHASE1", "PHASE2"]}),
        _study(2, designModule={"phases": "PHASE3"}),
        _study(3, designModule=None),
        _study(
            4,
            armsInterventionsModule={
                "interventions": [None, "junk", {"type": "DRUG", "name": "A", "otherNames": None}, {"type": "DRUG", "name": "B", "otherNames": "b1"}, {"name": "C", "otherNames": ["c1", "c2"]}]
            },
            contactsLocationsModule={"locations": [{"country": "France"}, "junk", {"city": "X"}, None]},
        ),
        _study(5, armsInterventionsModule={"interventions": "none"}, contactsLocationsModule={"locations": None}),
        {"protocolSection": None},
        None,
        7,
    ]
    path = tmp_path / "studies.json"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json at all\n")
    rows = {r["nct_id"]: r for r in read_trials(spark, str(path)).collect()}
    assert sorted(rows) == [nct(i) for i in range(1, 6)]
    assert rows[nct(1)]["phases"] == ["PHASE1", "PHASE2"]
    assert rows[nct(2)]["phases"] == ["PHASE3"]
    assert rows[nct(3)]["phases"] is None
    found = [(i["type"], i["name"], i["otherNames"]) for i in rows[nct(4)]["interventions"]]
    assert found == [("DRUG", "A", None), ("DRUG", "B", ["b1"]), (None, "C", ["c1", "c2"])]
    assert rows[nct(4)]["countries_raw"] == ["France"]
    assert rows[nct(5)]["interventions"] is None


def test_parquet_round_trip_prunes_columns(spark, study_table, tmp_path):
    trials = study_table([{"nct_id": nct(1), "phases": ["NA"], "countries_raw": ["France"], "interventions": [drug("A", ["b"])]}])
    path = str(tmp_path / "studies")
    nest_studies(trials).write.parquet(path)
    back = read_studies(spark, path, "parquet")
    assert back.schema.simpleString() == STUDY.simpleString()
    row = flatten_studies(back).first()
    assert (row["phases"], row["countries_raw"], row["interventions"][0]["otherNames"]) == (["NA"], ["France"], ["b"])
    narrow = flatten_studies(back, ["nct_id", "overall_status"])
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "overallStatus" in plan and "interventions" not in plan
    with pytest.raises(ValueError):
        read_studies(spark, path, "csv")


def test_paths(spark, study_table):
    trials = study_table(
        [
            {"nct_id": nct(1), "countries_raw": ["France", "Spain"], "interventions": [drug("A", ["x", "y"]), drug("B", ["z"])]},
            {"nct_id": nct(2)},
        ]
    )
    studies = nest_studies(trials)
    country = fixed.FIELD_PATHS["country"]
    got = studies.select(
        paths.path_first(fixed.FIELD_PATHS["nctId"]).alias("id"),
        paths.path_first(country).alias("first"),
        paths.path_all(country).alias("all"),
        paths.path_all("protocolSection.armsInterventionsModule.interventions[].otherNames[]").alias("others"),
    ).orderBy("id").collect()
    assert (got[0]["first"], got[0]["all"], got[0]["others"]) == ("France", ["France", "Spain"], ["x", "y", "z"])
    assert (got[1]["first"], got[1]["all"], got[1]["others"]) == (None, [None], [None])


@pytest.mark.parametrize(
    ("value", "valid"),
    [
        ("NCT01234567", True), ("nct01234567", False), ("NCT0123456", False), ("NCT012345678", False),
        (" NCT01234567", False), ("NCT01234567\n", False), ("NCT0123456７", False), ("NCT0123456a", False), ("", False), (None, False),
    ],
)
def test_ids(spark, value, valid):
    good, bad = split_valid_ids(spark.createDataFrame([(value,)], "nct_id string"))
    assert (good.count(), bad.count()) == ((1, 0) if valid else (0, 1))


@pytest.mark.parametrize("partitions", [1, 5])
def test_first_row_wins(study_table, partitions):
    rows = [
        {"nct_id": nct(1), "overall_status": "COMPLETED", "start_date": "2"},
        {"nct_id": nct(1), "overall_status": "RECRUITING", "start_date": "1"},
        {"nct_id": None, "overall_status": "RECRUITING", "start_date": "0"},
    ]
    kept = dedupe_trials(study_table(rows, partitions), "start_date").collect()
    assert [(r["nct_id"], r["overall_status"]) for r in kept] == [(nct(1), "RECRUITING")]
    unordered = dedupe_trials(study_table(rows, partitions)).collect()
    assert [r["overall_status"] for r in unordered] == ["COMPLETED"]


def test_results_are_stored_under_the_contract(spark, study_table, tmp_path):
    from trialspark import distribution

    bars = result_rows(distribution(study_table([{"nct_id": nct(1), "phases": ["NA"]}]), "phase"), "r1")
    meta = spark.createDataFrame([("r1",)], "result_id string")
    store_results(str(tmp_path), bars, conform(meta, RESULT_META))
    back = read_results(spark, str(tmp_path), "rows")
    assert schema_conforms(back, RESULT_ROW) == []
    assert back.first()["citations"][0]["matched_value"] == "NA"
    assert schema_conforms(back.drop("label"), RESULT_ROW) == ["missing column label"]
    wrong = back.withColumn("count_trials", F.col("count_trials").cast("string"))
    assert schema_conforms(wrong, RESULT_ROW) == ["column count_trials is string, expected bigint"]
    with pytest.raises(ValueError):
        write_results(bars, str(tmp_path), "charts")
    assert set(TRIALS.fieldNames()) >= {"nct_id", "conditions"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_trials_are_not_shuffled_again(spark, study_table, tmp_path):
    rows = [{"nct_id": nct(i % 40), "overall_status": f"S{i}", "start_date": str(1000 + i)} for i in range(100)] + [{"nct_id": None}]
    trials = study_table(rows).select("nct_id", "overall_status", "start_date")
    stored = store_trials(trials, "layout_a", str(tmp_path / "a"), order_column="start_date", buckets=4)
    assert {(r.nct_id, r.overall_status) for r in stored.collect()} == {(nct(i), f"S{i}") for i in range(40)} and stored.count() == 40
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in _plan(dedupe_trials(stored, "start_date"))
        assert "Exchange" not in _plan(stored.groupBy("nct_id").count())
        counted = _plan(stored.agg(F.count_distinct("nct_id")))
        assert counted.count("Exchange") == 1 and "SinglePartition" in counted  # one number per task
        claims = spark.createDataFrame([(nct(3), "x")], "nct_id string, claim string")
        checked = _plan(stored.join(claims, "nct_id"))
        assert checked.count("Exchange") == 1 and "Bucketed: true" in stored.join(claims, "nct_id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        batch = study_table([{"nct_id": nct(5), "overall_status": "EARLIER", "start_date": "0"}, {"nct_id": nct(6), "overall_status": "LATER", "start_date": "9999"}, {"nct_id": nct(77), "overall_status": "NEW"}, {"nct_id": None}])
        batch = batch.select("nct_id", "overall_status", "start_date")
        merged = merge_trials(stored, batch, "start_date")
        assert _plan(merged).count("Exchange") == _plan(dedupe_trials(batch, "start_date")).count("Exchange") + 1  # the batch to its buckets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = store_trials(merged, "layout_b", str(tmp_path / "b"), buckets=4, unique_ids=True)
    got = {r.nct_id: r.overall_status for r in again.collect()}
    assert len(got) == again.count() == 41
    assert (got[nct(5)], got[nct(6)], got[nct(77)]) == ("EARLIER", "S6", "NEW")
    schema = again.schema
    spark.sql("DROP TABLE layout_b")
    back = open_trials(spark, "layout_b", str(tmp_path / "b"), schema, 4)
    assert back.count() == 41 and "Exchange" not in _plan(back.groupBy("nct_id").count())
    for name in ("layout_a", "layout_b"):
        spark.sql(f"DROP TABLE {name}")


def test_indexed_search_finds_what_a_scan_finds(spark, study_table, tmp_path):
    rows = [
        {"nct_id": nct(1), "brief_title": "Aspirin in ÉCLAIR", "conditions": ["Heart Failure", None], "sponsor_name": "Acme"},
        {"nct_id": nct(2), "interventions": [drug("ASPIRIN 10mg"), drug(None, ["aspi", "rin"]), ("DEVICE", "x", None)], "countries_raw": ["USA", None]},
        {"nct_id": nct(3), "brief_title": "aspir", "interventions": [drug("irin")], "countries_raw": []},
        {"nct_id": nct(4), "sponsor_name": "spiriaspi rin", "conditions": []}, {"nct_id": None, "brief_title": "aspirin"}, {"nct_id": nct(5)},
    ]
    trials = study_table(rows)
    index = build_search_index(trials, str(tmp_path / "postings"), partitions=3)
    for search in ({"term": "aspirin"}, {"intr": "Aspirin"}, {"term": "éclair"}, {"cond": "heart f"}, {"term": "in"}, {"country": "usa"}, {"spons": "acme", "term": "asp"}, {"term": ""}, {"term": "spiri"}, {"term": "a(b"}):
        want = {r.nct_id for r in filter_trials(trials, None, search).collect()} - {None}
        assert {r.nct_id for r in search_trials(index, trials, search).collect()} - {None} == want, search
    assert {r.nct_id for r in candidates(index, "term", "aspirin").collect()} == {nct(1), nct(2), nct(3), nct(4)}  # the last two have the parts, not the word
    plan = _plan(candidates(index, "cond", "heart"))
    assert "area" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram" in plan.split("PushedFilters: [")[1]


def test_a_year_range_reads_its_own_folders(spark, study_table, tmp_path):
    dates = ["1998-01", "1999", "2000-05-03", "2001", "12000", "1850", None, "soon", "2000-13", ""]
    trials = study_table([{"nct_id": nct(i), "start_date": d} for i, d in enumerate(dates * 3)])
    stored = store_by_year(trials.select("nct_id", "start_date"), str(tmp_path / "years"))
    assert stored.count() == 30
    for filters, folders in (({"start_year": 1999, "end_year": 2000}, 2), ({"start_year": 2000}, 3), ({"end_year": 1999}, 3), ({}, None)):
        got = filter_trials(stored, filters)
        assert {r.nct_id for r in got.collect()} == {r.nct_id for r in filter_trials(trials, filters).collect()}
        if folders:
            assert "start_year_part" in _plan(got).split("PartitionFilters: [")[1].split("]")[0]
            read = got.select(F.regexp_extract(F.input_file_name(), "start_year_part=([^/]*)", 1).alias("f")).distinct()
            assert {r.f for r in read.collect()} <= {"1998", "1999", "2000", "2001", "0"} and read.count() <= folders


@pytest.mark.parametrize("seed", range(3))
def test_batches_merge_to_the_rows_of_one_dedup(spark, study_table, tmp_path, seed):
    draw = random.Random(seed)
    rows = [{"nct_id": draw.choice([nct(i) for i in range(12)] + [None]), "overall_status": draw.choice("abc"), "start_date": draw.choice([None, "1", "2"]), "phases": draw.choice([None, [], ["NA"]])} for _ in range(60)]
    columns = ["nct_id", "overall_status", "start_date", "phases"]
    table = study_table(rows).select(*columns)
    stored = store_trials(study_table(rows[:20]).select(*columns), f"batches_{seed}_0", str(tmp_path / "0"), order_column="start_date", buckets=3)
    for i in (1, 2):
        merged = merge_trials(stored, study_table(rows[20 * i : 20 * i + 20]).select(*columns), "start_date")
        stored = store_trials(merged, f"batches_{seed}_{i}", str(tmp_path / str(i)), buckets=3, unique_ids=True)
    assert sorted(map(str, stored.collect())) == sorted(map(str, dedupe_trials(table, "start_date").select(*columns).collect()))
    for i in range(3):
        spark.sql(f"DROP TABLE batches_{seed}_{i}")


def _stored_rows(spark, count: int, results=("r1", "r:2/x")):
    rows = [(r, f"v{i}", i) for r in results for i in range(count)]
    made = spark.createDataFrame(rows, "result_id string, value string, count_trials long")
    meta = spark.createDataFrame([(r, "ok") for r in results], "result_id string, status string")
    contract = T.StructType([*RESULT_ROW.fields, T.StructField("result_id", T.StringType())])
    return conform(made, contract), conform(meta, RESULT_META)


def _seen(spark, path):
    rows = read_results(spark, path, "rows").groupBy("result_id").count().collect()
    meta = read_results(spark, path, "meta").groupBy("result_id").count().collect()
    return {r[0]: r[1] for r in rows}, {r[0]: r[1] for r in meta}


def test_a_repeated_write_leaves_one_result(spark, tmp_path):
    path = str(tmp_path)
    assert _seen(spark, path) == ({}, {})
    for _ in range(2):
        store_results(path, *_stored_rows(spark, 3), version="a")
    assert _seen(spark, path) == ({"r1": 3, "r:2/x": 3}, {"r1": 1, "r:2/x": 1})
    store_results(path, *_stored_rows(spark, 5, ["r1"]))
    assert _seen(spark, path) == ({"r1": 5, "r:2/x": 3}, {"r1": 1, "r:2/x": 1})


def test_a_write_that_stops_shows_nothing_of_itself(spark, tmp_path):
    path, (rows, meta) = str(tmp_path), _stored_rows(spark, 3)
    write_results(rows, path, "rows", "first")
    assert _seen(spark, path) == ({}, {})
    store_results(path, rows, meta, version="first")
    more, meta = _stored_rows(spark, 9)
    write_results(more, path, "rows", "second")  # killed here
    assert _seen(spark, path)[0] == {"r1": 3, "r:2/x": 3}
    write_results(meta, path, "meta", "second")  # or here
    assert _seen(spark, path) == ({"r1": 3, "r:2/x": 3}, {"r1": 1, "r:2/x": 1})
    store_results(path, more, meta, version="second")
    assert _seen(spark, path)[0] == {"r1": 9, "r:2/x": 9}


def test_files_are_checked_by_their_own_columns(spark, tmp_path):
    path, (rows, meta) = str(tmp_path), _stored_rows(spark, 3, ["good"])
    store_results(path, rows, meta, version="g")
    store_results(path, rows.drop("percent").withColumn("result_id", F.lit("r:2 +x")), meta.withColumn("result_id", F.lit("r:2 +x")))
    store_results(path, rows.withColumn("members", F.lit("x")).withColumn("result_id", F.lit("typed")), meta.withColumn("result_id", F.lit("typed")), version="t")
    write_results(rows.drop("label").withColumn("result_id", F.lit("good")), path, "rows", "unseen")
    found = {(r.result_id, r.kind): r.problem for r in stored_problems(spark, path).collect()}
    assert found == {("r:2 +x", "rows"): "missing column percent", ("typed", "rows"): "column members is string, expected array<string>"}
    verdicts = {r.result_id: (r.i_schema, r.ii_provenance, r.ok) for r in verify_stored(spark, path).collect()}
    assert verdicts["typed"] == verdicts["r:2 +x"] == ("FAIL", "SKIP", False) and verdicts["good"][0] == "PASS"
    assert read_results(spark, path, "rows", [("typed", "t")]).filter("result_id = 'good'").count() == 3
    folder = next((tmp_path / "rows" / "result_id=good").glob("version=g/*.parquet"))
    folder.write_bytes(b"not a table")
    (folder.parent / f".{folder.name}.crc").unlink(missing_ok=True)
    assert {r.problem for r in stored_problems(spark, path).filter("result_id = 'good'").collect()} == {"unreadable file: ArrowInvalid"}


def test_ids_of_large_keys_stay_apart(spark):
    keys = [5, 100000001, 100000002, 1000000010, 12345678901]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(adapter.nct_id(F.col("k"))).collect()
    assert [r[0] for r in got] == ["NCT00000005", "NCT100000001", "NCT100000002", "NCT1000000010", "NCT12345678901"]


def test_the_search_index_lists_a_repeated_text_once(spark, study_table, tmp_path):
    trials = study_table([{"nct_id": nct(i), "conditions": ["Heart Failure"], "interventions": [drug("aspirin")]} for i in range(40)])
    index = build_search_index(trials, str(tmp_path / "postings"), areas=("cond", "term"))
    assert index.filter("kind = 'grams'").count() == len("heart failure") - 2 + len("aspirin") - 2
    assert index.filter("kind = 'trials'").count() == 2 * 40
    assert search_trials(index, trials, {"term": "heart"}).count() == 40
    long = {"term": "heart failure " * 10}
    assert search_trials(index, trials, long).count() == 0


@pytest.mark.parametrize("bits", [2, 10])
def test_the_search_index_lists_trigrams_by_block(spark, study_table, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(search_index, "_BLOCK_BITS", bits)
    titles = [f"Study {37 * i} of Hearts" for i in range(200)]
    trials = study_table([{"nct_id": nct(i), "brief_title": t, "conditions": [["Asthma", "Hearts"][i % 2]]} for i, t in enumerate(titles)])
    index = build_search_index(trials, str(tmp_path / "postings"), areas=("term",))
    parts = [{t.lower()[i : i + 3] for i in range(len(t) - 2)} for t in titles]
    listed = index.filter("kind = 'grams' AND area = 'brief_title'").count()
    assert listed < sum(map(len, parts)) / (1 if bits == 2 else 3)
    own = [p | {c[i : i + 3] for i in range(len(c) - 2)} for p, c in zip(parts, ["asthma", "hearts"] * 100, strict=True)]
    for needle in ("study 37", "740 of", "y 7", "Asthma", "370 of hearts", "zzz", "of hearts 3", "thmarts"):
        wanted = {needle.lower()[i : i + 3] for i in range(len(needle) - 2)}
        got = [r.nct_id for r in candidates(index, "term", needle).collect()]
        assert sorted(got) == [nct(i) for i, p in enumerate(own) if wanted <= p], needle
        assert {r.nct_id for r in search_trials(index, trials, {"term": needle}).collect()} == {r.nct_id for r in filter_trials(trials, None, {"term": needle}).collect()}


def test_stored_tables_go_one_by_one(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    setting = spark.conf.get(session._CLEANUP)
    one, two = session.cut_lineage(counted, "one"), session.cut_lineage(counted, "two")
    assert spark.conf.get(session._CLEANUP) == setting
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    assert two.count() == one.count() == 7
    session.drop_table(one)
    session.drop_table(counted)  # not a stored table
    assert not [p for p in folder.glob("trialspark-one-*")] and two.count() == 7


def test_portions_of_orders_make_the_whole_study_table(spark):
    sf_dir, columns = "/root/testdata/sf0.001", ["nct_id", "interventions", "countries_raw", "phases", "sponsor_name"]
    whole = sorted(map(str, adapter.trials_from_orders(spark, sf_dir, columns).collect()))
    assert sorted(map(str, adapter.stored_trials_from_orders(spark, sf_dir, columns, portions=3).collect())) == whole
    first = adapter.trials_from_orders(spark, sf_dir, columns, portion=(0, 3)).count()
    assert 0.2 * len(whole) < first < 0.5 * len(whole)


def test_coded_interventions_stand_for_those_of_the_texts(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["nct_id"]: r["interventions"] for r in adapter.trials_from_orders(spark, sf_dir, ("nct_id", "interventions")).collect()}
    trials, codes = adapter.coded_trials_from_orders(spark, sf_dir, ("nct_id", "interventions"), network.item_codes)
    # No text is grouped by order.
    assert trials.schema["interventions"].dataType.simpleString() == "array<struct<item:bigint,name:bigint>>"
    item_of = {r["code"]["item"]: r["item"] for r in codes.collect()}
    assert {r["nct_id"]: r["interventions"] and [item_of[c["item"]] for c in r["interventions"]] for r in trials.collect()} == texts
