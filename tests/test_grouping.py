from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from conftest import drug, nct
from pyspark.sql import functions as F

from trialspark.operators import evidence
from trialspark.operators.fields import FIELDS
from trialspark.operators.filters import filter_trials, predicate
from trialspark.operators.grouping import (
    bucket_rows,
    count_basis,
    count_buckets,
    distribution,
    fold_members,
    group_summary,
    keyed_rows,
    population_gate,
    single_value,
    token_counts,
)


def bars(df):
    return [(r["value"], r["count_trials"], r["count_mentions"]) for r in df.collect()]


def test_phase_bars_add_up(study_table):
    trials = study_table(
        [
            {"nct_id": nct(1), "phases": ["PHASE2"]},
            {"nct_id": nct(2), "phases": ["PHASE2", "PHASE1"]},
            {"nct_id": nct(3), "phases": ["PHASE1", "PHASE2"]},
            {"nct_id": nct(4)},
            {"nct_id": nct(5), "phases": ["NA"]},
            {"nct_id": nct(5), "phases": ["NA"]},
            {"phases": ["PHASE4"]},
        ]
    )
    assert bars(distribution(trials, "phase")) == [
        ("MISSING", 1, 1), ("NA", 1, 1), ("PHASE1|PHASE2", 2, 2), ("PHASE2", 1, 1),
    ]
    row = group_summary(trials, "phase").first()
    assert (row["distinct_trials"], row["sum_trials"]) == (5, 5)


def test_a_repeat_under_another_key_counts_once(study_table):
    trials = study_table(
        [
            {"nct_id": nct(1), "overall_status": "RECRUITING", "start_date": "1"},
            {"nct_id": nct(1), "overall_status": "COMPLETED", "start_date": "2"},
            {"nct_id": nct(2)},
        ]
    )
    assert bars(distribution(trials, "overallStatus", order_column="start_date")) == [("RECRUITING", 1, 1), ("UNKNOWN", 1, 1)]


def test_explode_counts_trials_and_mentions(study_table):
    trials = study_table(
        [
            {"nct_id": nct(1), "countries_raw": ["USA", "United States", "France", ""]},
            {"nct_id": nct(1), "countries_raw": ["France"]},
            {"nct_id": nct(2), "countries_raw": ["France"]},
            {"nct_id": nct(3), "countries_raw": []},
            {"countries_raw": ["Spain"]},
        ]
    )
    assert bars(distribution(trials, "country")) == [
        ("France", 2, 3), ("United States", 1, 1), ("Spain", 0, 1), ("UNKNOWN", 1, 1),
    ]


def test_fold_counts_distinct_trials(study_table):
    trials = study_table(
        [{"nct_id": nct(i), "countries_raw": ["A", "B"][: 1 + i % 2]} for i in range(6)]
        + [{"nct_id": nct(10), "countries_raw": ["C", "D"]}, {"nct_id": nct(11), "countries_raw": ["D", "A"]}, {"nct_id": nct(12)}]
    )
    rows = distribution(trials, "country", top_n=2, inline_members=True).collect()
    got = [(r["value"], r["label"], r["count_trials"], r["count_mentions"], r["derived"], r["members"]) for r in rows]
    assert got == [
        ("A", "A", 7, 7, False, None),
        ("B", "B", 3, 3, False, None),
        ("Other", "Other (2 countries)", 2, 3, True, ["D", "C"]),
        ("UNKNOWN", "Unknown", 1, 1, False, None),
    ]
    quoted = {c["nct_id"]: (c["matched_value"], c["value"]) for c in rows[2]["citations"]}
    assert quoted == {nct(10): ("C", ["C", "D"]), nct(11): ("D", ["D", "A"])}
    assert distribution(trials, "country", top_n=4).filter("derived").count() == 0


def test_members_as_a_table(study_table):
    trials = study_table([{"nct_id": nct(i), "countries_raw": [f"C{j}" for j in range(i)]} for i in range(1, 6)])
    counts = count_buckets(bucket_rows(keyed_rows(trials, FIELDS["country"])), FIELDS["country"])
    assert sorted(r["value"] for r in fold_members(counts, 2).collect()) == ["C2", "C3", "C4"]
    other = distribution(trials, "country", top_n=2, inline_members=False).filter("derived").first()
    assert (other["members"], other["label"], other["count_trials"]) == (None, "Other (3 countries)", 3)


def test_token_counts(study_table):
    trials = study_table(
        [{"nct_id": nct(i), "overall_status": "RECRUITING"} for i in range(12)]
        + [{"nct_id": nct(20), "overall_status": "NOT_YET_RECRUITING"}, {"nct_id": nct(21), "overall_status": "UNKNOWN"}]
        + [{"nct_id": nct(22)}, {"nct_id": nct(23), "overall_status": "INVENTED"}]
    )
    rows = token_counts(trials, "overallStatus", evidence_limit=10).collect()
    assert [(r["value"], r["label"], r["count_trials"], r["derived"]) for r in rows] == [
        ("NOT_YET_RECRUITING", "Not Yet Recruiting", 1, False),
        ("RECRUITING", "Recruiting", 12, False),
        ("UNKNOWN", "Unknown", 1, False),
        ("Missing", "Missing (not reported)", 2, True),
    ]
    assert (len(rows[1]["citations"]), rows[1]["citations_truncated"]) == (10, True)
    kinds = study_table(
        [{"nct_id": nct(i), "interventions": [drug("a"), drug("b"), drug("c", kind="DEVICE")]} for i in range(3)] + [{"nct_id": nct(9)}]
    )
    assert bars(token_counts(kinds, "interventionType")) == [("DEVICE", 3, 3), ("DRUG", 3, 3)]
    with pytest.raises(ValueError):
        token_counts(kinds, "phase")


def test_evidence_is_the_smallest_ids(study_table):
    numbers = list(range(100))
    random.Random(1).shuffle(numbers)
    trials = study_table([{"nct_id": nct(n), "brief_title": f"T{n}" if n % 2 else "", "phases": ["PHASE1", "PHASE3"]} for n in numbers], 7)
    row = distribution(trials, "phase").first()
    assert row["source_ids"] == [nct(n) for n in range(20)]
    assert (row["contributing_count"], row["citations_truncated"]) == (100, True)
    first, second = row["citations"][:2]
    assert (first["excerpt"], second["excerpt"]) == ("PHASE1", "T1")
    assert (first["matched_value"], first["matched_tokens"], first["value"]) == ("PHASE1", ["PHASE1", "PHASE3"], ["PHASE1", "PHASE3"])
    plain = distribution(study_table([{"nct_id": nct(1), "phases": ["PHASE2"]}]), "phase").first()["citations"][0]
    assert plain["matched_tokens"] is None
    absent = distribution(study_table([{"nct_id": nct(1)}]), "phase").first()["citations"][0]
    assert (absent["matched_value"], absent["value"]) == ("", [])


def test_result_does_not_depend_on_partitions(study_table):
    rng = random.Random(5)
    rows = [{"nct_id": nct(i), "countries_raw": rng.sample(["A", "B", "C", "D", "E"], rng.randint(0, 4))} for i in range(300)]
    one = distribution(study_table(rows, 1), "country", top_n=3).collect()
    many = distribution(study_table(rows, 13), "country", top_n=3).collect()
    assert one == many


def test_hot_bucket_against_brute_force(study_table):
    """One country holds most rows; counts, fold and samples stay exact."""
    rng = random.Random(9)
    rows, brute = [], defaultdict(set)
    for i in range(3000):
        found = {"Hot"} if i % 3 else {f"C{rng.randint(0, 30)}", f"C{rng.randint(0, 30)}"}
        rows.append({"nct_id": nct(i), "countries_raw": sorted(found)})
        for c in found:
            brute[c].add(nct(i))
    ranked = sorted(brute, key=lambda c: (-len(brute[c]), c))
    tail = set().union(*(brute[c] for c in ranked[5:]))
    got = {r["value"]: r for r in distribution(study_table(rows, 8), "country", top_n=5).collect()}
    assert set(got) == {*ranked[:5], "Other"}
    for c in ranked[:5]:
        assert got[c]["count_trials"] == len(brute[c]) and got[c]["source_ids"] == sorted(brute[c])[:20]
    assert got["Other"]["count_trials"] == len(tail) and got["Other"]["source_ids"] == sorted(tail)[:20]


def test_single_value(study_table):
    card = single_value(study_table([{"nct_id": nct(i % 1500), "brief_title": "t"} for i in range(1600)])).first()
    assert (card["value"], card["label"], card["count_trials"]) == ("1500", "1,500 trials", 1500)
    assert card["source_ids"] == [nct(i) for i in range(20)] and card["citations_truncated"]
    assert card["answer"] == "Yes — 1,500 trials match this query."
    assert card["citations"][0]["matched_value"] == nct(0)
    none = single_value(study_table([{"nct_id": nct(1)}]).filter("false")).first()
    assert (none["count_trials"], none["citations"], none["answer"]) == (0, [], "No trials match this query.")
    one = single_value(study_table([{"nct_id": nct(1)}])).first()
    assert one["answer"] == "Yes — 1 trial match this query."


def test_gate_and_basis(study_table):
    trials = study_table([{"nct_id": nct(i), "countries_raw": ["A", "B"]} for i in range(5)])
    assert tuple(population_gate(trials).first()) == (5, "ok")
    assert tuple(population_gate(trials.union(trials)).first()) == (5, "ok")
    assert population_gate(trials.filter("false")).first()["status"] == "empty"
    buckets = distribution(trials, "country", evidence_limit=0)
    assert tuple(count_basis(buckets).first()) == (10, 10)
    assert tuple(count_basis(buckets, 5).first()) == (5, 10)


def test_unknown_field(study_table):
    with pytest.raises(ValueError):
        distribution(study_table([]), "colour")


@pytest.mark.parametrize(
    "filters",
    [
        {"overallStatus": "recruiting"}, {"studyType": "X"}, {"phase": "PHASE9"}, {"phase": ["PHASE1", "X"]},
        {"sponsorClass": "X"}, {"interventionType": "PILL"}, {"start_year": 1800}, {"start_year": True},
        {"end_year": "2020"}, {"start_year": 2020, "end_year": 2019}, {"colour": "red"},
    ],
)
def test_filter_arguments_are_checked(spark, filters):
    with pytest.raises(ValueError):
        predicate(filters)


def test_filters(study_table):
    trials = study_table(
        [
            {"nct_id": nct(1), "study_type": "INTERVENTIONAL", "phases": ["PHASE1", "PHASE2"], "start_date": "2015-12-31", "interventions": [drug("A", ["Keytruda"])]},
            {"nct_id": nct(2), "study_type": "OBSERVATIONAL", "phases": None, "start_date": "2016", "conditions": ["Lung (NSCLC)"]},
            {"nct_id": nct(3), "study_type": "INTERVENTIONAL", "phases": ["NA"], "start_date": "bad", "sponsor_name": "A OR B"},
        ]
    )

    def ids(filters=None, search=None):
        got = [int(r["nct_id"][3:]) for r in filter_trials(trials, filters, search).orderBy("nct_id").collect()]
        flagged = trials.filter(predicate(filters, search)).count()
        assert flagged == len(got)
        return got

    assert ids({"phase": "PHASE2"}) == [1]
    assert ids({"phase": ["NA", "PHASE1"]}) == [1, 3]
    assert ids({"phase": []}) == [1, 2, 3]
    assert ids({"interventional_only": True}) == [1, 3]
    assert ids({"interventional_only": True, "studyType": "INTERVENTIONAL"}) == [1, 3]
    assert ids({"interventional_only": True, "studyType": "OBSERVATIONAL"}) == []
    assert ids({"start_year": 2016}) == [2]
    assert ids({"end_year": 2015}) == [1]
    assert ids({"start_year": 2015, "end_year": 2016}) == [1, 2]
    assert ids(None, {"drug": "KEYTR"}) == [1]
    assert ids(None, {"cond": "(nsclc)"}) == [2]
    assert ids(None, {"sponsor": "or"}) == [3]
    assert ids(None, {"term": "A OR B"}) == [3]
    assert ids(None, {"condition": ""}) == [1, 2, 3]
    with pytest.raises(ValueError):
        predicate(None, {"planet": "x"})


def test_scalar_filters_reach_the_scan(spark, study_table, tmp_path):
    study_table([{"nct_id": nct(1), "overall_status": "COMPLETED"}]).write.parquet(str(tmp_path / "t"))
    trials = spark.read.parquet(str(tmp_path / "t"))
    done = distribution(filter_trials(trials, {"overallStatus": "COMPLETED"}), "phase", unique_ids=True, evidence_limit=0)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(overall_status,COMPLETED)" in plan
    assert "sponsor_name" not in plan and "interventions" not in plan
    kinds = distribution(trials, "interventionType", unique_ids=True, evidence_limit=0)
    schema = [line for line in kinds._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line][0]
    assert "otherNames" not in schema and F is not None


def test_samples_of_hot_buckets_are_cut_before_the_sort(spark):
    """A bucket with enough rows in the first ids keeps those only; late, rare and null ones keep all."""
    rows = [(nct(i), "hot") for i in range(2000)] + [(nct(i), "late") for i in range(1900, 2000)]
    rows += [(nct(7), "rare"), (None, "hot"), (nct(3), None)]
    table = spark.createDataFrame(rows, "nct_id string, value string").repartition(4)
    near = evidence.near_rows(table, table.select("nct_id").distinct(), ["value"], 3)
    left = Counter(r["value"] for r in near.collect())
    assert 4 <= left["hot"] < 300 and (left["late"], left["rare"], left[None]) == (100, 1, 1)
    found, plain = (sorted(map(str, evidence.first_per_bucket(t, ["value"], 3).collect())) for t in (near, table))
    assert found == plain and len(found) == 8
    assert evidence.near_rows(table.limit(0), table.select("nct_id").limit(0), ["value"], 3).count() == 0


def test_a_fold_makes_the_values_of_a_trial_once(study_table):
    trials = study_table([{"nct_id": f"NCT{i:08d}", "countries_raw": ["USA", "France"][: i % 3]} for i in range(9)])
    plan = distribution(trials, "country", unique_ids=True, top_n=1)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line and "countries_raw#" in line]
    assert scans and all("values#" in line for line in scans)
