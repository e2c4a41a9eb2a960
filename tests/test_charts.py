"""Series, histogram and comparison."""

from __future__ import annotations

import pytest
from conftest import nct

from trialspark.operators.compare import Arm, compare, compare_summary
from trialspark.operators.histogram import duration_histogram
from trialspark.operators.series import series_summary, timeseries


def starts(study_table, dates):
    return study_table([{"nct_id": nct(i), "start_date": d} for i, d in enumerate(dates)])


def points(series):
    return [(r["value"], r["period"], r["count_trials"]) for r in series.collect()]


def test_series(study_table):
    trials = starts(study_table, ["2019-04-12", "2019", "2021-02", "2026-01", "2030", None, "x", "2019-13"])
    series = timeseries(trials, current_year=2026)
    assert points(series) == [
        ("2019", "2019", 2), ("2020", "2020", 0), ("2021", "2021", 1), ("2022", "2022", 0), ("2023", "2023", 0),
        ("2024", "2024", 0), ("2025", "2025", 0), ("2026", "2026", 1), ("2030", "2030", 1), ("MISSING", None, 3),
    ]
    rows = {r["value"]: r for r in series.collect()}
    assert rows["2030"]["label"] == "2030 (planned)" and rows["2030"]["planned"]
    assert rows["2026"]["label"] == "2026 (partial)" and rows["2026"]["partial_year"]
    assert rows["MISSING"]["label"] == "Missing (no start date)"
    assert rows["2020"]["citations"] == [] and not rows["2020"]["citations_truncated"]
    assert rows["2019"]["citations"][0]["matched_value"] == "2019-04-12"
    summary = series_summary(series).first()
    assert (summary["degrade"], summary["gap_years"], summary["planned_years"], summary["missing_trials"], summary["sum_trials"]) == (
        False, 5, 1, 3, 8,
    )


@pytest.mark.parametrize(
    ("dates", "expected", "degrade"),
    [
        (["2030", "2035"], [("2030", "2030", 1), ("2035", "2035", 1)], False),
        ([None, ""], [("MISSING", None, 2)], True),
        (["2020", "2020-05"], [("2020", "2020", 2)], True),
        (["2020", "2031"], [("2020", "2020", 1), ("2031", "2031", 1)], False),
        (["0001-05"], [("1", "1", 1)], True),
    ],
)
def test_series_edges(study_table, dates, expected, degrade):
    series = timeseries(starts(study_table, dates), current_year=2026)
    assert points(series) == expected
    assert series_summary(series).first()["degrade"] is degrade


def test_series_arguments(study_table):
    with pytest.raises(ValueError):
        timeseries(starts(study_table, []), "endDate", current_year=2026)
    with pytest.raises(ValueError):
        timeseries(starts(study_table, []), current_year=2026, grain="month")


def spans(study_table, pairs):
    return study_table([{"nct_id": nct(i), "start_date": a, "completion_date": b} for i, (a, b) in enumerate(pairs)])


def test_histogram_default_bins(study_table):
    pairs = [("2000-01", f"{2000 + m // 12}-{m % 12 + 1:02d}") for m in (3, 8, 17, 36, 72, 180)]
    rows = duration_histogram(spans(study_table, pairs)).collect()
    assert [r["count_trials"] for r in rows] == [1] * 6
    assert [r["value"] for r in rows] == ["0–6 mo", "6–12 mo", "1–2 yr", "2–4 yr", "4–10 yr", "10+ yr"]
    assert [(r["bin_start"], r["bin_end"]) for r in rows][::5] == [(0.0, 6.0), (120.0, None)]


def test_histogram_undated_and_empty_bins(study_table):
    trials = spans(study_table, [("2000", "2001-01"), ("2002", "2001"), (None, "2001"), ("2001", None), ("2000-01", "2000-07")])
    rows = duration_histogram(trials).collect()
    assert [r["count_trials"] for r in rows] == [0, 1, 1, 0, 0, 0, 3]
    assert (rows[-1]["value"], rows[-1]["label"], rows[-1]["bin_start"]) == ("UNDATED", "Unknown (undated)", None)
    assert [c["matched_value"] for c in rows[-1]["citations"]] == ["2002", "", "2001"]
    assert rows[0]["citations"] == []


def test_histogram_custom_bins(study_table):
    trials = spans(study_table, [("2000-01", "2000-03"), ("2000-01", "2003-01"), ("2000-01", "2010-01")])
    rows = duration_histogram(trials, bins=[(None, 12), (60, None)]).collect()
    assert [(r["value"], r["count_trials"]) for r in rows] == [("0–12 mo", 1), ("60+ mo", 1), ("UNDATED", 1)]


def test_compare(study_table):
    trials = study_table(
        [{"nct_id": nct(i), "overall_status": "COMPLETED", "sponsor_class": "NIH", "study_type": "INTERVENTIONAL"} for i in range(2)]
        + [{"nct_id": nct(10), "overall_status": "RECRUITING", "sponsor_class": "NIH", "study_type": "OBSERVATIONAL"}]
        + [{"nct_id": nct(20), "overall_status": "WITHDRAWN", "sponsor_class": "FED", "study_type": "INTERVENTIONAL"}]
    )
    nih, fed, none = Arm("nih", filters={"sponsorClass": "NIH"}), Arm("fed", filters={"sponsorClass": "FED"}), Arm("none", filters={"sponsorClass": "INDIV"})

    def rows(*arms, **options):
        return [(r["value"], r["series"], r["count_trials"], r["percent"]) for r in compare(trials, "overallStatus", arms, **options).collect()]

    assert rows(nih, fed) == [
        ("COMPLETED", "nih", 2, 66.7), ("COMPLETED", "fed", 0, 0.0), ("RECRUITING", "nih", 1, 33.3),
        ("RECRUITING", "fed", 0, 0.0), ("WITHDRAWN", "nih", 0, 0.0), ("WITHDRAWN", "fed", 1, 100.0),
    ]
    assert rows(none, fed) == [("WITHDRAWN", "none", 0, 0.0), ("WITHDRAWN", "fed", 1, 100.0)]
    # The common toggle reaches every arm, and an arm's own key wins.
    assert [r for r in rows(nih, fed, common={"interventional_only": True}) if r[0] == "RECRUITING"] == []
    assert rows(nih, Arm("all"), common={"sponsorClass": "FED"})[0] == ("COMPLETED", "nih", 2, 66.7)
    cells = compare(trials, "overallStatus", (nih, fed)).collect()
    assert cells[1]["citations"] == [] and cells[0]["source_ids"] == [nct(0), nct(1)]
    with pytest.raises(ValueError):
        compare(trials, "overallStatus", (nih,))


def test_percent_ties_round_up(study_table):
    trials = study_table([{"nct_id": nct(i), "overall_status": "COMPLETED" if i else "WITHDRAWN"} for i in range(16)])
    arms = (Arm("a"), Arm("b", filters={"overallStatus": "COMPLETED"}))
    got = {(r["value"], r["series"]): r["percent"] for r in compare(trials, "overallStatus", arms).collect()}
    assert got[("WITHDRAWN", "a")] == 6.3


def test_arm_limit_and_drift(study_table):
    trials = study_table([{"nct_id": nct(i), "start_date": "2000"} for i in range(4)])
    arms = [Arm(f"a{i}", filters={"start_year": 1999}) for i in range(7)]
    assert not any(r["dropped"] for r in compare_summary(trials, arms).collect())
    rows = compare_summary(trials, arms, declared={"a0": 6}, max_arms=5).collect()
    assert [r["dropped"] for r in rows] == [False] * 5 + [True] * 2
    assert (rows[0]["arm_total"], rows[0]["drift"], rows[0]["status"]) == (4, 2, "ok")
    empty = compare_summary(trials, [Arm("x", filters={"start_year": 2050}), Arm("y", filters={"start_year": 2051})])
    assert {r["status"] for r in empty.collect()} == {"empty"}
    assert compare(trials, "phase", arms).select("series").distinct().count() == 7
    assert compare(trials, "phase", arms, max_arms=5).select("series").distinct().count() == 5
