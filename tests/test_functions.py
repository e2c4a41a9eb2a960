from __future__ import annotations

import hashlib

import pytest
from conftest import evaluate
from pyspark.sql import functions as F

from trialspark import fixed_values as fixed
from trialspark.functions import dates, names, paths, phases


def test_dates_of_mixed_precision(spark):
    values = ["2015", "2015-05", "2015-05-10", "2015-", "2015-13", "2015-00", "TBD", "", "  ", None, "0001-05", " 2015", "2015.5", "2015-05-xx"]
    assert evaluate(spark, dates.ct_year, values) == [
        2015, 2015, 2015, None, None, None, None, None, None, None, 1, 2015, None, 2015,
    ]
    assert evaluate(spark, dates.ct_month, values) == [
        None, 5, 5, None, None, None, None, None, None, None, 5, None, None, 5,
    ]
    assert evaluate(spark, dates.ct_precision, values)[:10] == [
        "year", "month", "day", "month", "month", "month", "year", None, None, None,
    ]


def test_future_is_strict(spark):
    assert evaluate(spark, lambda y: dates.is_future(y, 2026), [2026, 2027, 2025], "int") == [False, True, False]


def test_durations(spark):
    pairs = [("2020-01", "2020-04"), ("2020", "2021"), ("2020-05", "2020-04"), (None, "2020"), ("2020-01-31", "2020-02-01")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", dates.duration_months(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [3, 12, None, None, 1]


def test_bins_are_half_open(spark):
    months = [0, 5, 6, 12, 24, 48, 119, 120, 9999, None]
    assert evaluate(spark, lambda m: dates.bin_index(m, fixed.DURATION_BINS), months, "int") == [
        0, 0, 1, 2, 3, 4, 4, 5, 5, None,
    ]
    assert dates.bin_label(60, None) == "60+ mo"
    assert dates.bin_label(0, 12) == "0–12 mo"
    assert dates.bin_label(None, 12) == "0–12 mo"


@pytest.mark.parametrize(
    ("tokens", "key", "label"),
    [
        (None, "MISSING", "Missing (not reported)"),
        ([], "MISSING", "Missing (not reported)"),
        (["NA"], "NA", "NA (not applicable)"),
        (["PHASE2"], "PHASE2", "Phase 2"),
        (["PHASE2", "PHASE1"], "PHASE1|PHASE2", "Phase 1/2"),
        (["PHASE1", "PHASE1"], "PHASE1", "Phase 1"),
        (["PHASE1", "EARLY_PHASE1"], "EARLY_PHASE1|PHASE1", "Early Phase 1/Phase 1"),
        (["ZZZ", "PHASE3"], "PHASE3|ZZZ", "Phase 3/ZZZ"),
        (["odd"], "odd", "odd"),
    ],
)
def test_phase_keys(spark, tokens, key, label):
    assert evaluate(spark, phases.phase_key, [tokens], "array<string>") == [key]
    assert evaluate(spark, phases.phase_label, [key]) == [label]


def test_phase_order(spark):
    ordered = ["MISSING", "NA", "EARLY_PHASE1", "EARLY_PHASE1|PHASE1", "PHASE1", "PHASE1|PHASE2", "PHASE1|PHASE3", "PHASE2", "PHASE4", "odd"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "value string")
    assert [r["value"] for r in df.orderBy(*phases.phase_order(F.col("value"))).collect()] == ordered


def test_phase_text(spark):
    cases = {
        "Phase 1": ["PHASE1"], "phase-2": ["PHASE2"], "1": ["PHASE1"], "phase I": ["PHASE1"], "III": ["PHASE3"],
        "Early Phase 1": ["EARLY_PHASE1"], "early_phase1": ["EARLY_PHASE1"], "Phase 0": ["EARLY_PHASE1"],
        "N/A": ["NA"], "n.a.": ["NA"], "not applicable": ["NA"], "Phase 2/3": ["PHASE2", "PHASE3"],
        "1 and 2": ["PHASE1", "PHASE2"], "1 & 2": ["PHASE1", "PHASE2"], "phase1phase2": ["PHASE1", "PHASE2"],
        "2/1": ["PHASE2", "PHASE1"], "1, 1": ["PHASE1"], "Phase 4.": ["PHASE4"],
        "Phase 5": None, "": None, "phase": None, "soon": None, "1/7": None,
    }
    assert evaluate(spark, phases.normalize_phase_text, list(cases)) == list(cases.values())
    assert evaluate(spark, phases.normalize_phase_text, [None]) == [None]


def test_countries(spark):
    cases = {
        "USA": "United States", " u.s. ": "United States", "U.S.A.": "United States", "UK": "United Kingdom",
        "Great  Britain": "United Kingdom", "Korea, Republic of": "South Korea", "S. Korea": "South Korea",
        "Holland": "Netherlands", "the Netherlands": "Netherlands", "Russian\tFederation": "Russia",
        "Czech Republic": "Czechia", "Turkey (Türkiye)": "Turkey (Türkiye)", "  France ": "France", "": None, "  ": None,
        "Great   Britain": "United Kingdom", "New  Land": "New  Land",
    }
    assert evaluate(spark, names.canonical_country, list(cases)) == list(cases.values())


def test_drug_keys(spark):
    cases = {
        "Selumetinib, 100mg": "selumetinib", "Sunitinib Malate": "sunitinib", "Nab-paclitaxel": "nab paclitaxel",
        "5-FU": "5 fu", "Interleukin-2": "interleukin 2", "Drug0": "drug0", "Sodium Chloride": "sodium chloride",
        "Oral Solution": "oral", "Doxorubicin Hydrochloride 50 mg/m2 injection": "doxorubicin hydrochloride m2",
        "Lidocaine 5% cream": "lidocaine 5", "Drug 10mg/ml Solution": "drug ml", "Aspirin 1,5 g tablets": "aspirin",
        "Vitamin D 400 IU Oral Drops": "vitamin d",
    }
    assert evaluate(spark, names.drug_key, list(cases)) == list(cases.values())
    # A name without a-z0-9 keeps its own text, so that two such drugs stay apart.
    assert evaluate(spark, names.drug_key, ["阿司匹林", " Ω "]) == ["阿司匹林", "ω"]


def test_sponsor_keys(spark):
    cases = {
        "Pfizer Inc.": "pfizer", "PFIZER, INC": "pfizer", "Merck Sharp & Dohme LLC": "merck sharp dohme",
        "MSD": "merck sharp dohme", "Genentech, Inc.": "genentech", "Group": "group", "Acme Pharma Holdings Ltd": "acme",
        "ＡＣＭＥ Corp": "acme", "Eﬃcient Labs": "efficient",
    }
    assert evaluate(spark, names.sponsor_key, list(cases)) == list(cases.values())


def test_slugs(spark):
    assert evaluate(spark, names.slug, ["nab paclitaxel", "A  B!", "阿"]) == ["nab-paclitaxel", "a-b", hashlib.md5("阿".encode()).hexdigest()[:8]]


def test_placebo_and_combinations(spark):
    def placebo(name, others):
        df = spark.createDataFrame([(name, others)], "n string, o array<string>")
        return df.select(names.is_placebo(F.col("n"), F.col("o"))).first()[0]

    assert placebo("Matching PLACEBO tablet", None)
    assert placebo("Drug X", ["a", "Best Supportive Care"])
    assert not placebo("Drug X", ["standard", "of care"])
    assert not placebo("Drug X", None)
    texts = ["A + B", "A/B", "A plus B", "A and B", "A WITH B", "Sandoz", "Plusone", "A-B"]
    assert evaluate(spark, names.is_combination, texts) == [True] * 5 + [False] * 3


def test_labels(spark):
    assert evaluate(spark, names.status_label, ["ACTIVE_NOT_RECRUITING", "NO_LONGER_AVAILABLE", "UNKNOWN"]) == [
        "Active, not recruiting", "No Longer Available", "Unknown status",
    ]
    assert evaluate(spark, names.intervention_type_label, ["DIETARY_SUPPLEMENT", "NEW_KIND", "UNKNOWN"]) == [
        "Dietary Supplement", "NEW_KIND", "Unknown",
    ]
    assert evaluate(spark, names.title_case, ["OTHER_GOV", "NIH"]) == ["Other Gov", "Nih"]


@pytest.mark.parametrize(
    ("quote", "value", "is_array", "expected"),
    [
        ("PHASE1", ["PHASE1", "PHASE2"], True, True),
        ("PHASE1", ["PHASE10"], True, False),
        ("COMPLET", ["COMPLETED"], False, True),
        ("Atlantis", ["France"], True, False),
        ("", [], True, True),
        ("", None, True, True),
        ("", [""], False, True),
        ("", ["France"], True, False),
        ("x", [], True, False),
        ("x", None, False, False),
    ],
)
def test_quotes(spark, quote, value, is_array, expected):
    df = spark.createDataFrame([(quote, value, is_array)], "q string, v array<string>, a boolean")
    assert df.select(paths.quoted_in(F.col("q"), F.col("v"), F.col("a"))).first()[0] is expected
