"""Registered queries against their SQL, on the smallest data folder.

All of them with ALL_QUERIES=1; otherwise one per operator family.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from trialspark.plans.oracles import ORACLES
from trialspark.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

FAMILIES = (
    "study_records", "nested_paths", "first_row_wins", "filter_stacked", "search_term", "phase_text", "drug_names",
    "evidence_phase", "evidence_country_top3", "distribution_country_repeats", "token_counts_intervention_type",
    "series_with_gap", "histogram_custom", "compare_country_top5", "drug_drug_edges", "sponsor_drug_nodes", "sponsor_drug_edges", "drug_frequency_fallback",
    "audit_release", "audit_stored_results",
)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["position", "value", "label", "count_trials", "count_mentions"]


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else FAMILIES)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR) is None
