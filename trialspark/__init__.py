"""Analytics over nested clinical-study records, as Spark DataFrame plans."""

from trialspark.operators.audit import (
    audit_citations,
    audit_citations_against,
    audit_counts,
    audit_notes,
    release_check,
    verify_results,
    verify_stored,
)
from trialspark.operators.compare import Arm, arm_rows, compare, compare_summary
from trialspark.operators.evidence import citations_index
from trialspark.operators.fields import FIELDS, FieldSpec
from trialspark.operators.filters import filter_trials
from trialspark.operators.grouping import (
    count_basis,
    count_trials,
    distribution,
    fold_members,
    group_summary,
    population_gate,
    single_value,
    token_counts,
    with_position,
)
from trialspark.operators.histogram import duration_histogram
from trialspark.operators.network import build_network
from trialspark.operators.series import series_summary, timeseries
from trialspark.sources.adapter import trials_from_orders
from trialspark.sources.reader import (
    dedupe_trials,
    flatten_studies,
    read_studies,
    read_trials,
    split_valid_ids,
)
from trialspark.sources.sink import commit_results, read_results, result_edges, result_rows, store_results, stored_problems, write_results

__all__ = [name for name in dir() if not name.startswith("_")]
