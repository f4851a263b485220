"""Registered queries against DuckDB: a cross-section by default, all of them with TRAJLENS_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "step_ledger_both", "trajectory_ledger", "failure_decomposition_with_preferences", "top_k_sensitivity", "repair_multiplicity",
    "evaluate_ranking", "bootstrap_ranking", "make_splits_by_seed", "label_edits", "episode_metrics", "paired_comparison",
    "candidate_priorities", "parse_candidate_responses", "merge_summary", "action_relations", "branch_outcomes", "rerank_prior",
    "rerank_nn_memory", "stream_ledger_counts", "stream_trajectories",
)
NAMES = tuple(entry.queries()) if os.environ.get("TRAJLENS_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    problem = compare(spark, duck(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == "", problem


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
