"""Registered queries beside their DuckDB statements.

A spread of queries by default; LAKESTATE_ALL=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import check, connection

ROOT = os.environ.get("LAKESTATE_DATA", "/root/testdata/sf0.001")
SPREAD = [
    "state_resolution", "applied_retractions", "conflict_evidence", "timeline_lookup", "entity_resolution", "bm25_budget",
    "prior_ranking_budget", "edge_selection", "merkle_tree", "opaque_diff", "writeback_convergence", "record_violations",
    "feed_numbers", "slot_retractions", "capsule_build", "artifact_as_of", "journal_outcomes", "policy_hidden_conflicts",
    "markdown_files", "calendar_slots", "byte_bounded_pages", "stream_audit",
]
NAMES = sorted(entry.queries()) if os.environ.get("LAKESTATE_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connection(ROOT)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="test data absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, *_ = check(spark, con, ROOT, name, entry.queries(), entry.oracle_sql())
    assert problem is None


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
