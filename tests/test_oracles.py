"""Registered jobs against their SQL on DuckDB; ``SOME_JOBS=1`` runs a few from each area only."""

import os

import pytest
from compare import compare, connect

from lisura.plans import jobs

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "exclusion_duplicate_rows", "exclusion_identical_copies", "flag_split_purchases_cluster", "flag_retroactive_edit",
    "screen_cover_bidding", "pairs_within_groups", "contracts_with_coverage", "flag_judged_events", "upsert_suppliers",
    "contract_violations", "masked_persons", "person_id_leaks",
)
QUERIES, SQL = jobs.queries(), jobs.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry_is_complete():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", SOME if os.environ.get("SOME_JOBS") else list(QUERIES))
def test_job_equals_sql(spark, con, name):
    ok, message = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, message
