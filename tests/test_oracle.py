"""Every query with SQL gives the rows DuckDB gives; every other query gives rows.

The tables ten times as large are for one query of each kind; FULL=1 takes all.
"""

import os

import pytest

import __spark_entry__ as entry
import compare

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def databases():
    return {folder: compare.database(folder) for folder in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_small_tables_agree(spark, databases, name):
    assert compare.differences(spark, SMALL, name, databases[SMALL]) is None


# Short queries that between them read every table the others read.
QUICK = {
    "rfm_inputs", "quantile_score_by_nation", "lift_by_decile", "bgnbd_histories", "bgbb_histories", "complaint_summaries",
    "survivor_curves", "active_customers", "transition_estimates_sparse", "choice_paths_sparse", "clv_summary",
    "shape_of_events", "csv_round_trip", "safe_documents", "sbg_best_likelihoods", "customer_equity_at_given",
}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql() if os.environ.get("FULL") else QUICK))
def test_medium_tables_agree(spark, databases, name):
    assert compare.differences(spark, MEDIUM, name, databases[MEDIUM]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_fits_give_rows(spark, name):
    assert not entry.queries()[name](spark, SMALL).isEmpty()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["RFM_segment", "customers"]
