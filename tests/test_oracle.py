"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from codonlake.plans.oracle_base import run_shared

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
SHARES = ("prob", "hybrid_prob", "auroc", "accuracy", "precision", "recall", "f1", "near_edited", "near_next", "score", "importance")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert compare(got, run_shared(con, SQL[name]).fetchdf()) == "ok"
        return
    # fitted or sampled results: rows, no duplicates of a key, and shares within their range
    assert len(got.columns) > 0 and (len(got) > 0 or name in ("op4_collinear_chains", "group_filter", "start_classifier"))
    for column in set(SHARES) & set(got.columns):
        known = got[column].dropna()
        assert ((known >= 0) & (known <= 1)).all(), column
    if "doc_id" in got.columns and name != "pipeline":
        assert got["doc_id"].is_unique


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
