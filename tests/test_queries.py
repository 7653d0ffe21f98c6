"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differs

import __spark_entry__ as entry

from chatprep.plans.oracle import ORACLE_SQL as SQL
from chatprep.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, small, con, name):
    assert differs(QUERIES[name](spark, small), con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_both_guard_reasons_occur(spark, small):
    found = {r["reason"] for r in QUERIES["reject_report"](spark, small).collect()}
    assert found == {"image_mismatch", "orphan_placeholder"}


def test_flagship(spark):
    made = entry.entry(spark).collect()
    assert sorted(r["pack_id"] for r in made) == list(range(len(made)))
    for r in made:
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["position_ids"]) == r["n_tokens"] <= 2048
        assert r["segments"][0]["start"] == 0 and r["segments"][-1]["end"] == r["n_tokens"]
        starts = [i for i, p in enumerate(r["position_ids"]) if p == 0]
        assert starts == [s["start"] for s in r["segments"]]
        assert all(a in (b, -100) for a, b in zip(r["labels"], r["input_ids"]))
