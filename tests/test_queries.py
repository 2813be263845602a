import pytest

from quarry.plans import details
from quarry.plans import ingest as _ingest  # registers its queries
from quarry.plans import queries as Q


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_oracle(name, same):
    same(Q.QUERIES[name], Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_runs(name, spark, sf):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_details_are_registered():
    assert {n for n in Q.QUERIES if Q.QUERIES[n].__module__ == details.__name__} >= {"f14_messages", "r13_retry_states"}


def test_flagship(spark, sf):
    rows = Q.flagship(spark, sf).collect()
    assert rows and {r["source_id"] for r in rows} <= {"S1", "S2", "S3", "S4", "S5"}


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        reloaded = importlib.reload(entry)
        assert set(reloaded.queries()) == set(Q.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
