"""Every registered query against its SQL, and the joins once more with nothing broadcast."""

import pytest

from __spark_entry__ import entry
from oracle import compare, connect
from schedlake.queries import ORACLES, QUERIES

JOINS = ["executions_with_definition", "detail_projection", "insert_if_absent", "cron_dispatch", "overlap_guard",
         "event_executions", "bad_triggers", "handler_resolution", "due_at_polls", "reconciliation", "apply_outcomes",
         "cascade_delete", "claim_executions", "missing_handlers", "execution_violations", "name_clashes",
         "overlapping_runs", "attempts", "cron_occurrences", "concurrency", "insert_definitions"]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, small, name):
    sql = ORACLES.get(name)
    df = QUERIES[name](spark, small)
    if sql is None:
        assert df.collect()
        return
    assert compare(spark, con, name, lambda *_: df, sql, small) is None


@pytest.mark.parametrize("name", JOINS)
def test_matches_sql_without_broadcast(spark, con, small, no_broadcast, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], small) is None


def test_entry(spark):
    assert entry(spark).columns == ["job_id", "handler_name", "scheduled_time", "status", "params", "param_source",
                                    "retry_count", "created_at"]
    entry(spark).collect()
