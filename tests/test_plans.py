"""Properties every batch plan must keep, with nothing small enough to broadcast."""

import pytest

from schedlake.queries import QUERIES

# These run a job of their own and return what they wrote.
WRITERS = ("stream", "ingested", "appended", "changed_days", "_days", "published", "stored", "quarantined", "deduplicated")
BATCH = sorted(n for n in QUERIES if not any(w in n for w in WRITERS) or n == "hourly_stats")


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_join(spark, small, no_broadcast, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _plan(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_top_n_per_job_is_trimmed_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in _plan(spark, small, "latest_runs_per_job").split("Exchange")[1]


def test_pages_and_queues_use_top_k(spark, small):
    for name in ("definitions_page", "executions_page", "pending_queue", "recent_executions"):
        assert "TakeOrderedAndProject" in _plan(spark, small, name)


def test_scans_read_only_what_they_need(spark, small):
    plan = _plan(spark, small, "execution_stats")
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_current_state_shuffles_twice(spark, small):
    assert _plan(spark, small, "current_state").count("Exchange") == 2
