"""Dispatch, uniqueness, bulk changes and numbering."""

from datetime import datetime

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.operators import changes
from schedlake.operators.dispatch import insert_if_absent
from schedlake.operators.joins import missing
from schedlake.operators.views import page, with_definition
from schedlake.plans.cron_dispatch import dispatch
from schedlake.schemas import EXECUTION_COLUMNS, empty_executions, execution_defaults

import pytest


def test_dispatch_twice_is_dispatch_once(spark, small):
    defs, none = fx.definitions(spark, small), empty_executions(spark)
    first = dispatch(defs, none, fx.AS_OF).created
    stored = changes.assign_ids(first, ["job_id", "scheduled_time"], 0)
    done = stored.withColumn("status", F.lit("SUCCESS"))
    assert first.count() > 0
    assert dispatch(defs, done, fx.AS_OF).created.count() == 0
    # While they wait, definitions without overlap stay quiet at the next tick too.
    later = dispatch(defs, stored, "2024-01-15 09:15:30").created.select("job_id").collect()
    quiet = {r.id for r in defs.filter("NOT allow_overlap").collect()}
    assert not quiet & {r.job_id for r in later} & {r.job_id for r in stored.collect()}


def test_dispatch_catching_up_over_a_long_window(spark, small):
    defs = fx.definitions(spark, small)
    short = dispatch(defs, empty_executions(spark), fx.AS_OF, 3600, catch_up=True).created
    long = dispatch(defs, empty_executions(spark), fx.AS_OF, 3601, catch_up=True).created
    columns = ["job_id", "scheduled_time"]
    assert sorted(map(tuple, short.select(columns).collect())) == sorted(map(tuple, long.select(columns).collect()))


def test_rows_without_job_never_conflict(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, None, "h", t), (2, None, "h", t), (3, 7, "h", t), (4, 7, "h", t), (5, 8, "h", t)],
                                 "id long, job_id long, handler_name string, scheduled_time timestamp_ntz")
    new = execution_defaults(rows, t)
    existing = new.filter("job_id = 8 OR job_id IS NULL")
    kept = insert_if_absent(new, existing).select("id").collect()
    assert sorted(r.id for r in kept) == [1, 2, 3]


def test_a_key_that_holds_a_third_of_all_rows(spark, no_broadcast):
    t = datetime(2024, 1, 1)
    rows = spark.range(30000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS job_id", "'h' AS handler_name").withColumn(
        "scheduled_time", F.lit(t).cast("timestamp_ntz"))
    new = execution_defaults(rows, t)
    assert insert_if_absent(new, empty_executions(spark)).count() == 20001
    defs = spark.range(1, 500).selectExpr("id", "concat('n', id) AS name", "cast(id % 4 AS INT) AS max_retry",
                                          "60 AS timeout_seconds")
    joined = with_definition(new, defs)
    assert joined.count() == 30000
    assert joined.filter("job_id IS NULL AND max_retry <> 3").count() == 0
    assert joined.filter("job_id = 1 AND cron_name <> 'n1'").count() == 0
    # Rows without a job are spread: no partition of the join holds most of them.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = with_definition(new, defs).filter("job_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 5000


def test_numbering_is_gapless_and_stable(spark):
    rows = spark.range(5000).selectExpr("cast(NULL AS BIGINT) AS id", "concat('n', id) AS name")
    numbered = changes.assign_ids(rows, ["name"], 100)
    ids = {r.name: r.id for r in numbered.collect()}
    assert sorted(ids.values()) == list(range(101, 5101))
    again = {r.name: r.id for r in changes.assign_ids(rows.repartition(13), ["name"], 100).collect()}
    assert ids == again


def test_missing_keeps_key_columns(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "id long, note string")
    assert [tuple(r) for r in missing(keys, spark.range(5), "id").collect()] == [(9, "c")]


def test_page_bounds(spark):
    for bad in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            page(spark.range(3), ["id"], *bad)


def test_exhausted_runs_fail_and_others_wait_again(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, "RUNNING", 0), (2, 1, "RUNNING", 1), (3, 1, "RUNNING", 2), (4, 2, "RUNNING", 0), (5, None, "RUNNING", 1),
            (6, 1, "SUCCESS", 0)]
    execs = execution_defaults(spark.createDataFrame(rows, "id long, job_id long, status string, retry_count int").withColumns(
        {"handler_name": F.lit("h"), "scheduled_time": F.lit(t).cast("timestamp_ntz")}), t)
    defs = spark.createDataFrame([(1, "a", 3, 60), (2, "b", 1, 60)],
                                 "id long, name string, max_retry int, timeout_seconds int")
    failures = execs.select("id", F.lit("boom").alias("error_message"))
    got = {r.id: (r.status, r.retry_count, r.error_message) for r in changes.fail(execs, failures, defs, t).collect()}
    assert got == {1: ("PENDING", 1, "boom"), 2: ("PENDING", 2, "boom"), 3: ("FAILED", 3, "boom"),
                   4: ("FAILED", 1, "boom"), 5: ("PENDING", 2, "boom"), 6: ("SUCCESS", 0, None)}
    timed = {r.id: (r.status, r.error_message) for r in changes.time_out(execs, execs.select("id"), defs, t).collect()}
    assert timed[3] == ("TIMEOUT", "Execution timed out") and timed[1] == ("PENDING", "Execution timed out")
    assert changes.fail(execs, failures, defs, t).columns == EXECUTION_COLUMNS


def test_guard_over_the_whole_history(spark, small):
    from schedlake.queries import QUERIES

    quiet = {r.id for r in fx.definitions(spark, small).filter("NOT allow_overlap").collect()}
    busy = {r.job_id for r in fx.executions(spark, small).filter("status IN ('PENDING', 'RUNNING')").collect()}
    got = {r.id for r in QUERIES["overlap_guard_whole_history"](spark, small).collect()}
    assert got & quiet and not got & quiet & busy


def test_guard_queries_carry_narrow_ticks(spark, small):
    """Due ticks hold only what the guard reads: a definition's texts are not copied to each of them."""
    from schedlake.queries import QUERIES

    for name in ("overlap_guard", "overlap_guard_whole_history"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" in plan and "handler_params" not in plan and "year_days" not in plan.split("Generate posexplode")[0]
