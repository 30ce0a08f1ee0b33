"""Snapshots, appended tables and named statements."""

import pytest
from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.operators.changes import retain, retry
from schedlake.plans.named_queries import NamedQueries
from schedlake.session import run_folder, shared_folder
from schedlake.sources.snapshots import Conflict, publish_snapshot, read_snapshot
from schedlake.sources.tables import append_executions, change_days, read_executions, read_stored, retain_days


def test_snapshot_of_itself(spark, small):
    folder = run_folder(spark, "snap")
    publish_snapshot(fx.definitions(spark, small), folder)
    old = read_snapshot(spark, folder)
    publish_snapshot(old.filter("id > 5"), folder)
    assert read_snapshot(spark, folder).count() == 5
    assert old.count() == 10


def test_date_range_prunes_partitions(spark, small):
    folder = run_folder(spark, "exec")
    append_executions(fx.executions(spark, small), folder)
    rows = read_executions(spark, folder, "2024-01-10 06:00:00", "2024-01-12 00:00:00")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    wanted = fx.executions(spark, small).filter(
        "created_at >= timestamp_ntz '2024-01-10 06:00:00' AND created_at < timestamp_ntz '2024-01-12 00:00:00'")
    assert rows.count() == wanted.count() > 0


def test_only_touched_days_are_rewritten(spark, small):
    folder = run_folder(spark, "days")
    execs = fx.executions(spark, small)
    append_executions(execs, folder)
    before = {r[0] for r in read_stored(spark, folder).select(F.input_file_name()).distinct().collect()}
    ids = execs.filter("status = 'FAILED' AND created_at < timestamp_ntz '2024-01-04 00:00:00'").select("id")
    change_days(spark, folder, ids, lambda part: retry(part, ids).table)
    after = {r[0] for r in read_stored(spark, folder).select(F.input_file_name()).distinct().collect()}
    assert len(before - after) == 3
    wanted = retry(execs, ids).table
    got = read_executions(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    change_days(spark, folder, spark.createDataFrame([(-1,)], "id long"), lambda part: 1 / 0)


def test_retention_drops_whole_days(spark, small):
    folder = run_folder(spark, "retain")
    execs = fx.executions(spark, small)
    done = execs.withColumn("status", F.expr("IF(day(created_at) < 6, 'SUCCESS', status)"))
    append_executions(done, folder)

    def files():
        rows = read_stored(spark, folder).select("created_date", F.input_file_name().alias("f")).distinct().collect()
        return {(str(r[0]), r[1]) for r in rows}

    before = files()
    retain_days(spark, folder, "2024-01-08 12:00:00")
    after = files()
    assert not {f for f in after if f[0] < "2024-01-06"}
    assert {f for f in before if f[0] > "2024-01-08"} == {f for f in after if f[0] > "2024-01-08"}
    wanted = retain(done, "2024-01-08 12:00:00")
    assert sorted(map(str, read_executions(spark, folder).collect())) == sorted(map(str, wanted.collect()))


def test_a_stale_snapshot_is_refused(spark, small):
    folder = run_folder(spark, "stale")
    defs = fx.definitions(spark, small)
    first = publish_snapshot(defs, folder)
    publish_snapshot(defs.filter("id > 5"), folder, based_on=first)
    with pytest.raises(Conflict):
        publish_snapshot(defs, folder, based_on=first)
    assert read_snapshot(spark, folder).count() == 5


def test_named_statements(spark, small):
    named = NamedQueries()
    assert named.names() == ["job_history", "status_totals", "waiting_runs"]
    # An argument is a value, never SQL text.
    rows = named.run(spark, "job_history", {"executions": fx.executions(spark, small)}, job_id=2, status="' OR 1=1 --")
    assert rows.count() == 0


class _Session:
    """Stands for a session with given settings."""

    def __init__(self, **settings):
        self.conf = self
        self._settings = settings

    def get(self, name, default=None):
        return self._settings.get(name, default)


def test_shared_folder_comes_from_the_session():
    named = _Session(**{"spark.checkpoint.dir": "hdfs://lake/scratch/", "spark.master": "yarn"})
    assert shared_folder(named) == "hdfs://lake/scratch"
    assert shared_folder(_Session(**{"spark.master": "local[4]"})) == shared_folder(_Session())
    with pytest.raises(ValueError):
        shared_folder(_Session(**{"spark.master": "yarn"}))
