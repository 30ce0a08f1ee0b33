"""Folded streams against the fold of the whole log: order, deletes, late rows, restarts, bounds."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from schedlake.operators.lifecycle import advance, current_state
from schedlake.queries.streams import stream_of_parts
from schedlake.session import run_folder
from schedlake.streaming import folding

LOG = "execution_id long, ts timestamp_ntz, seq long, kind string, error_message string, result string, limit int, part int"
KINDS = ["claim", "claim", "complete", "fail", "timeout", "retry"]


def log(n_executions=30, days=8, deletes=True, seed=1):
    """Rows whose parts overlap: a row arrives up to five minutes after others of its time."""
    from datetime import datetime, timedelta

    rng, rows, seq = random.Random(seed), [], 0
    at = datetime(2024, 3, 1)
    while at < datetime(2024, 3, 1) + timedelta(days=days):
        at += timedelta(seconds=rng.choice([0, 1, 60, 600, 3000]))
        kind = "delete" if deletes and rng.random() < 0.02 else rng.choice(KINDS)
        i = 0 if rng.random() < 0.4 else rng.randrange(n_executions)
        part = (at + timedelta(minutes=rng.randrange(6)) - datetime(2024, 3, 1)).days
        rows.append((i, at, seq, kind, f"e{seq}" if kind == "fail" else None, f"r{seq}" if kind == "complete" else None, 1 + (i + seq % 2) % 4,
                     min(part, days - 1)))
        seq += 1
    return rows


def run(spark, rows, parts, folder, **options):
    df = spark.createDataFrame(rows, LOG)
    stream = stream_of_parts(spark, df, F.col("part"), parts)
    folding.fold_stream(stream, folder, f"{folder}-checkpoint", F.col("limit"), **options).awaitTermination()


def counted(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("slice_unit", ["hour", "day"])
def test_equal_to_the_whole_log(spark, no_broadcast, slice_unit):
    rows, folder = log(), run_folder(spark, "folded")
    run(spark, rows, 8, folder, keep_for="400 days", slice_unit=slice_unit)
    got = folding.folded_state(spark, folder, slice_unit)
    assert counted(got) == counted(current_state(spark.createDataFrame(rows, LOG), F.col("limit")))
    assert folding.late_transitions(spark, folder) == 0


def test_late_rows_are_left_out_and_counted(spark):
    rows, folder = log(deletes=False), run_folder(spark, "folded")
    late = [r[:7] + (7,) for r in rows[:25]]  # days behind
    run(spark, rows[25:] + late, 8, folder, keep_for="400 days")
    assert folding.late_transitions(spark, folder) == 25
    assert counted(folding.folded_state(spark, folder)) == counted(current_state(spark.createDataFrame(rows[25:], LOG), F.col("limit")))


def test_ended_executions_leave_the_states(spark):
    from datetime import datetime, timedelta

    rows = []
    for i in range(200):  # one after the other, of which every fifth is deleted and every seventh never ends
        at = datetime(2024, 3, 1) + timedelta(hours=i)
        rows.append((i, at, 2 * i, "claim", None, None, 1, i // 20))
        end = "delete" if i % 5 == 0 else "complete"
        if i % 7:
            rows.append((i, at + timedelta(minutes=1), 2 * i + 1, end, None, None, 1, i // 20))
    folder = run_folder(spark, "folded")
    run(spark, rows, 10, folder, keep_for="12 hours")
    stored = folding.stored_states(spark, folder)
    open_runs = len([i for i in range(200) if i % 7 == 0])
    assert stored.count() <= open_runs + 15
    assert stored.where("state.status = 'RUNNING'").count() >= open_runs - 1
    assert counted(folding.folded_state(spark, folder)) == counted(current_state(spark.createDataFrame(rows, LOG), F.col("limit")))


def test_a_micro_batch_that_is_run_again_changes_nothing(spark):
    rows, folder = log(days=3), run_folder(spark, "folded")
    columns = "execution_id", "ts", "seq", "kind", "error_message", "result", F.col("limit").alias("max_retry")
    df = spark.createDataFrame(rows, LOG)
    store = folding.StateFolder(spark, folder)
    for batch in (0, 1, 1, 2, 2, 2):
        part = df.where(F.col("part") == batch).select(*columns)
        folding.fold_batch(folding.StateFolder(spark, folder) if batch == 2 else store, part, batch, "10 minutes", "400 days", "hour")
    assert counted(folding.folded_state(spark, folder)) == counted(current_state(df, F.col("limit")))


def test_an_empty_stream_and_states_without_rows(spark):
    folder = run_folder(spark, "folded")
    store = folding.StateFolder(spark, folder)
    empty = spark.createDataFrame([], folding.ROWS_SCHEMA)
    folding.fold_batch(store, empty, 0, "10 minutes", "1 day", "hour")
    assert folding.folded_state(spark, folder).count() == 0
    states, _, _ = store.before()
    assert advance(states, empty).count() == 0
