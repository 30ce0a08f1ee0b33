"""The distributed fold against a sequential one, with hot executions and tiny chunks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from schedlake.operators.lifecycle import attempts, current_state, overlaps
from schedlake.schemas import TRANSITION_SCHEMA
from schedlake.streaming.state import STATE_FIELDS, advance


def max_retry():
    return F.col("execution_id") % 5

SETTINGS = [{}, {"chunk_rows": 7, "raw_rows": 3}, {"chunk_rows": 2, "raw_rows": 0, "slice_unit": "minute"}]


def fresh():
    return dict(status="PENDING", retry_count=0, started_at=None, finished_at=None, error_message=None, result=None,
                applied=0, ignored=0)


def sequential(rows):
    states, tries = {}, {}
    for key, ts, _, kind, error, result in sorted(rows, key=lambda r: (r[1], r[2])):
        state = states.setdefault(key, fresh())
        before = state["applied"]
        advance(state, kind, ts, error, result, key % 5)
        if state["applied"] == before:
            continue
        mine = tries.setdefault(key, [])
        if kind == "claim":
            mine.append([ts, None, None, None])
        elif kind in ("complete", "fail", "timeout"):
            mine[-1][1:] = [ts, kind, state["error_message"] if kind != "complete" else None]
    return {k: s for k, s in states.items() if s["status"] != "DELETED"}, {k: t for k, t in tries.items() if t}


def random_log(seed, executions, rows, kinds, hours=40):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(rng.choice(executions), start + timedelta(seconds=rng.randrange(hours * 3600)), i, rng.choice(kinds),
             f"e{i}" if i % 3 else None, f"r{i}" if i % 4 else None) for i in range(rows)]


LOGS = {
    "mixed": random_log(1, list(range(12)), 900, ["claim", "complete", "fail", "timeout", "retry", "delete"]),
    "never done": random_log(2, list(range(9)), 1500, ["claim", "claim", "fail", "timeout", "retry"]),
    "one hot": random_log(3, [4] * 50 + list(range(10)), 3000, ["claim", "fail", "timeout", "retry"], hours=3),
}


@pytest.mark.parametrize("name", LOGS)
@pytest.mark.parametrize("sizes", SETTINGS)
def test_state_and_attempts(spark, name, sizes):
    log = LOGS[name]
    df = spark.createDataFrame(log, TRANSITION_SCHEMA).repartition(5)
    states, tries = sequential(log)
    got = {r.execution_id: {f: r[f] for f in STATE_FIELDS} for r in current_state(df, max_retry(), **sizes).collect()}
    assert got == states
    mine = {}
    for r in sorted(attempts(df, max_retry(), **sizes).collect(), key=lambda r: (r.execution_id, r.attempt)):
        mine.setdefault(r.execution_id, []).append([r.claimed_at, r.ended_at, r.outcome, r.error_message])
        assert r.attempt == len(mine[r.execution_id])
    # The outcome of a timeout is reported with its fixed text.
    assert mine == tries


def test_input_order_does_not_matter(spark):
    log = LOGS["mixed"]
    shuffled = random.Random(5).sample(log, len(log))
    one, two = (sorted(map(tuple, current_state(spark.createDataFrame(x, TRANSITION_SCHEMA), max_retry()).collect()),
                       key=str) for x in (log, shuffled))
    assert one == two


def test_no_fold_runs_twice(spark):
    plan = current_state(spark.createDataFrame(LOGS["mixed"], TRANSITION_SCHEMA), max_retry())
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in text.split("Aggregate")[0]


def test_overlaps_carry_over_hours(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    runs = []
    for i in range(400):
        begin = start + timedelta(seconds=rng.randrange(20 * 3600))
        end = begin + timedelta(seconds=rng.randrange(9000)) if rng.random() < 0.97 else None
        runs.append((i, rng.choice([1, 1, 1, 2, 3, None]), begin, end))
    execs = spark.createDataFrame(runs, "id long, job_id long, started_at timestamp_ntz, finished_at timestamp_ntz")
    defs = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, allow_overlap boolean")
    wanted = set()
    for i, job, begin, _ in runs:
        if job in (1, 2):
            earlier = [e or datetime(9999, 12, 31) for j, k, b, e in runs if k == job and (b, j) < (begin, i)]
            if earlier and max(earlier) > begin:
                wanted.add((i, job, begin, max(earlier)))
    assert set(map(tuple, overlaps(execs, defs).collect())) == wanted
