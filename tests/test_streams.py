"""Streams over several micro-batches, restarts and deadlines."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.operators.lifecycle import current_state
from schedlake.plans.event_dispatch import event_id, ingest
from schedlake.queries.streams import KEYED_EXECUTIONS, run_to_end
from schedlake.schemas import TRANSITION_SCHEMA, TRIGGER_SCHEMA
from schedlake.session import run_folder
from schedlake.sources.tables import read_executions
from schedlake.sources.triggers import kafka_options, read_trigger_files
from schedlake.streaming import ingest as si
from schedlake.streaming.state import PROVIDER, deadline_stream, state_stream
from schedlake.streaming.stats import late_rows, windowed_stats


def _files(df, folder, order, parts=4):
    """The rows as files that sort by time, one per micro-batch."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) / parts
    for i in range(parts):
        edge = F.col(order) >= low + i * step
        last = F.col(order) < low + (i + 1) * step if i < parts - 1 else F.lit(True)
        df.filter(edge & last).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_state_over_micro_batches_equals_batch(spark, small):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    log = fx.transitions(spark, small)
    folder = _files(log, run_folder(spark, "transitions"), "ts")
    stream = spark.readStream.schema(TRANSITION_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    updates = run_to_end(spark, state_stream(stream, F.col("execution_id") % 5), "state", "update")
    assert updates.select("batch").distinct().count() == 4
    fields = [c for c in updates.columns if c not in ("execution_id", "batch")]
    last = updates.groupBy("execution_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select(
        "execution_id", "s.*")
    batch = current_state(log, F.col("execution_id") % 5)
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_ingest_restarts_without_doubles(spark, small):
    folder = run_folder(spark, "triggers")
    defs = fx.definitions(spark, small)
    source = fx.triggers(spark, small)
    source.filter("msg_offset < 100").coalesce(1).write.parquet(f"{folder}/in")

    def run(checkpoint, **options):
        stream = read_trigger_files(spark, f"{folder}/in")
        si.trigger_ingest(stream, defs, f"{folder}/good", f"{folder}/bad", f"{folder}/{checkpoint}",
                          **options).awaitTermination()

    run("first")
    source.filter("msg_offset >= 100").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run("first")
    run("first")
    good = si.read_ingested(spark, f"{folder}/good", KEYED_EXECUTIONS)
    bad = si.read_quarantined(spark, f"{folder}/bad")
    key = ["msg_topic", "msg_partition", "msg_offset"]
    assert good.count() + bad.count() == source.count()
    assert good.select(key).distinct().count() == good.count()
    run("second")
    assert si.read_ingested(spark, f"{folder}/good", KEYED_EXECUTIONS).count() == good.count()


def test_a_replayed_batch_is_stored_once(spark, small):
    folder = run_folder(spark, "replay")
    batch = ingest(fx.triggers(spark, small), fx.definitions(spark, small)).created
    si.exactly_once_append(batch.filter("id % 3 = 0"), folder)  # an attempt that stored a part
    for _ in range(2):
        si.exactly_once_append(batch, folder)
    stored = read_executions(spark, folder)
    assert stored.count() == batch.count() == stored.select("id").distinct().count()
    assert stored.filter("id IS NULL").isEmpty()


def test_event_ids(spark):
    rows = spark.createDataFrame([("b", 2, 5), ("a", 16383, 1099511627775)], "msg_topic string, msg_partition int, msg_offset long")
    got = [r[0] for r in rows.select(event_id(["a", "b"])).collect()]
    assert got == [(1 << 62) + (1 << 54) + (2 << 40) + 5, (1 << 62) + (16383 << 40) + 1099511627775]
    with pytest.raises(Exception, match="no event id"):
        rows.select(event_id(["a"])).collect()


def test_deadlines(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    t = datetime(2024, 1, 1)
    log = [(1, t, 1, "claim"), (1, t + timedelta(seconds=50), 2, "complete"),      # in time
           (2, t, 3, "claim"), (2, t + timedelta(seconds=500), 4, "complete"),     # late end
           (3, t, 5, "claim"),                                                     # no end
           (4, t + timedelta(hours=5, seconds=-10), 6, "claim"),                   # still running
           (5, t, 7, "claim"), (5, t + timedelta(seconds=200), 8, "claim"), (5, t + timedelta(seconds=210), 9, "fail"),
           (9, t + timedelta(hours=5), 10, "retry")]
    rows = spark.createDataFrame([(*r, None, None) for r in log], TRANSITION_SCHEMA)
    folder = run_folder(spark, "log")
    rows.coalesce(1).write.parquet(folder)
    timeouts = spark.createDataFrame([(i, 100) for i in range(10)], "execution_id long, timeout_seconds int")
    stream = spark.readStream.schema(TRANSITION_SCHEMA).parquet(folder)
    out = run_to_end(spark, deadline_stream(stream, timeouts), "deadlines")
    got = {(r.execution_id, r.deadline - r.started_at) for r in out.collect()}
    assert got == {(2, timedelta(seconds=100)), (3, timedelta(seconds=100)), (5, timedelta(seconds=100))}


def test_late_rows_are_dropped_and_counted(spark):
    t = datetime(2024, 1, 1)
    folder = run_folder(spark, "late")
    schema = "created_at timestamp_ntz, status string"
    # Late rows are judged by the watermark of the micro-batch before, so the late one comes third.
    for rows in ([(t, "SUCCESS"), (t + timedelta(hours=3), "FAILED")], [(t + timedelta(hours=3), "FAILED")],
                 [(t + timedelta(minutes=1), "SUCCESS")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = windowed_stats(stream, "1 hour").writeStream.format("memory").queryName("late_stats").outputMode(
        "append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.table("late_stats").collect()
    assert [(r.window_start, r.total) for r in closed] == [(t, 1)]
    assert late_rows(query) == 1


def test_trigger_file_stream_schema(spark, small):
    folder = run_folder(spark, "tf")
    fx.triggers(spark, small).write.parquet(folder)
    assert read_trigger_files(spark, folder, 1).schema.fieldNames() == TRIGGER_SCHEMA.fieldNames()
    assert kafka_options("b:9092", "t", max_offsets=10)["maxOffsetsPerTrigger"] == "10"


def test_deadlines_follow_definitions(spark):
    from schedlake.queries.streams import run_to_end, stream_of_parts
    from schedlake.streaming.deadlines import deadlines_by_definition

    t = datetime(2024, 5, 1)
    at = lambda minutes: t + timedelta(minutes=minutes)
    defs = spark.createDataFrame([(1, 120), (2, None), (3, 86400)], "id long, timeout_seconds int")
    started = [(10, 1, at(0), 0), (11, 1, at(1), 0), (12, 2, at(2), 0), (13, 9, at(2), 0), (14, None, at(3), 0), (15, 3, at(3), 0),
               (16, 1, at(4), 1), (16, 1, at(20), 1), (17, 1, None, 1), (18, 1, at(30), 1), (19, 1, at(700), 2), (20, 1, at(800), 2)]
    ended = [(10, at(2), 0), (11, at(3.1), 0), (12, at(61), 1), (13, at(63), 1), (14, at(63.5), 1), (15, at(62.9), 1), (16, at(21), 1),
             (18, at(29), 1), (99, at(40), 1), (19, None, 2), (98, at(800), 2)]
    runs = spark.createDataFrame(started, "id long, job_id long, started_at timestamp_ntz, part int")
    ends = spark.createDataFrame(ended, "id long, finished_at timestamp_ntz, part int")
    stream = deadlines_by_definition(stream_of_parts(spark, runs, F.col("part"), 3), stream_of_parts(spark, ends, F.col("part"), 3),
                                     defs, longest=3600)
    got = {(r.execution_id, r.started_at, r.deadline) for r in run_to_end(spark, stream, "deadlines").collect()}
    # 12 ends within the default hour; 13 and 14 end after it; 15's limit counts for an hour; 18 ends before it starts
    assert got == {(11, at(1), at(3)), (13, at(2), at(62)), (14, at(3), at(63)), (16, at(4), at(6)), (18, at(30), at(32)),
                   (19, at(700), at(702))}


def test_deadlines_touch_the_state_once_for_all_rows():
    """Calls on the state are round trips: their number must not grow with an execution's rows."""
    import pandas as pd
    from schedlake.streaming.state import DeadlineProcessor

    calls, held, timers = [], [], set()

    class State:
        def exists(self):
            calls.append("exists")
            return bool(held)

        def get(self):
            calls.append("get")
            return held[0] if held else None

        def update(self, value):
            calls.append("update")
            held[:] = [value]

        def clear(self):
            calls.append("clear")
            held.clear()

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("register")
            timers.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            timers.discard(at)

    start = pd.Timestamp("2024-01-01")
    rows = [(start + pd.Timedelta(minutes=i), i, "claim" if i % 2 == 0 else "complete") for i in range(200)]
    rows += [(start + pd.Timedelta(minutes=200), 200, "claim"), (start + pd.Timedelta(minutes=261), 201, "retry"),
             (start + pd.Timedelta(minutes=262), 202, "claim")]
    frame = pd.DataFrame(rows[::-1], columns=["event_time", "seq", "kind"]).assign(timeout_seconds=3600)
    frame["at"] = frame["event_time"].astype("datetime64[us]").astype("int64")
    processor = DeadlineProcessor()
    processor.init(Handle())
    missed = pd.concat([f for f in processor.handleInputRows((7,), iter([frame[:90], frame[90:]]), None) if len(f)])
    assert [(r.execution_id, r.started_at.tz_localize(None)) for r in missed.itertuples()] == [(7, start + pd.Timedelta(minutes=200))]
    assert len(calls) <= 4
    deadline = (start + pd.Timedelta(minutes=322)).value // 10 ** 6
    assert timers == {deadline}
    late = pd.concat(list(processor.handleExpiredTimer((7,), None, None)))
    assert late.started_at[0].tz_localize(None) == start + pd.Timedelta(minutes=262) and not timers and not held
