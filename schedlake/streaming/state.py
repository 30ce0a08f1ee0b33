"""Stateful lifecycle streams keyed by execution: current state and missed deadlines."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from schedlake.schemas import DEFAULT_MAX_RETRY, DEFAULT_TIMEOUT_SECONDS, TIMEOUT_MESSAGE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_FIELDS = ["status", "retry_count", "started_at", "finished_at", "error_message", "result", "applied", "ignored"]
STATE_SCHEMA = ("status string, retry_count int, started_at timestamp_ntz, finished_at timestamp_ntz, "
                "error_message string, result string, applied long, ignored long")
OUTPUT_SCHEMA = f"execution_id long, {STATE_SCHEMA}"
DEADLINE_SCHEMA = "execution_id long, started_at timestamp, deadline timestamp, kind string, error_message string"

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: The microseconds that stand for no time.
NO_TIME = pd.NaT.value // 1000
FINISH = {"complete": "SUCCESS", "fail": "FAILED", "timeout": "TIMEOUT"}


def advance(state: dict, kind: str, ts, error: str | None, result: str | None, max_retry: int) -> None:
    """One transition applied to a state in place; an illegal one is only counted."""
    status = state["status"]
    if kind == "delete" and status != "DELETED":
        change = {"status": "DELETED"}
    elif kind == "claim" and status == "PENDING":
        change = {"status": "RUNNING", "started_at": ts}
    elif kind == "retry" and status in ("FAILED", "TIMEOUT"):
        change = dict(status="PENDING", started_at=None, finished_at=None, error_message=None, result=None)
    elif kind in FINISH and status == "RUNNING":
        change = {"status": FINISH[kind], "finished_at": ts}
        if kind == "complete":
            change["result"] = result
        else:
            change["error_message"] = TIMEOUT_MESSAGE if kind == "timeout" else error
            change["retry_count"] = state["retry_count"] + 1
            if change["retry_count"] < max_retry:
                change |= dict(status="PENDING", started_at=None, finished_at=None)
    else:
        state["ignored"] += 1
        return
    state.update(change)
    state["applied"] += 1


def _none(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and pd.isna(value)) else value


class LifecycleProcessor(StatefulProcessor):
    """Keeps the state of one execution and emits it after each micro-batch that touches it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", f"{STATE_SCHEMA}, max_retry int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self._state.get() if self._state.exists() else None
        state = dict(zip([*STATE_FIELDS, "max_retry"], stored)) if stored else dict(
            status="PENDING", retry_count=0, started_at=None, finished_at=None, error_message=None, result=None,
            applied=0, ignored=0)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for row in batch.itertuples(index=False):
            limit = state.setdefault("max_retry", int(row.max_retry))  # the first row of an execution sets it
            advance(state, row.kind, row.ts.to_pydatetime(), _none(row.error_message), _none(row.result), limit)
        values = tuple(_none(state[f]) for f in STATE_FIELDS)
        self._state.update((*values, state["max_retry"]))
        yield pd.DataFrame([(key[0], *values)], columns=["execution_id", *STATE_FIELDS])

    def close(self) -> None:
        pass


def state_stream(transitions: DataFrame, max_retry=None) -> DataFrame:
    """Current state per execution as a stream of updates.

    The log of an execution must arrive in order across micro-batches, as one partition of a topic
    delivers it; inside a micro-batch rows are ordered by (ts, seq). The source's bound on a micro-batch
    (offsets or files per trigger) is also the bound on the rows of one execution that a task orders.
    """
    limit = F.lit(DEFAULT_MAX_RETRY) if max_retry is None else max_retry
    rows = transitions.withColumn("max_retry", F.coalesce(limit, F.lit(DEFAULT_MAX_RETRY)).cast("int"))
    return rows.groupBy("execution_id").transformWithStateInPandas(
        LifecycleProcessor(), outputStructType=OUTPUT_SCHEMA, outputMode="Update", timeMode="None")


def _last_if_null(value) -> tuple:
    return (True, 0) if pd.isna(value) else (False, value)


class DeadlineProcessor(StatefulProcessor):
    """Sets an event-time timer per claim and fires it when no end came by then.

    Times are microseconds; only the timer is in milliseconds, rounded up. Claims whose deadline the watermark has not
    passed when the stream stops are not emitted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._claim = handle.getValueState("claim", "started long, deadline long")

    @staticmethod
    def _timer(micros: int) -> int:
        return -(-micros // 1000)

    def _replace(self, stored: tuple | None, claim: tuple | None) -> None:
        if stored == claim:
            return
        if stored is not None:
            self._handle.deleteTimer(self._timer(stored[1]))
        if claim is not None:
            self._claim.update(claim)
            self._handle.registerTimer(self._timer(claim[1]))
        else:
            self._claim.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Each call on the state is a round trip, so it is read once and written once however many rows there are.
        batch = [r for part in rows for r in zip(*[part[c].tolist() for c in ("at", "seq", "kind", "timeout_seconds")])]
        batch.sort(key=lambda r: (_last_if_null(r[0]), _last_if_null(r[1])))
        stored = claim = self._stored()
        missed = []
        for at, _, kind, timeout in batch:
            at = NO_TIME if pd.isna(at) else int(at)
            if claim is not None and claim[1] < at:
                missed.append(self._missed(key, claim))
                claim = None
            if kind == "claim" and claim is None:
                claim = (at, at + int(timeout) * 1_000_000)
            elif kind in ("complete", "fail", "timeout", "delete"):
                claim = None
        self._replace(stored, claim)
        if missed:
            yield self._frame(missed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        claim = self._stored()
        if claim is not None:
            self._replace(claim, None)
            yield self._frame([self._missed(key, claim)])

    def _stored(self) -> tuple | None:
        value = self._claim.get()
        return None if value is None else tuple(value)

    @staticmethod
    def _missed(key, claim: tuple) -> tuple:
        started, deadline = (EPOCH + timedelta(microseconds=us) for us in claim)
        return key[0], started, deadline, "timeout", TIMEOUT_MESSAGE

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["execution_id", "started_at", "deadline", "kind", "error_message"])

    def close(self) -> None:
        pass


def deadline_stream(transitions: DataFrame, timeouts: DataFrame | None = None, delay: str = "10 minutes") -> DataFrame:
    """TIMEOUT transitions for claims whose deadline passed in event time with no end.

    ``timeouts`` holds (execution_id, timeout_seconds); others use the default.
    """
    rows = transitions
    if timeouts is not None:
        rows = rows.join(timeouts, "execution_id", "left")
    else:
        rows = rows.withColumn("timeout_seconds", F.lit(None).cast("int"))
    rows = rows.select(
        "execution_id", "seq", "kind",
        F.coalesce("timeout_seconds", F.lit(DEFAULT_TIMEOUT_SECONDS)).cast("int").alias("timeout_seconds"),
        F.col("ts").cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    rows = rows.withColumn("at", F.unix_micros("event_time"))
    return rows.groupBy("execution_id").transformWithStateInPandas(
        DeadlineProcessor(), outputStructType=DEADLINE_SCHEMA, outputMode="Append", timeMode="EventTime")
