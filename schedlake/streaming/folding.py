"""Lifecycle state as a stream of folded micro-batches: stored states are only taken through tables, never replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schedlake.operators.lifecycle import STATES_SCHEMA, advance, state_columns

ROWS_SCHEMA = "execution_id bigint, ts timestamp_ntz, seq bigint, kind string, error_message string, result string, max_retry int"
META_SCHEMA = "batch bigint, watermark timestamp_ntz, late bigint"
#: A micro-batch writes the slot after that of the last one; a reader of an older slot has until it comes round again.
SLOTS = 3
ENDED = ("SUCCESS", "FAILED", "TIMEOUT", "DELETED")


def _exists(read: Callable[[], DataFrame]) -> bool:
    try:
        return bool(read().schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


class StateFolder:
    """States, rows that wait for the watermark, and totals, in slots that micro-batches fill in turn.

    A slot counts once its totals are there, which are written last. A micro-batch that is run again reads the slot of the
    one before it and fills its own anew, so it changes nothing but what it left unfinished.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for slot in range(SLOTS):
            if not _exists(lambda: self._read(slot, "meta", META_SCHEMA)):
                self._write(spark.createDataFrame([], META_SCHEMA), slot, "meta")
        if not _exists(self._done):
            spark.createDataFrame([], STATES_SCHEMA).write.mode("ignore").parquet(f"{folder}/done/none")

    def _read(self, slot: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/slot{slot}/{name}")

    def _write(self, df: DataFrame, slot: int, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/slot{slot}/{name}")

    def _done(self) -> DataFrame:
        return self.spark.read.schema(STATES_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.folder}/done")

    def before(self, batch: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
        """States, waiting rows and totals of the last whole slot, or the last one before a micro-batch."""
        found = [r.asDict() | {"slot": slot} for slot in range(SLOTS) for r in self._read(slot, "meta", META_SCHEMA).collect()]
        found = [r for r in found if batch is None or r["batch"] < batch]
        if not found:
            empty = self.spark.createDataFrame
            return empty([], STATES_SCHEMA), empty([], ROWS_SCHEMA), {"batch": -1, "watermark": None, "late": 0}
        last = max(found, key=lambda r: r["batch"])
        return self._read(last["slot"], "states", STATES_SCHEMA), self._read(last["slot"], "waiting", ROWS_SCHEMA), last

    def fill(self, batch: int, states: DataFrame, waiting: DataFrame, watermark, late: int, keep_for: str) -> None:
        slot = batch % SLOTS
        self._write(self.spark.createDataFrame([], META_SCHEMA), slot, "meta")  # from now on the slot does not count
        self._write(states, slot, "all")
        self._write(waiting, slot, "waiting")
        states = self._read(slot, "all", STATES_SCHEMA)
        old = F.lit(False) if watermark is None else F.col("state.status").isin(*ENDED) & (
            F.col("last") < F.lit(watermark).cast("timestamp_ntz") - F.expr(f"INTERVAL {keep_for}"))
        self._write(states.where(~old), slot, "states")
        gone = states.where(old & (F.col("state.status") != "DELETED"))
        gone.write.mode("overwrite").parquet(f"{self.folder}/done/batch{batch:012d}")
        meta = self.spark.createDataFrame([(batch, watermark, late)], META_SCHEMA)
        self._write(meta, slot, "meta")


def fold_batch(store: StateFolder, rows: DataFrame, batch: int, delay: str, keep_for: str, slice_unit: str) -> None:
    """One micro-batch: waiting and new rows up to the watermark are folded, later ones wait."""
    states, waiting, total = store.before(batch)
    rows = waiting.unionByName(rows).persist()
    try:
        mark = F.lit(total["watermark"]).cast("timestamp_ntz")
        late = F.lit(False) if total["watermark"] is None else F.col("ts") < mark
        seen = rows.agg(F.max(F.when(~late, F.col("ts"))).alias("top"), F.count_if(late).alias("late")).select(
            F.greatest(mark, F.col("top") - F.expr(f"INTERVAL {delay}")).alias("watermark"), "late").first()
        ready = F.lit(False) if seen["watermark"] is None else F.col("ts") < F.lit(seen["watermark"]).cast("timestamp_ntz")
        states = advance(states, rows.where(~late & ready), slice_unit=slice_unit)
        store.fill(batch, states, rows.where(~late & ~ready), seen["watermark"], total["late"] + seen["late"], keep_for)
    finally:
        rows.unpersist()


def fold_stream(transitions: DataFrame, folder: str, checkpoint: str, max_retry: Column | None = None, delay: str = "10 minutes",
                keep_for: str = "1 day", slice_unit: str = "hour") -> StreamingQuery:
    """Starts a stream that keeps ``folded_state`` of a log in ``folder``; it ends with the available data.

    Each micro-batch is folded natively into states on entry and exit, as ``current_state`` does for a whole log, and
    stored states only pass through them. Rows may come out of order by ``delay``: they wait until the watermark, the
    largest time so far less ``delay``, has passed them. Rows behind it are left out and counted. An execution that has
    ended, or was deleted, leaves the states ``keep_for`` after its last row; ended ones go to the finished rows, and a
    row that comes still later starts a new execution. So the states are bounded by the executions that run, and those
    that ended within ``keep_for``. The first folded row of an execution sets its limit.
    """
    spark = transitions.sparkSession
    limit = F.lit(None) if max_retry is None else max_retry
    rows = transitions.select("execution_id", "ts", "seq", "kind", "error_message", "result", limit.cast("int").alias("max_retry"))
    store = StateFolder(spark, folder)

    def land(batch_rows: DataFrame, batch: int) -> None:
        fold_batch(store, batch_rows, batch, delay, keep_for, slice_unit)

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded_state(spark: SparkSession, folder: str, slice_unit: str = "hour") -> DataFrame:
    """State of each execution after all rows that were not late, those that still wait included."""
    store = StateFolder(spark, folder)
    states, waiting, _ = store.before()
    return state_columns(advance(states, waiting, slice_unit=slice_unit)).unionByName(state_columns(store._done()))


def late_transitions(spark: SparkSession, folder: str) -> int:
    """Rows that came behind the watermark, over the stream's life."""
    return StateFolder(spark, folder).before()[2]["late"]


def stored_states(spark: SparkSession, folder: str) -> DataFrame:
    """What the next micro-batch will start from."""
    return StateFolder(spark, folder).before()[0]
