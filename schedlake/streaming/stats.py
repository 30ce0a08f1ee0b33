"""Execution statistics over event-time windows."""

from __future__ import annotations

from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from schedlake.functions.clock import truncate
from schedlake.operators.reports import STATUS_COUNTS

AUDIT_SCHEMA = "batch bigint, top timestamp, late bigint"
SLOTS = 3


def _frame(width: str, slide: str | None, gap: str | None) -> Column:
    if gap is not None:
        return F.session_window("event_time", gap)
    return F.window("event_time", width, slide) if slide else F.window("event_time", width)


def windowed_stats(execs: DataFrame, width: str, slide: str | None = None, gap: str | None = None,
                   keys: list[str] | None = None, delay: str | None = "10 minutes", slice_unit: str = "hour") -> DataFrame:
    """Counts per status in tumbling, sliding (``slide``) or session (``gap``) windows of ``created_at``.

    Works on a stream and on a batch; a stream needs ``delay``, after which a window is final and rows
    that come later are dropped (``LateRows`` and ``audit_late_rows`` count them). Sessions of a batch are found in
    slices of time first, so that a key with many rows is many tasks; those of a stream are one task for each key,
    because Spark keeps a key's open sessions together.
    """
    timed = execs.withColumn("event_time", F.col("created_at").cast("timestamp"))
    counts = [F.count_if(F.col("status") == s).alias(n) for n, s in STATUS_COUNTS.items()]
    keys = keys or []
    if gap is not None and not execs.isStreaming:
        return _sessions(timed, gap, keys, counts, slice_unit)
    if delay is not None and execs.isStreaming:
        timed = timed.withWatermark("event_time", delay)
    out = timed.groupBy(_frame(width, slide, gap).alias("frame"), *keys).agg(F.count("*").alias("total"), *counts)
    return out.select(F.col("frame.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("frame.end").cast("timestamp_ntz").alias("window_end"), *keys, "total",
                      *STATUS_COUNTS)


def _sessions(timed: DataFrame, gap: str, keys: list[str], counts: list[Column], slice_unit: str) -> DataFrame:
    """Sessions per (key, slice), of which those that meet the ones before them, as Spark joins rows, are then joined.

    A key's slices hold at most one session per gap, however many rows it has, so the second step is small.
    """
    sliced = timed.withColumn("_slice", truncate(slice_unit, "created_at"))
    parts = sliced.groupBy(F.session_window("event_time", gap).alias("frame"), "_slice", *keys).agg(
        F.count("*").alias("total"), *counts).select("frame.start", "frame.end", *keys, "total", *STATUS_COUNTS)
    in_order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("_fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = fresh.withColumn("_session", F.sum("_fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_session").agg(
        F.min("start").cast("timestamp_ntz").alias("window_start"), F.max("end").cast("timestamp_ntz").alias("window_end"),
        *[F.sum(c).alias(c) for c in ("total", *STATUS_COUNTS)]).select(
        "window_start", "window_end", *keys, "total", *STATUS_COUNTS)


class LateRows(StreamingQueryListener):
    """Adds up what Spark reports as dropped behind the watermark, for each query by id, over all its micro-batches.

    ``spark.streams.addListener`` starts it. Spark drops after it has combined the rows of a window within a task, and
    counts what it drops: late rows of one window that come together are one. ``audit_late_rows`` counts each.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = defaultdict(int)
        self.last: dict[tuple[str, str], int] = {}

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = (str(progress.id), str(progress.runId))
        if progress.batchId > self.last.get(run, -1):  # a batch without rows may be reported again
            self.last[run] = progress.batchId
            self.dropped[run[0]] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _audit(spark: SparkSession, folder: str, before: int | None = None) -> dict:
    """Totals after the last micro-batch, or the last before a given one."""
    rows = []
    for slot in range(SLOTS):
        try:
            rows += spark.read.schema(AUDIT_SCHEMA).parquet(f"{folder}/slot{slot}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    rows = [r.asDict() for r in rows if before is None or r["batch"] < before]
    return max(rows, key=lambda r: r["batch"], default={"batch": -1, "top": None, "late": 0})


def audit_late_rows(execs: DataFrame, folder: str, checkpoint: str, width: str, slide: str | None = None, gap: str | None = None,
                    delay: str = "10 minutes") -> StreamingQuery:
    """Starts a stream beside ``windowed_stats`` that counts exactly the rows the latter drops as late.

    It must read the same source with the same options, so that both see the same micro-batches. A row is late where its
    window ended by the watermark: the largest time of earlier micro-batches less ``delay``. In sliding windows a row
    counts once for each window that it misses. Totals survive restarts, and a micro-batch that is run again counts once.
    """
    spark = execs.sparkSession
    timed = execs.select(F.col("created_at").cast("timestamp").alias("event_time"))

    def land(rows: DataFrame, batch: int) -> None:
        total = _audit(spark, folder, batch)
        top = F.lit(total["top"]).cast("timestamp")
        ends = rows.select("event_time", F.expr(f"event_time + INTERVAL {gap}").alias("end")) if gap else rows.select(
            "event_time", _frame(width, slide, None).getField("end").alias("end"))
        late = F.col("end") <= top - F.expr(f"INTERVAL {delay}")
        totals = ends.agg(F.greatest(top, F.max("event_time")).alias("top"), (F.count_if(late) + total["late"]).alias("late"))
        totals.select(F.lit(batch).cast("bigint").alias("batch"), "top", "late").coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/slot{batch % SLOTS}")

    return timed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited_late_rows(spark: SparkSession, folder: str) -> int:
    """Rows that ``audit_late_rows`` has counted over its life."""
    return _audit(spark, folder)["late"]


def late_rows(query) -> int:
    """Rows dropped in the last micro-batches that a query remembers, a hundred unless set otherwise."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress
               for op in p["stateOperators"])
