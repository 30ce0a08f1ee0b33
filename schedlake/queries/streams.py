"""Streams over the events table, run to the end of the available data."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators.changes import claim, complete
from schedlake.plans.event_dispatch import MESSAGE_KEY, event_id
from schedlake.queries.lifecycle import STATE_SQL, STATE_WITH_DELETES_SQL, fixed_limit
from schedlake.queries.payloads import BAD_SQL, CREATED, CREATED_SQL
from schedlake.queries.registry import query
from schedlake.queries.reports import COUNTS
from schedlake.schemas import DEFAULT_TOPIC, EXECUTION_SCHEMA
from schedlake.session import run_folder
from schedlake.sources.tables import append_executions, read_executions
from schedlake.streaming import folding
from schedlake.streaming import ingest as si
from schedlake.streaming.deadlines import deadlines_by_definition as by_definition
from schedlake.streaming.state import PROVIDER, deadline_stream, state_stream
from schedlake.streaming.stats import windowed_stats

KEYED_EXECUTIONS = T.StructType([
    *EXECUTION_SCHEMA.fields, T.StructField("msg_topic", T.StringType()),
    T.StructField("msg_partition", T.IntegerType()), T.StructField("msg_offset", T.LongType())])


def run_to_end(spark, stream, name: str, mode: str = "append"):
    """Runs a stream over all available data and returns what it wrote, with the batch number."""
    folder = run_folder(spark, name)

    def land(batch, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/b{batch_id:06d}")

    running = stream.writeStream.foreachBatch(land).outputMode(mode).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def _trigger_stream(spark, sf):
    return fx.triggers_of(fx.events_stream(spark, sf))


def _ingest(spark, sf, runs: int = 1):
    folder = run_folder(spark, "ingest")
    for _ in range(runs):
        si.trigger_ingest(_trigger_stream(spark, sf), fx.definitions(spark, sf), f"{folder}/good", f"{folder}/bad",
                          f"{folder}/checkpoint").awaitTermination()
    return folder


@query(with_ctes("triggers definitions", CREATED_SQL))
def trigger_stream_ingest(spark, sf):
    return si.read_ingested(spark, f"{_ingest(spark, sf)}/good", KEYED_EXECUTIONS).select(*CREATED)


@query(with_ctes("triggers definitions", CREATED_SQL))
def trigger_stream_restarted(spark, sf):
    """The same rows after a second run on the same checkpoint: nothing is doubled."""
    return si.read_ingested(spark, f"{_ingest(spark, sf, runs=2)}/good", KEYED_EXECUTIONS).select(*CREATED)


@query(with_ctes("triggers definitions", CREATED_SQL))
def trigger_stream_repeated_run(spark, sf):
    """The same rows after a run on a new checkpoint that finds the messages stored."""
    folder = _ingest(spark, sf)
    si.trigger_ingest(_trigger_stream(spark, sf), fx.definitions(spark, sf), f"{folder}/good", f"{folder}/bad",
                      f"{folder}/checkpoint2").awaitTermination()
    return si.read_ingested(spark, f"{folder}/good", KEYED_EXECUTIONS).select(*CREATED)


HISTORY = ["id", "job_id", "handler_name", "scheduled_time", "status", "params", "param_source", "created_at"]


@query(with_ctes("triggers definitions executions", f"""WITH created AS ({CREATED_SQL}),
stored AS (SELECT {", ".join(HISTORY)} FROM created UNION ALL SELECT {", ".join(HISTORY)} FROM executions
    WHERE param_source = 'cron')
SELECT * FROM stored WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-25 12:00:00'"""))
def ingested_history(spark, sf):
    """Streamed and appended executions in one table, read by a date range."""
    folder = run_folder(spark, "history")
    append_executions(fx.executions(spark, sf).filter("param_source = 'cron'"), folder)
    si.trigger_ingest(_trigger_stream(spark, sf), fx.definitions(spark, sf), folder, f"{folder}-bad",
                      f"{folder}-checkpoint").awaitTermination()
    return read_executions(spark, folder, "2024-01-05 00:00:00", "2024-01-25 12:00:00").select(*HISTORY)


CLAIMED = 200
CLAIM_TIME = "2024-02-01 00:00:00"


@query(with_ctes("triggers definitions", f"""WITH created AS ({CREATED_SQL}),
ranked AS (SELECT *, row_number() OVER (ORDER BY created_at, id) <= {CLAIMED} AS taken FROM created)
SELECT id, CASE WHEN NOT taken THEN 'PENDING' WHEN msg_offset % 2 = 0 THEN 'SUCCESS' ELSE 'RUNNING' END AS status,
    CASE WHEN taken THEN TIMESTAMP '{CLAIM_TIME}' END AS started_at,
    CASE WHEN taken AND msg_offset % 2 = 0 THEN TIMESTAMP '{CLAIM_TIME}' END AS finished_at FROM ranked"""))
def ingested_claimed(spark, sf):
    """Claims and outcomes reach the executions that a stream has stored."""
    stored = read_executions(spark, f"{_ingest(spark, sf)}/good")
    claimed = claim(stored, CLAIMED, CLAIM_TIME)
    done = claimed.filter("status = 'RUNNING' AND id % 2 = 0").select("id", F.lit("{}").alias("result"))
    return complete(claimed, done, fx.definitions(spark, sf), CLAIM_TIME).select("id", "status", "started_at", "finished_at")


@query(with_ctes("triggers definitions", BAD_SQL))
def trigger_stream_quarantine(spark, sf):
    folder = _ingest(spark, sf)
    return si.read_quarantined(spark, f"{folder}/bad")


@query(with_ctes("triggers definitions", CREATED_SQL))
def enriched_trigger_stream(spark, sf):
    stream = si.enrich_trigger_stream(_trigger_stream(spark, sf), fx.definitions(spark, sf)).drop("params_map")
    rows = run_to_end(spark, stream, "enriched").filter("reason IS NULL")
    return rows.select(
        event_id([DEFAULT_TOPIC]).alias("id"), "job_id", "handler_name", F.col("ts").alias("scheduled_time"), F.lit("PENDING").alias("status"), "params",
        F.lit("event").alias("param_source"), F.lit(0).alias("retry_count"), F.col("ts").alias("created_at"),
        *MESSAGE_KEY)


@query(with_ctes("triggers", "SELECT * FROM triggers"))
def deduplicated_triggers(spark, sf):
    """Every message arrives twice and stays once."""
    doubled = _trigger_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return run_to_end(spark, si.dedupe_triggers(doubled, MESSAGE_KEY), "dedupe").drop("batch")


@query(STATE_SQL)
def state_from_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    updates = run_to_end(spark, state_stream(fx.transitions_of(fx.events_stream(spark, sf)), fixed_limit()), "state",
                         "update")
    # An execution may be touched by several micro-batches; its last update is its state.
    fields = [c for c in updates.columns if c not in ("execution_id", "batch")]
    return updates.groupBy("execution_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select(
        "execution_id", "s.*")


PARTS = 4


def stream_of_parts(spark, df, part, parts: int):
    """A table as a stream with a micro-batch for each number in ``part``, in that order."""
    folder = run_folder(spark, "parts")
    numbered = df.withColumn("_part", part).persist()
    for i in range(parts):
        numbered.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    numbered.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def folded(spark, transitions, **options) -> str:
    """Folds transitions in micro-batches of eight days that overlap by up to six minutes."""
    moved = F.timestamp_add("MINUTE", F.col("seq") % 7, F.col("ts"))
    part = F.least(F.floor((F.dayofyear(moved) - 1) / 8), F.lit(PARTS - 1))
    stream = stream_of_parts(spark, transitions, part, PARTS)
    folder = run_folder(spark, "folded")
    folding.fold_stream(stream, folder, f"{folder}-checkpoint", fixed_limit(), **options).awaitTermination()
    return folder


@query(STATE_WITH_DELETES_SQL)
def folded_state_from_stream(spark, sf):
    """A log out of order, with deletes, in micro-batches that are folded before they meet the stored states."""
    kind = F.when(F.col("seq") % 97 == 0, "delete").otherwise(F.col("kind"))
    folder = folded(spark, fx.transitions(spark, sf).withColumn("kind", kind), keep_for="400 days")
    return folding.folded_state(spark, folder)


# Open claims walked in order; a claim is missed once a later row, or the watermark, passes its deadline.
DEADLINES = """WITH ordered AS (SELECT execution_id, kind, ts,
    row_number() OVER (PARTITION BY execution_id ORDER BY ts, seq) AS rn FROM transitions),
walk AS (
  SELECT DISTINCT execution_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS opened,
    CAST(NULL AS TIMESTAMP) AS missed FROM transitions
  UNION ALL
  SELECT execution_id, rn, CASE WHEN still IS NULL AND kind = 'claim' THEN ts
      WHEN kind IN ('complete', 'fail', 'timeout') THEN NULL ELSE still END,
    CASE WHEN opened IS NOT NULL AND still IS NULL THEN opened END
  FROM (SELECT o.execution_id, o.rn, o.kind, o.ts, w.opened,
      CASE WHEN w.opened + INTERVAL 3600 SECOND >= o.ts THEN w.opened END AS still
    FROM walk w JOIN ordered o ON o.execution_id = w.execution_id AND o.rn = w.rn + 1) z),
late AS (SELECT execution_id, missed AS started_at FROM walk WHERE missed IS NOT NULL
  UNION ALL SELECT execution_id, opened FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY rn DESC)
    AS back FROM walk) WHERE back = 1 AND opened + INTERVAL 3600 SECOND <=
    (SELECT max(ts) FROM transitions) - INTERVAL 10 MINUTE)
SELECT execution_id, started_at, started_at + INTERVAL 3600 SECOND AS deadline, 'timeout' AS kind,
    'Execution timed out' AS error_message FROM late"""


@query(with_ctes("transitions", DEADLINES, recursive=True))
def deadlines_from_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = deadline_stream(fx.transitions_of(fx.events_stream(spark, sf)))
    return run_to_end(spark, stream, "deadlines").drop("batch").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "deadline")})


LONGEST = 600


@query(with_ctes("executions definitions", f"""WITH started AS (SELECT e.id, e.started_at, e.finished_at,
    e.started_at + INTERVAL 1 SECOND * least(coalesce(d.timeout_seconds, 3600), {LONGEST}) AS deadline
    FROM executions e LEFT JOIN definitions d ON d.id = e.job_id WHERE e.started_at IS NOT NULL),
mark AS (SELECT least(max(started_at), max(finished_at)) - INTERVAL 10 MINUTE AS top FROM started)
SELECT id AS execution_id, started_at, deadline, 'timeout' AS kind, 'Execution timed out' AS error_message
FROM started, mark WHERE started_at + INTERVAL {LONGEST} SECOND < top
    AND NOT coalesce(finished_at BETWEEN started_at AND deadline, false)"""))
def deadlines_by_definition(spark, sf):
    """Runs and ends as two streams over the history, joined in event time; no limit here is longer than ten minutes."""
    parts = F.least(F.floor((F.dayofyear("created_at") - 1) / 8), F.lit(PARTS - 1))
    execs = stream_of_parts(spark, fx.executions(spark, sf), parts, PARTS)
    stream = by_definition(execs.select("id", "job_id", "started_at"), execs.select("id", "finished_at"),
                           fx.definitions(spark, sf), longest=LONGEST)
    return run_to_end(spark, stream, "by-definition").drop("batch")


def _created_stream(events):
    status = F.expr("""CASE event_type WHEN 'view' THEN 'SUCCESS' WHEN 'purchase' THEN 'RUNNING' WHEN 'click'
        THEN 'PENDING' WHEN 'error' THEN 'FAILED' ELSE 'TIMEOUT' END""")
    return events.select(F.col("ts").alias("created_at"), status.alias("status"))


@query(with_ctes("executions", f"""SELECT * FROM (SELECT date_trunc('hour', created_at) AS window_start,
    date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end, {COUNTS} FROM executions GROUP BY 1, 2)
    WHERE window_end <= (SELECT max(created_at) FROM executions) - INTERVAL 10 MINUTE"""))
def hourly_stats_stream(spark, sf):
    """The windows that are final once the stream has seen everything."""
    return run_to_end(spark, windowed_stats(_created_stream(fx.events_stream(spark, sf)), "1 hour"), "stats").drop(
        "batch")


FINAL = "window_end <= (SELECT max(created_at) FROM executions) - INTERVAL 10 MINUTE"


@query(with_ctes("executions", f"""WITH framed AS (SELECT *, unnest([date_trunc('hour', created_at),
    date_trunc('hour', created_at) - INTERVAL 1 HOUR]) AS window_start FROM executions)
SELECT * FROM (SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, {COUNTS} FROM framed GROUP BY 1)
WHERE {FINAL}"""))
def sliding_stats_stream(spark, sf):
    stream = _created_stream(fx.events_stream(spark, sf))
    return run_to_end(spark, windowed_stats(stream, "2 hours", slide="1 hour"), "sliding").drop("batch")


@query(with_ctes("executions", f"""WITH gaps AS (SELECT *, created_at >= lag(created_at) OVER (PARTITION BY status
        ORDER BY created_at) + INTERVAL 20 MINUTE AS fresh FROM executions),
numbered AS (SELECT *, count(*) FILTER (coalesce(fresh, true)) OVER (PARTITION BY status ORDER BY created_at
        ROWS UNBOUNDED PRECEDING) AS sid FROM gaps)
SELECT * FROM (SELECT min(created_at) AS window_start, max(created_at) + INTERVAL 20 MINUTE AS window_end, status, {COUNTS}
    FROM numbered GROUP BY status, sid) WHERE {FINAL}"""))
def session_stats_stream(spark, sf):
    stream = _created_stream(fx.events_stream(spark, sf))
    return run_to_end(spark, windowed_stats(stream, "1 hour", gap="20 minutes", keys=["status"]), "sessions").drop("batch")


@query(with_ctes("executions", f"""SELECT date_trunc('hour', created_at) AS window_start,
    date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end, param_source, {COUNTS}
    FROM executions GROUP BY 1, 2, 3"""))
def hourly_stats(spark, sf):
    return windowed_stats(fx.executions(spark, sf), "1 hour", keys=["param_source"])


@query(with_ctes("executions", f"""WITH framed AS (SELECT *, unnest([date_trunc('hour', created_at),
    date_trunc('hour', created_at) - INTERVAL 1 HOUR]) AS window_start FROM executions)
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, {COUNTS} FROM framed GROUP BY 1"""))
def sliding_stats(spark, sf):
    return windowed_stats(fx.executions(spark, sf), "2 hours", slide="1 hour")


@query(with_ctes("executions", f"""WITH gaps AS (SELECT *, created_at >= lag(created_at) OVER (PARTITION BY handler_name
        ORDER BY created_at) + INTERVAL 20 MINUTE AS fresh FROM executions),
numbered AS (SELECT *, count(*) FILTER (coalesce(fresh, true)) OVER (PARTITION BY handler_name ORDER BY created_at
        ROWS UNBOUNDED PRECEDING) AS sid FROM gaps)
SELECT min(created_at) AS window_start, max(created_at) + INTERVAL 20 MINUTE AS window_end, handler_name, {COUNTS}
FROM numbered GROUP BY handler_name, sid"""))
def session_stats(spark, sf):
    return windowed_stats(fx.executions(spark, sf), "1 hour", gap="20 minutes", keys=["handler_name"])
