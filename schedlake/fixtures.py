"""Inputs derived from the given tables, in Spark and as DuckDB CTEs with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.clock import truncate
from schedlake.sources.triggers import MAX_FILES
from schedlake.schemas import ntz  # noqa: F401  (used by the queries)

AS_OF = "2024-01-15 09:00:30"
RANGE_START, RANGE_END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
SINCE = "2024-01-15 00:00:00"
PAGE, PAGE_SIZE = 3, 20
POOL_SIZE = 5

# The expression of each definition kind (supplier key modulo 12).
CRON_KINDS = [
    "*/15 * * * *", "0 * * * *", "30 2 * * *", "0 9 * * 1-5", "0 0 1 * *", "5,35 8-18/2 * * *",
    "0 12 13 * 5", "10 4 * 1,7 *", "0 6 * JAN-MAR SUN", "* * * * *", "0 0 31 2 *", "not a cron",
]
# End of fixed values.
_KINDS_SQL = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(CRON_KINDS))


def supplier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_table(spark, sf_dir).selectExpr(
        "s_suppkey + 1 AS id",
        "s_name AS name",
        "IF(s_suppkey % 7 = 0, NULL, concat('nation ', s_nationkey)) AS description",
        f"CASE s_suppkey % 12 {_KINDS_SQL} END AS cron_expression",
        "concat('handler_', s_nationkey % 8) AS handler_name",
        """IF(s_suppkey % 3 = 0, NULL, concat('{"action":"sync","id":', s_suppkey, ',"region":"r', s_nationkey % 5,
            '"}')) AS handler_params""",
        "s_suppkey % 7 <> 3 AS is_enabled",
        "s_suppkey % 4 <> 0 AS allow_overlap",
        "cast(s_suppkey % 5 AS INT) AS max_retry",
        "cast(60 * (1 + s_suppkey % 10) AS INT) AS timeout_seconds",
        "timestamp_ntz '2024-01-01 00:00:00' AS created_at",
        "timestamp_ntz '2024-01-01 00:00:00' AS updated_at")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_definitions = supplier_table(spark, sf_dir).agg(F.count("*")).scalar()
    started = "ts + interval 5 seconds"
    rows = events_table(spark, sf_dir).withColumn("job_id", (F.col("event_id") * 7) % n_definitions + 1)
    return rows.selectExpr(
        "event_id + 1 AS id",
        "IF(event_id % 10 = 0, NULL, job_id) AS job_id",
        "concat('handler_', event_id % 8) AS handler_name",
        "cast(date_trunc('minute', ts) AS timestamp_ntz) AS scheduled_time",
        """CASE event_type WHEN 'view' THEN 'SUCCESS' WHEN 'purchase' THEN 'RUNNING' WHEN 'click' THEN 'PENDING'
            WHEN 'error' THEN 'FAILED' ELSE 'TIMEOUT' END AS status""",
        "props AS params",
        "IF(event_id % 10 = 0, 'event', 'cron') AS param_source",
        f"IF(event_type = 'click', NULL, {started}) AS started_at",
        f"""IF(event_type IN ('view', 'error', 'signup'),
            timestampadd(SECOND, cast(floor(value * 10) AS INT), {started}), NULL) AS finished_at""",
        "cast(event_id % 4 AS INT) AS retry_count",
        """CASE event_type WHEN 'error' THEN concat('boom ', event_id % 5) WHEN 'signup' THEN 'Execution timed out'
            END AS error_message""",
        """IF(event_type = 'view', concat('{"action":"sync","success":true,"count":', event_id % 100, '}'), NULL)
            AS result""",
        "ts AS created_at")


def triggers_of(events: DataFrame) -> DataFrame:
    """Trigger messages from an events DataFrame, batch or streaming."""
    handler = "concat('\"handler_', event_id % 8, '\"')"
    return events.selectExpr(
        "'triggers' AS msg_topic", "cast(event_id % 3 AS INT) AS msg_partition",
        "cast(floor(event_id / 3.0) AS BIGINT) AS msg_offset", "ts",
        f"""CASE event_id % 10
            WHEN 0 THEN 'not json'
            WHEN 1 THEN concat('{{"handler":', {handler}, ',"params":', props, '}}')
            WHEN 2 THEN concat('{{"params":', props, '}}')
            WHEN 3 THEN concat('{{"handler_name":', {handler}, ',"params":', props, ',"job_id":', event_id % 150 + 1, '}}')
            WHEN 4 THEN concat('{{"handler_name":', {handler}, '}}')
            WHEN 5 THEN concat('{{"handler_name":', {handler}, ',"params":null}}')
            WHEN 6 THEN concat('{{"handler_name":', {handler}, ',"params":[1,2]}}')
            ELSE concat('{{"handler_name":"handler_', event_id % 12, '","params":{{"id":', event_id, ',"k":"s"}}}}')
            END AS value""")


def transitions_of(events: DataFrame) -> DataFrame:
    """Lifecycle transitions from an events DataFrame, batch or streaming."""
    return events.selectExpr(
        "user_id AS execution_id", "ts", "event_id AS seq",
        """CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'complete' WHEN 'error' THEN 'fail'
            WHEN 'signup' THEN 'timeout' ELSE 'retry' END AS kind""",
        """CASE event_type WHEN 'error' THEN concat('boom ', event_id % 5) WHEN 'signup' THEN 'Execution timed out'
            END AS error_message""",
        "IF(event_type = 'view', props, NULL) AS result")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers_of(events_table(spark, sf_dir))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions_of(events_table(spark, sf_dir))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_table(spark, sf_dir).select(
        F.timestamp_add("SECOND", F.lit(30), truncate("hour", "ts")).alias("poll_ts")).distinct()


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a file stream."""
    schema = events_table(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", MAX_FILES).parquet(sf_dir)


# The same derivations for DuckDB, one CTE each.
CTE = {
    "definitions": f"""
SELECT s_suppkey + 1 AS id, s_name AS name,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('nation ', CAST(s_nationkey AS VARCHAR)) END AS description,
  CASE s_suppkey % 12 {_KINDS_SQL} END AS cron_expression,
  concat('handler_', CAST(s_nationkey % 8 AS VARCHAR)) AS handler_name,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('{{"action":"sync","id":', CAST(s_suppkey AS VARCHAR),
    ',"region":"r', CAST(s_nationkey % 5 AS VARCHAR), '"}}') END AS handler_params,
  s_suppkey % 7 <> 3 AS is_enabled, s_suppkey % 4 <> 0 AS allow_overlap,
  CAST(s_suppkey % 5 AS INT) AS max_retry, CAST(60 * (1 + s_suppkey % 10) AS INT) AS timeout_seconds,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
FROM supplier""",
    "executions": """
SELECT e.event_id + 1 AS id,
  CASE WHEN e.event_id % 10 = 0 THEN NULL ELSE (e.event_id * 7) % (SELECT count(*) FROM supplier) + 1 END AS job_id,
  concat('handler_', CAST(e.event_id % 8 AS VARCHAR)) AS handler_name,
  date_trunc('minute', e.ts) AS scheduled_time,
  CASE e.event_type WHEN 'view' THEN 'SUCCESS' WHEN 'purchase' THEN 'RUNNING' WHEN 'click' THEN 'PENDING'
    WHEN 'error' THEN 'FAILED' ELSE 'TIMEOUT' END AS status,
  e.props AS params, CASE WHEN e.event_id % 10 = 0 THEN 'event' ELSE 'cron' END AS param_source,
  CASE WHEN e.event_type = 'click' THEN NULL ELSE e.ts + INTERVAL '5' SECOND END AS started_at,
  CASE WHEN e.event_type IN ('view','error','signup') THEN e.ts + INTERVAL '5' SECOND
    + INTERVAL '1' SECOND * CAST(floor(e.value * 10) AS INT) END AS finished_at,
  CAST(e.event_id % 4 AS INT) AS retry_count,
  CASE e.event_type WHEN 'error' THEN concat('boom ', CAST(e.event_id % 5 AS VARCHAR))
    WHEN 'signup' THEN 'Execution timed out' END AS error_message,
  CASE WHEN e.event_type = 'view' THEN concat('{"action":"sync","success":true,"count":',
    CAST(e.event_id % 100 AS VARCHAR), '}') END AS result,
  e.ts AS created_at
FROM events e""",
    "triggers": """
SELECT 'triggers' AS msg_topic, CAST(event_id % 3 AS INT) AS msg_partition,
  CAST(floor(event_id / 3.0) AS BIGINT) AS msg_offset, ts,
  CASE event_id % 10
    WHEN 0 THEN 'not json'
    WHEN 1 THEN concat('{"handler":"handler_', CAST(event_id % 8 AS VARCHAR), '","params":', props, '}')
    WHEN 2 THEN concat('{"params":', props, '}')
    WHEN 3 THEN concat('{"handler_name":"handler_', CAST(event_id % 8 AS VARCHAR), '","params":', props,
      ',"job_id":', CAST(event_id % 150 + 1 AS VARCHAR), '}')
    WHEN 4 THEN concat('{"handler_name":"handler_', CAST(event_id % 8 AS VARCHAR), '"}')
    WHEN 5 THEN concat('{"handler_name":"handler_', CAST(event_id % 8 AS VARCHAR), '","params":null}')
    WHEN 6 THEN concat('{"handler_name":"handler_', CAST(event_id % 8 AS VARCHAR), '","params":[1,2]}')
    ELSE concat('{"handler_name":"handler_', CAST(event_id % 12 AS VARCHAR), '","params":{"id":',
      CAST(event_id AS VARCHAR), ',"k":"s"}}') END AS value
FROM events""",
    "transitions": """
SELECT user_id AS execution_id, ts, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'complete' WHEN 'error' THEN 'fail'
    WHEN 'signup' THEN 'timeout' ELSE 'retry' END AS kind,
  CASE event_type WHEN 'error' THEN concat('boom ', CAST(event_id % 5 AS VARCHAR))
    WHEN 'signup' THEN 'Execution timed out' END AS error_message,
  CASE WHEN event_type = 'view' THEN props END AS result
FROM events""",
    "polls": "SELECT DISTINCT date_trunc('hour', ts) + INTERVAL '30' SECOND AS poll_ts FROM events",
    # Which minute instants each definition kind fires at; kinds 10 and 11 never do.
    "minutes": f"""
SELECT t FROM generate_series(TIMESTAMP '{RANGE_START}', TIMESTAMP '2024-01-31 23:59:00', INTERVAL '1' MINUTE) g(t)""",
    "wide_minutes": f"""
SELECT t FROM generate_series(TIMESTAMP '{RANGE_START}', TIMESTAMP '2024-03-31 23:59:00', INTERVAL '1' MINUTE) g(t)""",
    "kind_ticks": """
SELECT k, t FROM minutes, (SELECT unnest(range(0, 10)) AS k) kinds
WHERE CASE k
  WHEN 0 THEN minute(t) % 15 = 0
  WHEN 1 THEN minute(t) = 0
  WHEN 2 THEN hour(t) = 2 AND minute(t) = 30
  WHEN 3 THEN hour(t) = 9 AND minute(t) = 0 AND dayofweek(t) BETWEEN 1 AND 5
  WHEN 4 THEN day(t) = 1 AND hour(t) = 0 AND minute(t) = 0
  WHEN 5 THEN minute(t) IN (5, 35) AND hour(t) IN (8, 10, 12, 14, 16, 18)
  WHEN 6 THEN hour(t) = 12 AND minute(t) = 0 AND (day(t) = 13 OR dayofweek(t) = 5)
  WHEN 7 THEN month(t) IN (1, 7) AND hour(t) = 4 AND minute(t) = 10
  WHEN 8 THEN hour(t) = 6 AND minute(t) = 0 AND month(t) BETWEEN 1 AND 3 AND dayofweek(t) = 0
  ELSE true END""",
    "ticks": "SELECT d.id, k.t AS tick FROM definitions d JOIN kind_ticks k ON (d.id - 1) % 12 = k.k",
}
CTE["wide_kind_ticks"] = CTE["kind_ticks"].replace("FROM minutes", "FROM wide_minutes")
CTE["wide_ticks"] = CTE["ticks"].replace("kind_ticks", "wide_kind_ticks")
_NEEDS = {"kind_ticks": ["minutes"], "ticks": ["definitions", "kind_ticks"],
          "wide_kind_ticks": ["wide_minutes"], "wide_ticks": ["definitions", "wide_kind_ticks"]}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named CTEs and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered)
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{body[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"
