"""Table schemas, fixed values and column defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statuses, defaults, limits and message texts of the data model.
PENDING = "PENDING"
RUNNING = "RUNNING"
SUCCESS = "SUCCESS"
FAILED = "FAILED"
TIMEOUT = "TIMEOUT"
STATUSES = (PENDING, RUNNING, SUCCESS, FAILED, TIMEOUT)
INCOMPLETE = (PENDING, RUNNING)
TERMINAL = (SUCCESS, FAILED, TIMEOUT)
RETRYABLE = (FAILED, TIMEOUT)
PARAM_SOURCES = ("cron", "event")
DEFAULT_MAX_RETRY = 3
DEFAULT_TIMEOUT_SECONDS = 3600
DEFAULT_POLL_INTERVAL_SECONDS = 60
DEFAULT_MIN_INTERVAL_SECONDS = 60
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
NAME_LENGTH = (1, 100)
DESCRIPTION_MAX_LENGTH = 500
CRON_LENGTH = (9, 100)
HANDLER_LENGTH = (1, 100)
MAX_RETRY_RANGE = (0, 10)
TIMEOUT_RANGE = (60, 86400)
TIMEOUT_MESSAGE = "Execution timed out"
HANDLER_NOT_FOUND = "Handler not found: "
INVALID_PARAMS = "Invalid params: "
POOL_EXHAUSTED = "Connection pool exhausted: "
DATABASE_ERROR = "Database error: "
# End of fixed values.
#: The topic of trigger messages where none is named.
DEFAULT_TOPIC = "triggers"


DEFINITION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("cron_expression", T.StringType(), False),
    T.StructField("handler_name", T.StringType(), False),
    T.StructField("handler_params", T.StringType()),
    T.StructField("is_enabled", T.BooleanType()),
    T.StructField("allow_overlap", T.BooleanType()),
    T.StructField("max_retry", T.IntegerType()),
    T.StructField("timeout_seconds", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

EXECUTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_id", T.LongType()),
    T.StructField("handler_name", T.StringType(), False),
    T.StructField("scheduled_time", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("params", T.StringType()),
    T.StructField("param_source", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

TRIGGER_SCHEMA = T.StructType([
    T.StructField("msg_topic", T.StringType()),
    T.StructField("msg_partition", T.IntegerType()),
    T.StructField("msg_offset", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("value", T.StringType()),
])

TRANSITION_SCHEMA = T.StructType([
    T.StructField("execution_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("result", T.StringType()),
])

DEFINITION_COLUMNS = DEFINITION_SCHEMA.fieldNames()
EXECUTION_COLUMNS = EXECUTION_SCHEMA.fieldNames()


def ntz(value) -> Column:
    """A datetime (or ISO text) as a TIMESTAMP_NTZ literal, free of the session time zone."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def empty_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DEFINITION_SCHEMA)


def empty_executions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EXECUTION_SCHEMA)


def _complete(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    present = set(df.columns)

    def column(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name].cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def definition_defaults(df: DataFrame, now) -> DataFrame:
    """Definition rows in schema order with absent or NULL columns set to their defaults."""
    return _complete(df, DEFINITION_SCHEMA, {
        "is_enabled": F.lit(True),
        "allow_overlap": F.lit(True),
        "max_retry": F.lit(DEFAULT_MAX_RETRY),
        "timeout_seconds": F.lit(DEFAULT_TIMEOUT_SECONDS),
        "created_at": ntz(now),
        "updated_at": ntz(now),
    })


def execution_defaults(df: DataFrame, now) -> DataFrame:
    """Execution rows in schema order with absent or NULL columns set to their defaults."""
    return _complete(df, EXECUTION_SCHEMA, {
        "status": F.lit(PENDING),
        "param_source": F.lit("cron"),
        "retry_count": F.lit(0),
        "created_at": ntz(now),
    })
