"""State, attempts, overlapping runs."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators import lifecycle as lc
from schedlake.queries.registry import query

# One row per execution and transition, walked in order.
WALK = """WITH ordered AS (SELECT *, execution_id % 5 AS max_retry,
    row_number() OVER (PARTITION BY execution_id ORDER BY ts, seq) AS rn FROM transitions),
walk AS (
  SELECT DISTINCT execution_id, CAST(0 AS BIGINT) AS rn, 'PENDING' AS status, CAST(0 AS INT) AS retry_count,
    CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at,
    CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS VARCHAR) AS result, CAST(0 AS BIGINT) AS applied,
    CAST(0 AS BIGINT) AS ignored, CAST(0 AS BIGINT) AS steps, CAST(NULL AS VARCHAR) AS step_kind,
    CAST(NULL AS TIMESTAMP) AS ts FROM transitions
  UNION ALL
  SELECT execution_id, nrn, coalesce(m, status),
    CAST(retry_count + CASE WHEN m IS NOT NULL AND kind IN ('fail', 'timeout') THEN 1 ELSE 0 END AS INT),
    CASE WHEN m = 'RUNNING' THEN nts WHEN m = 'PENDING' THEN NULL ELSE started_at END,
    CASE WHEN m = 'PENDING' THEN NULL WHEN m IN ('SUCCESS', 'FAILED', 'TIMEOUT') THEN nts ELSE finished_at END,
    CASE WHEN m IS NULL THEN error_message WHEN kind = 'timeout' THEN 'Execution timed out' WHEN kind = 'fail' THEN nerror
      WHEN kind = 'retry' THEN NULL ELSE error_message END,
    CASE WHEN m = 'SUCCESS' THEN nresult WHEN m IS NOT NULL AND kind = 'retry' THEN NULL ELSE result END,
    applied + CASE WHEN m IS NULL THEN 0 ELSE 1 END, ignored + CASE WHEN m IS NULL THEN 1 ELSE 0 END,
    steps + CASE WHEN m IS NOT NULL AND kind <> 'retry' THEN 1 ELSE 0 END,
    CASE WHEN m IS NOT NULL AND kind <> 'retry' THEN kind END, nts
  FROM (SELECT w.*, o.rn AS nrn, o.ts AS nts, o.kind, o.error_message AS nerror, o.result AS nresult, CASE
      WHEN w.status = 'PENDING' AND o.kind = 'claim' THEN 'RUNNING'
      WHEN w.status = 'RUNNING' AND o.kind = 'complete' THEN 'SUCCESS'
      WHEN w.status = 'RUNNING' AND o.kind IN ('fail', 'timeout') THEN CASE
        WHEN w.retry_count + 1 < o.max_retry THEN 'PENDING' WHEN o.kind = 'fail' THEN 'FAILED' ELSE 'TIMEOUT' END
      WHEN w.status IN ('FAILED', 'TIMEOUT') AND o.kind = 'retry' THEN 'PENDING' END AS m
    FROM walk w JOIN ordered o ON o.execution_id = w.execution_id AND o.rn = w.rn + 1) z)
"""
STATE_SQL = with_ctes("transitions", WALK + """SELECT execution_id, status, retry_count, started_at, finished_at,
    error_message, result, applied, ignored FROM walk
    QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY rn DESC) = 1""", recursive=True)


#: The same for a log where every 97th row deletes its execution.
EDITED = "edited AS (SELECT * REPLACE (CASE WHEN seq % 97 = 0 THEN 'delete' ELSE kind END AS kind) FROM transitions),"
STATE_WITH_DELETES_SQL = STATE_SQL.replace("ordered AS (", EDITED + "\nordered AS (", 1).replace(
    "AS rn FROM transitions)", "AS rn FROM edited)").replace(
    "AS nresult, CASE", "AS nresult, CASE WHEN w.status <> 'DELETED' AND o.kind = 'delete' THEN 'DELETED'") + " AND status <> 'DELETED'"


def max_retry():
    """The limit of an execution, as its first row says; later rows say something else."""
    return F.when(F.col("seq") == F.col("first_seq"), F.col("execution_id") % 5).otherwise(9)


def logs(transitions):
    """Transitions with the number of the first row of their execution."""
    first = transitions.groupBy("execution_id").agg(F.min_by("seq", F.struct("ts", "seq")).alias("first_seq"))
    return transitions.join(first, "execution_id")


def fixed_limit():
    return F.col("execution_id") % 5


@query(STATE_SQL)
def current_state(spark, sf):
    return lc.current_state(fx.transitions(spark, sf), fixed_limit(), limit_by_id=True)


ATTEMPTS_SQL = with_ctes("transitions", WALK + """, pairs AS (SELECT *, (steps - 1) // 2 AS pair FROM walk
    WHERE step_kind IS NOT NULL)
SELECT execution_id, CAST(pair + 1 AS BIGINT) AS attempt, max(ts) FILTER (step_kind = 'claim') AS claimed_at,
    max(ts) FILTER (step_kind <> 'claim') AS ended_at, max(step_kind) FILTER (step_kind <> 'claim') AS outcome,
    max(error_message) FILTER (step_kind IN ('fail', 'timeout')) AS error_message
FROM pairs GROUP BY execution_id, pair""", recursive=True)


@query(ATTEMPTS_SQL)
def attempts(spark, sf):
    return lc.attempts(fx.transitions(spark, sf), fixed_limit(), limit_by_id=True)


@query(STATE_SQL)
def current_state_of_changing_limits(spark, sf):
    return lc.current_state(logs(fx.transitions(spark, sf)), max_retry())


@query(ATTEMPTS_SQL)
def attempts_of_changing_limits(spark, sf):
    return lc.attempts(logs(fx.transitions(spark, sf)), max_retry())


@query(with_ctes("executions definitions", """SELECT * FROM (SELECT e.id, e.job_id, e.started_at, max(coalesce(
    e.finished_at, TIMESTAMP '9999-12-31 00:00:00')) OVER (PARTITION BY e.job_id ORDER BY e.started_at, e.id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocked_until
    FROM executions e JOIN definitions d ON e.job_id = d.id WHERE NOT d.allow_overlap AND e.started_at IS NOT NULL)
    WHERE blocked_until > started_at"""))
def overlapping_runs(spark, sf):
    return lc.overlaps(fx.executions(spark, sf), fx.definitions(spark, sf))
