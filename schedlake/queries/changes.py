"""Bulk changes."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators import changes as c
from schedlake.queries.registry import query

NOW = fx.AS_OF

NEW_SQL = """SELECT CASE WHEN id % 3 = 0 THEN name WHEN id % 10 = 1 THEN 'shared' ELSE concat(name, '_new') END AS name,
    description, cron_expression, handler_name, handler_params, is_enabled, allow_overlap, max_retry, timeout_seconds,
    (id - 1) % 12 AS k FROM definitions"""


def _new_definitions(defs):
    name = F.expr("CASE WHEN id % 3 = 0 THEN name WHEN id % 10 = 1 THEN 'shared' ELSE concat(name, '_new') END")
    return defs.select(name.alias("name"), "description", "cron_expression", "handler_name", "handler_params",
                       "is_enabled", "allow_overlap", "max_retry", "timeout_seconds")


@query(with_ctes("definitions", f"""WITH incoming AS ({NEW_SQL}), good AS (SELECT * FROM incoming i WHERE k < 10
    AND name NOT IN (SELECT name FROM definitions)
    AND name NOT IN (SELECT name FROM incoming GROUP BY name HAVING count(*) > 1))
SELECT * FROM definitions UNION ALL SELECT row_number() OVER (ORDER BY md5(name), name) +
    (SELECT max(id) FROM definitions), name, description, cron_expression, handler_name, handler_params, is_enabled,
    allow_overlap, max_retry, timeout_seconds, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM good"""))
def insert_definitions(spark, sf):
    defs = fx.definitions(spark, sf)
    return c.insert_definitions(defs, _new_definitions(defs), NOW).table


@query(with_ctes("definitions", f"""WITH incoming AS ({NEW_SQL}), judged AS (SELECT name, cron_expression, concat_ws(',',
    CASE k WHEN 10 THEN 'never_fires' WHEN 11 THEN 'parse_error' END,
    CASE WHEN name IN (SELECT name FROM definitions) THEN 'name_taken'
        WHEN name IN (SELECT name FROM incoming GROUP BY name HAVING count(*) > 1) THEN 'name_repeated' END) AS errors
    FROM incoming) SELECT * FROM judged WHERE errors <> ''"""))
def insert_definitions_rejected(spark, sf):
    defs = fx.definitions(spark, sf)
    rejected = c.insert_definitions(defs, _new_definitions(defs), NOW).rejected
    return rejected.withColumn("errors", F.array_join("errors", ","))


def _patches(defs):
    return defs.filter("id % 4 < 3").select(
        "id", F.expr("IF(id % 2 = 0, concat(name, '_v2'), NULL)").alias("name"),
        F.expr("IF(id % 3 = 0, 900, NULL)").alias("timeout_seconds"))


@query(with_ctes("definitions", f"""SELECT * REPLACE (
    CASE WHEN id % 4 < 3 AND id % 2 = 0 THEN concat(name, '_v2') ELSE name END AS name,
    CAST(CASE WHEN id % 4 < 3 AND id % 3 = 0 THEN 900 ELSE timeout_seconds END AS INT) AS timeout_seconds,
    CASE WHEN id % 4 < 3 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM definitions"""))
def update_definitions(spark, sf):
    defs = fx.definitions(spark, sf)
    return c.update_definitions(defs, _patches(defs), NOW).table


@query(with_ctes("definitions", """SELECT id + 50 AS id FROM definitions WHERE id % 4 < 3
    AND id + 50 NOT IN (SELECT id FROM definitions)"""))
def update_definitions_missing(spark, sf):
    defs = fx.definitions(spark, sf)
    shifted = _patches(defs).withColumn("id", F.col("id") + 50)
    return c.update_definitions(defs, shifted, NOW).rejected.select("id")


@query(with_ctes("definitions", f"""SELECT * REPLACE (
    CASE WHEN max_retry = 2 THEN NOT is_enabled ELSE is_enabled END AS is_enabled,
    CASE WHEN max_retry = 2 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM definitions"""))
def toggle_definitions(spark, sf):
    defs = fx.definitions(spark, sf)
    return c.toggle_definitions(defs, defs.filter("max_retry = 2").select("id"), NOW).table


@query(with_ctes("definitions", f"""SELECT * REPLACE (
    CASE WHEN max_retry = 3 THEN false ELSE is_enabled END AS is_enabled,
    CASE WHEN max_retry = 3 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM definitions"""))
def disable_definitions(spark, sf):
    defs = fx.definitions(spark, sf)
    return c.set_enabled(defs, defs.filter("max_retry = 3").select("id"), False, NOW).table


@query(with_ctes("definitions", "SELECT * FROM definitions WHERE max_retry <> 1"))
def delete_definitions(spark, sf):
    defs = fx.definitions(spark, sf)
    return c.delete_definitions(defs, fx.executions(spark, sf), defs.filter("max_retry = 1")).definitions


@query(with_ctes("definitions executions", """SELECT id, job_id, status FROM executions
    WHERE job_id IS NULL OR job_id NOT IN (SELECT id FROM definitions WHERE max_retry = 1)"""))
def cascade_delete(spark, sf):
    defs = fx.definitions(spark, sf)
    rest = c.delete_definitions(defs, fx.executions(spark, sf), defs.filter("max_retry = 1")).executions
    return rest.select("id", "job_id", "status")


@query(with_ctes("executions", f"""WITH first AS (SELECT id FROM executions WHERE status = 'PENDING'
    ORDER BY created_at, id LIMIT 100)
SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM first) THEN 'RUNNING' ELSE status END AS status,
    CASE WHEN id IN (SELECT id FROM first) THEN TIMESTAMP '{NOW}' ELSE started_at END AS started_at)
    FROM executions"""))
def claim_executions(spark, sf):
    return c.claim(fx.executions(spark, sf), 100, NOW)


# Outcomes of the RUNNING rows by id; rows that do not run are offered too and must not change.
OUTCOMES = """WITH j AS (SELECT e.*, coalesce(d.max_retry, 3) AS mr, {kind} AS k FROM executions e
    LEFT JOIN definitions d ON e.job_id = d.id),
flagged AS (SELECT *, status = 'RUNNING' AND k IS NOT NULL AS ends, status = 'RUNNING' AND k IN ('fail', 'timeout')
    AND retry_count + 1 < mr AS again FROM j)
SELECT id, job_id, handler_name, scheduled_time,
    CASE WHEN again THEN 'PENDING' WHEN ends AND k = 'complete' THEN 'SUCCESS' WHEN ends AND k = 'fail' THEN 'FAILED'
        WHEN ends THEN 'TIMEOUT' ELSE status END AS status,
    params, param_source, CASE WHEN again THEN NULL ELSE started_at END AS started_at,
    CASE WHEN again THEN NULL WHEN ends THEN TIMESTAMP '""" + NOW + """' ELSE finished_at END AS finished_at,
    CAST(retry_count + CASE WHEN ends AND k <> 'complete' THEN 1 ELSE 0 END AS INT) AS retry_count,
    CASE WHEN ends AND k = 'timeout' THEN 'Execution timed out' WHEN ends AND k = 'fail' THEN concat('bad ', id)
        ELSE error_message END AS error_message,
    CASE WHEN ends AND k = 'complete' THEN concat('{{"action":"sync","id":', id, '}}') ELSE result END AS result,
    created_at FROM flagged"""


def _outcomes(execs):
    return execs.select(
        "id", F.expr("CASE id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'timeout' END").alias("kind"),
        F.expr("IF(id % 4 = 1, concat('bad ', id), NULL)").alias("error_message"),
        F.expr("""IF(id % 4 = 0, concat('{"action":"sync","id":', id, '}'), NULL)""").alias("result")).filter(
        "kind IS NOT NULL")


@query(with_ctes("executions definitions", OUTCOMES.format(
    kind="CASE e.id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'timeout' END")))
def apply_outcomes(spark, sf):
    execs = fx.executions(spark, sf)
    return c.apply_outcomes(execs, _outcomes(execs), fx.definitions(spark, sf), NOW)


@query(with_ctes("executions definitions", OUTCOMES.format(kind="CASE WHEN e.id % 4 = 0 THEN 'complete' END")))
def complete_executions(spark, sf):
    execs = fx.executions(spark, sf)
    return c.complete(execs, _outcomes(execs).filter("kind = 'complete'"), fx.definitions(spark, sf), NOW)


@query(with_ctes("executions definitions", OUTCOMES.format(kind="CASE WHEN e.id % 4 = 1 THEN 'fail' END")))
def fail_executions(spark, sf):
    execs = fx.executions(spark, sf)
    return c.fail(execs, _outcomes(execs).filter("kind = 'fail'"), fx.definitions(spark, sf), NOW)


@query(with_ctes("executions definitions", OUTCOMES.format(kind="CASE WHEN e.id % 4 = 2 THEN 'timeout' END")))
def time_out_executions(spark, sf):
    execs = fx.executions(spark, sf)
    return c.time_out(execs, _outcomes(execs).filter("kind = 'timeout'"), fx.definitions(spark, sf), NOW)


@query(with_ctes("executions", """SELECT * REPLACE (
    CASE WHEN status = 'FAILED' AND id % 2 = 0 THEN 'PENDING' ELSE status END AS status,
    CASE WHEN status = 'FAILED' AND id % 2 = 0 THEN NULL ELSE started_at END AS started_at,
    CASE WHEN status = 'FAILED' AND id % 2 = 0 THEN NULL ELSE finished_at END AS finished_at) FROM executions"""))
def reset_executions(spark, sf):
    execs = fx.executions(spark, sf)
    return c.reset_to_pending(execs, execs.filter("status = 'FAILED' AND id % 2 = 0").select("id"))


HIT = "id % 3 = 0 AND status IN ('FAILED', 'TIMEOUT')"


@query(with_ctes("executions", f"""SELECT * REPLACE (CASE WHEN {HIT} THEN 'PENDING' ELSE status END AS status,
    CASE WHEN {HIT} THEN NULL ELSE started_at END AS started_at,
    CASE WHEN {HIT} THEN NULL ELSE finished_at END AS finished_at,
    CASE WHEN {HIT} THEN NULL ELSE error_message END AS error_message,
    CASE WHEN {HIT} THEN NULL ELSE result END AS result) FROM executions"""))
def retry_executions(spark, sf):
    execs = fx.executions(spark, sf)
    return c.retry(execs, execs.filter("id % 3 = 0").select("id")).table


@query(with_ctes("executions", """SELECT id, concat('Cannot retry job with status ''', status,
    '''. Only FAILED or TIMEOUT jobs can be retried.') AS reason FROM executions
    WHERE id % 3 = 0 AND status NOT IN ('FAILED', 'TIMEOUT')
UNION ALL SELECT id + 1000000000, concat('Job execution with id ', id + 1000000000, ' not found') FROM executions
    WHERE id % 3 = 1"""))
def retry_executions_rejected(spark, sf):
    execs = fx.executions(spark, sf)
    ids = execs.select("id").filter("id % 3 = 0").unionByName(
        execs.filter("id % 3 = 1").select((F.col("id") + 1000000000).alias("id")))
    return c.retry(execs, ids).rejected


@query(with_ctes("executions", "SELECT * FROM executions WHERE status <> 'TIMEOUT'"))
def delete_executions(spark, sf):
    execs = fx.executions(spark, sf)
    return c.delete_executions(execs, execs.filter("status = 'TIMEOUT'").select("id")).table


@query(with_ctes("executions", f"""SELECT * FROM executions WHERE NOT (created_at < TIMESTAMP '{fx.SINCE}'
    AND status IN ('SUCCESS', 'FAILED', 'TIMEOUT'))"""))
def retained_executions(spark, sf):
    return c.retain(fx.executions(spark, sf), fx.SINCE)


@query(with_ctes("executions", f"""SELECT id, status, created_at FROM executions WHERE
    created_at < TIMESTAMP '{fx.SINCE}' AND status IN ('SUCCESS', 'FAILED', 'TIMEOUT')"""))
def expired_executions(spark, sf):
    return c.expired(fx.executions(spark, sf), fx.SINCE).select("id", "status", "created_at")


@query(with_ctes("executions definitions", """SELECT e.id, e.job_id, e.status, e.retry_count,
    coalesce(d.max_retry, 3) AS max_retry, CASE WHEN e.status NOT IN ('FAILED', 'TIMEOUT') THEN 'NOT_APPLICABLE'
        WHEN e.retry_count < coalesce(d.max_retry, 3) THEN 'RETRY' ELSE 'EXHAUSTED' END AS decision,
    CAST(greatest(coalesce(d.max_retry, 3) - e.retry_count, 0) AS INT) AS attempts_left
    FROM executions e LEFT JOIN definitions d ON e.job_id = d.id"""))
def retry_decisions(spark, sf):
    return c.retry_decision(fx.executions(spark, sf), fx.definitions(spark, sf))


@query(with_ctes("executions definitions", """SELECT * FROM (SELECT e.id, e.job_id, e.status,
    CAST(date_diff('microsecond', e.started_at, e.finished_at) AS DOUBLE) / 1000000.0 AS run_seconds,
    coalesce(d.timeout_seconds, 3600) AS timeout_seconds FROM executions e LEFT JOIN definitions d ON e.job_id = d.id
    WHERE e.finished_at IS NOT NULL) WHERE run_seconds > timeout_seconds"""))
def timeout_violations(spark, sf):
    return c.timeout_violations(fx.executions(spark, sf), fx.definitions(spark, sf))


@query(with_ctes("executions definitions", f"""SELECT * FROM (SELECT e.id, e.job_id, e.handler_name, e.started_at,
    coalesce(d.timeout_seconds, 3600) AS timeout_seconds,
    e.started_at + INTERVAL 1 SECOND * coalesce(d.timeout_seconds, 3600) AS deadline
    FROM executions e LEFT JOIN definitions d ON e.job_id = d.id WHERE e.status = 'RUNNING')
    WHERE deadline < TIMESTAMP '{fx.AS_OF}'"""))
def stuck_executions(spark, sf):
    return c.stuck(fx.executions(spark, sf), fx.definitions(spark, sf), fx.AS_OF)


def _odd_patches(defs):
    """Bad crons, taken and repeated names, limits, several patches of one id, and good ones."""
    def patch(rows, **values):
        columns = {"name": "string", "cron_expression": "string", "max_retry": "int"}
        return rows.select("id", *[F.lit(values.get(c)).cast(t).alias(c) for c, t in columns.items()])

    return (patch(defs.filter("id % 10 = 1"), cron_expression="nonsense here * *")
            .unionByName(patch(defs.filter("id % 10 = 2"), max_retry=99))
            .unionByName(defs.filter("id % 10 = 3").select(
                "id", F.concat(F.lit("Supplier#"), F.lpad((F.col("id") - 2).cast("string"), 9, "0")).alias("name"),
                F.lit(None).cast("string").alias("cron_expression"), F.lit(None).cast("int").alias("max_retry")))
            .unionByName(patch(defs.filter("id % 10 = 4"), max_retry=1)).unionByName(patch(defs.filter("id % 10 = 4"), max_retry=2))
            .unionByName(patch(defs.filter("id % 10 = 5"), name="the same"))
            .unionByName(patch(defs.filter("id % 10 = 6"), max_retry=7, cron_expression="0 5 * * *")))


@query(with_ctes("definitions", f"""SELECT * REPLACE (
    CASE WHEN id % 10 = 6 THEN '0 5 * * *' ELSE cron_expression END AS cron_expression,
    CAST(CASE WHEN id % 10 = 6 THEN 7 ELSE max_retry END AS INT) AS max_retry,
    CASE WHEN id % 10 = 6 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM definitions"""))
def update_definitions_checked(spark, sf):
    """Patches that break a rule change nothing."""
    defs = fx.definitions(spark, sf)
    return c.update_definitions(defs, _odd_patches(defs).filter("name IS NULL OR name <> 'the same'"), NOW).table


@query(with_ctes("definitions", """SELECT id, CASE id % 10 WHEN 1 THEN 'parse_error' WHEN 2 THEN 'max_retry'
    WHEN 4 THEN 'several_patches' WHEN 5 THEN 'name_repeated' WHEN 3 THEN 'name_taken' END AS errors
    FROM definitions WHERE id % 10 IN (1, 2, 4, 3) OR (id % 10 = 5 AND (SELECT count(*) FROM definitions WHERE id % 10 = 5) > 1)"""))
def update_definitions_rejected(spark, sf):
    defs = fx.definitions(spark, sf)
    rejected = c.update_definitions(defs, _odd_patches(defs), NOW).rejected
    return rejected.select("id", F.array_join("errors", ",").alias("errors"))


@query(with_ctes("executions definitions", OUTCOMES.format(
    kind="CASE e.id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'timeout' END")))
def apply_outcomes_repeated(spark, sf):
    """Every outcome is delivered twice and counts once."""
    execs = fx.executions(spark, sf)
    outcomes = _outcomes(execs)
    return c.apply_outcomes(execs, outcomes.unionByName(outcomes), fx.definitions(spark, sf), NOW)
