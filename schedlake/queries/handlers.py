"""Python handlers over the pending table."""

import json
import time

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators import handlers as h
from schedlake.operators.changes import apply_outcomes
from schedlake.operators.reports import error_classes
from schedlake.operators.views import pending, pending_fifo, with_definition
from schedlake.queries.registry import query
from schedlake.schemas import TIMEOUT_MESSAGE


def sample_registry() -> h.Registry:
    """Handlers for the fixture names; ``handler_6`` and ``handler_7`` stay unknown."""
    registry = h.Registry()

    def echo(params: dict) -> dict:
        return {"action": params["action"], "count": params.get("k", 0)}

    for i in range(3):
        registry.handler(f"handler_{i}")(echo)

    @registry.handler("handler_3")
    def broken(params: dict) -> None:
        raise ValueError(f"cannot use {params['k']}")

    @registry.handler("handler_4")
    def crowded(params: dict) -> None:
        raise h.PoolExhausted("no free slot")

    @registry.handler("handler_5")
    def silent(params: dict) -> None:
        return None

    return registry


HANDLED = """WITH waiting AS (SELECT e.id, e.handler_name, json_extract_string(e.params, '$.k') AS k FROM executions e
    JOIN definitions d ON e.job_id = d.id WHERE e.status = 'PENDING'),
outcomes AS (SELECT id, CASE WHEN handler_name IN ('handler_0', 'handler_1', 'handler_2', 'handler_5') THEN 'complete'
    ELSE 'fail' END AS kind,
    CASE WHEN handler_name = 'handler_3' THEN concat('cannot use ', k)
        WHEN handler_name = 'handler_4' THEN 'Connection pool exhausted: no free slot'
        WHEN handler_name IN ('handler_6', 'handler_7') THEN concat('Handler not found: ', handler_name) END
    AS error_message,
    CASE WHEN handler_name IN ('handler_0', 'handler_1', 'handler_2')
        THEN concat('{"action":"read","success":true,"id":null,"count":', k, ',"data":null,"error":null}') END AS result
    FROM waiting)
"""


def _waiting(spark, sf):
    return with_definition(pending(fx.executions(spark, sf)), fx.definitions(spark, sf), "inner")


def _outcomes(spark, sf):
    return h.run_handlers(_waiting(spark, sf), sample_registry())


@query(with_ctes("executions definitions", HANDLED + "SELECT * FROM outcomes"))
def handler_outcomes(spark, sf):
    return _outcomes(spark, sf).drop("elapsed_seconds")


@query(with_ctes("executions definitions", HANDLED + """SELECT CASE
    WHEN error_message LIKE 'Handler not found%' THEN 'Handler not found'
    WHEN error_message LIKE 'Connection pool%' THEN 'Connection pool exhausted' ELSE 'other' END AS error_class,
    count(*) AS failures FROM outcomes WHERE error_message IS NOT NULL GROUP BY 1"""))
def handler_error_classes(spark, sf):
    return error_classes(_outcomes(spark, sf))


@query(with_ctes("executions definitions", HANDLED + f"""SELECT e.id, CASE WHEN o.kind = 'complete' THEN 'SUCCESS'
    WHEN o.kind = 'fail' AND e.retry_count + 1 < d.max_retry THEN 'PENDING' WHEN o.kind = 'fail' THEN 'FAILED'
    ELSE CASE WHEN e.status = 'PENDING' THEN 'RUNNING' ELSE e.status END END AS status,
    CAST(e.retry_count + CASE WHEN o.kind = 'fail' THEN 1 ELSE 0 END AS INT) AS retry_count,
    coalesce(CASE WHEN o.kind = 'complete' THEN o.result END, e.result) AS result,
    coalesce(o.error_message, e.error_message) AS error_message
    FROM executions e LEFT JOIN definitions d ON e.job_id = d.id LEFT JOIN outcomes o ON o.id = e.id"""))
def handled_executions(spark, sf):
    execs = fx.executions(spark, sf)
    claimed = execs.withColumn("status", F.expr("IF(status = 'PENDING', 'RUNNING', status)"))
    # A row that was RUNNING before has no outcome and stays as it is.
    done = apply_outcomes(claimed, _outcomes(spark, sf), fx.definitions(spark, sf), fx.AS_OF)
    return done.select("id", "status", "retry_count", "result", "error_message")


BATCHED = """WITH waiting AS (SELECT e.id, e.handler_name, CAST(json_extract_string(e.params, '$.k') AS INT) AS k
    FROM executions e JOIN definitions d ON e.job_id = d.id WHERE e.status = 'PENDING')
SELECT id, CASE WHEN handler_name IN ('handler_0', 'handler_1', 'handler_2') THEN 'complete'
        WHEN handler_name = 'handler_3' AND k % 7 <> 0 THEN 'complete' WHEN handler_name = 'handler_4' AND k % 5 <> 0
        THEN 'complete' WHEN handler_name = 'handler_5' AND id % 100 <> 1 THEN 'complete'
        WHEN handler_name = 'handler_5' THEN 'timeout' ELSE 'fail' END AS kind,
    CASE WHEN handler_name = 'handler_3' AND k % 7 = 0 THEN concat('cannot use ', k)
        WHEN handler_name = 'handler_4' AND k % 5 = 0 THEN concat('Database error: no row ', k)
        WHEN handler_name IN ('handler_6', 'handler_7') THEN concat('Handler not found: ', handler_name) END AS error_message,
    CASE WHEN handler_name IN ('handler_0', 'handler_1', 'handler_2') OR handler_name = 'handler_3' AND k % 7 <> 0
        OR handler_name = 'handler_4' AND k % 5 <> 0
        THEN concat('{"action":"read","success":true,"id":null,"count":', k, ',"data":null,"error":null}') END AS result
FROM waiting"""


@query(with_ctes("executions definitions", BATCHED))
def batch_handler_outcomes(spark, sf):
    """Handlers for batches of rows: one that names its bad rows, one that fails as a whole for any, one that hangs."""
    registry = h.Registry()

    def counts(rows):
        return [json.loads(x)["k"] for x in rows.column("extras").to_pylist()]

    def echo(rows):
        return [{"action": a, "count": k} for a, k in zip(rows.column("action").to_pylist(), counts(rows))]

    for i in range(3):
        registry.batch_handler(f"handler_{i}")(echo)

    @registry.batch_handler("handler_3")
    def broken(rows):
        for k in counts(rows):
            if k % 7 == 0:
                raise ValueError(f"cannot use {k}")
        return echo(rows)

    @registry.batch_handler("handler_4")
    def choosy(rows):
        return [h.DatabaseFailure(f"no row {k}") if k % 5 == 0 else r for k, r in zip(counts(rows), echo(rows))]

    @registry.batch_handler("handler_5")
    def hangs(rows):
        if "hang" in rows.column("value").to_pylist():
            time.sleep(3600)
        return [None] * len(rows)

    slow = (F.col("handler_name") == "handler_5") & (F.col("id") % 100 == 1)
    rows = _waiting(spark, sf).withColumns({
        "params": F.when(slow, F.lit('{"value":"hang"}')).otherwise(F.col("params")),
        "timeout_seconds": F.when(F.col("handler_name") == "handler_5", 0.05).otherwise(60.0)})
    return h.run_handlers(rows, registry).drop("elapsed_seconds")


@query(with_ctes("executions definitions", """SELECT e.id, concat('{"action":"report","count":', n.n, '}') AS result
    FROM executions e JOIN definitions d ON e.job_id = d.id
    JOIN (SELECT job_id, count(*) AS n FROM executions WHERE status = 'SUCCESS' GROUP BY job_id) n
        ON n.job_id = e.job_id WHERE e.status = 'PENDING' AND e.handler_name = 'handler_2'"""))
def table_handler_results(spark, sf):
    registry = h.Registry()

    @registry.table_handler("handler_2", inputs=("history",))
    def report(rows, tables):
        totals = tables["history"].filter("status = 'SUCCESS'").groupBy("job_id").agg(F.count("*").alias("n"))
        return rows.join(totals, "job_id").select(
            "id", F.concat(F.lit('{"action":"report","count":'), F.col("n").cast("string"), F.lit("}")).alias("result"))

    execs = fx.executions(spark, sf)
    waiting = pending_fifo(execs, fx.definitions(spark, sf))
    return h.run_table_handlers(waiting, registry, {"history": execs}).select("id", "result")


@query(with_ctes("executions definitions", """SELECT CASE e.handler_name WHEN 'handler_0' THEN 'Database error'
        WHEN 'handler_1' THEN 'Connection pool exhausted' WHEN 'handler_2' THEN 'Execution timed out'
        WHEN 'handler_3' THEN 'Invalid params' WHEN 'handler_4' THEN 'other' WHEN 'handler_5' THEN 'other'
        ELSE 'Handler not found' END AS error_class, count(*) AS failures
    FROM executions e JOIN definitions d ON e.job_id = d.id WHERE e.status = 'PENDING' GROUP BY 1"""))
def all_error_classes(spark, sf):
    """Every way to fail once: a hanging handler is cut off by its timeout, a result must name its action."""
    registry = h.Registry()

    @registry.handler("handler_0")
    def no_table(params: dict) -> None:
        raise h.DatabaseFailure("no such table")

    @registry.handler("handler_1")
    def crowded(params: dict) -> None:
        raise h.PoolExhausted("no free slot")

    @registry.handler("handler_2")
    def hangs(params: dict) -> None:
        time.sleep(3600)

    @registry.handler("handler_3")
    def never_called(params: dict) -> None:
        raise AssertionError

    @registry.handler("handler_4")
    def broken(params: dict) -> None:
        raise ValueError("broken")

    @registry.handler("handler_5")
    def nameless(params: dict) -> dict:
        return {"count": 1}

    rows = _waiting(spark, sf).withColumns({
        "timeout_seconds": F.when(F.col("handler_name") == "handler_2", 0.01).otherwise(60.0),
        "params": F.when(F.col("handler_name") == "handler_3", "[1]").otherwise(F.col("params"))})
    outcomes = h.run_handlers(rows, registry)
    message = F.when(F.col("kind") == "timeout", TIMEOUT_MESSAGE).otherwise(F.col("error_message"))
    return error_classes(outcomes.withColumn("error_message", message))
