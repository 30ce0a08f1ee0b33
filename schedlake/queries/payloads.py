"""Parameters, results and trigger messages."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.functions import params as p
from schedlake.plans.event_dispatch import enrich_triggers, ingest
from schedlake.queries.registry import query


@query(with_ctes("definitions", """SELECT id, coalesce(json_extract_string(handler_params, '$.action'), 'read')
    AS param_action, CAST(json_extract_string(handler_params, '$.id') AS BIGINT) AS param_id,
    json_extract_string(handler_params, '$.region') AS region, CAST(NULL AS VARCHAR) AS params_error
    FROM definitions"""))
def definition_params(spark, sf):
    parsed = p.parse_params(fx.definitions(spark, sf), "handler_params")
    return parsed.select("id", "param_action", "param_id", F.expr(
        "try_variant_get(param_extras['region'], '$', 'string')").alias("region"), "params_error")


@query(with_ctes("executions", """SELECT id, CASE WHEN id % 4 > 1 THEN 'read' END AS param_action,
    CASE WHEN id % 4 = 3 THEN CAST(json_extract_string(params, '$.k') AS BIGINT) END AS param_id,
    CASE id % 4 WHEN 0 THEN 'Invalid params: not a JSON object' WHEN 1 THEN 'Invalid params: id' END AS params_error
    FROM executions"""))
def execution_params(spark, sf):
    odd = F.expr("""CASE id % 4 WHEN 0 THEN concat('[', params, ']') WHEN 1 THEN '{"id":"x1"}' WHEN 2 THEN params
        ELSE replace(params, '"k"', '"id"') END""")
    return p.parse_params(fx.executions(spark, sf).select("id", odd.alias("params"))).select(
        "id", "param_action", "param_id", "params_error")


@query(with_ctes("executions", """SELECT id, json_extract_string(result, '$.action') AS result_action,
    CASE WHEN result IS NOT NULL THEN true END AS result_success,
    CAST(json_extract_string(result, '$.count') AS BIGINT) AS result_count, CAST(NULL AS VARCHAR) AS result_error
    FROM executions"""))
def execution_results(spark, sf):
    return p.parse_result(fx.executions(spark, sf).select("id", "result")).select(
        "id", "result_action", "result_success", "result_count", "result_error")


# The parts of a trigger by its kind.
PARTS = """WITH parts AS (SELECT msg_topic, msg_partition, msg_offset, ts, value, value LIKE '{%' AS ok,
    CASE WHEN value LIKE '{%' THEN coalesce(json_extract_string(value, '$.handler_name'),
        json_extract_string(value, '$.handler')) END AS handler_name,
    CASE WHEN value LIKE '{%' THEN json_extract(value, '$.params') END AS params,
    CASE WHEN value LIKE '{%' THEN CAST(json_extract_string(value, '$.job_id') AS BIGINT) END AS job_id
    FROM triggers),
reasoned AS (SELECT p.*, CASE WHEN NOT ok THEN 'unparsable' WHEN handler_name IS NULL THEN 'missing_handler'
    WHEN coalesce(json_type(params), 'NULL') NOT IN ('NULL', 'OBJECT') THEN 'params_not_object'
    WHEN job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM definitions) THEN 'unknown_job_id' END AS reason
    FROM parts p)
"""


@query(with_ctes("triggers definitions", PARTS + """SELECT msg_partition, msg_offset, handler_name, job_id,
    CASE WHEN reason = 'unknown_job_id' THEN NULL ELSE reason END AS reason,
    json_extract_string(params, '$.k') AS k FROM reasoned"""))
def parsed_triggers(spark, sf):
    return p.parse_trigger(fx.triggers(spark, sf)).select(
        "msg_partition", "msg_offset", "handler_name", "job_id", "reason",
        F.expr("try_variant_get(event_params['k'], '$', 'string')").alias("k"))


# Merged parameters as text: the event's keys replace those of the base in place, new ones follow.
MERGED = PARTS + """, owners AS (SELECT handler_name, min(id) AS id FROM definitions GROUP BY handler_name),
based AS (SELECT r.*, o.id AS resolved_id, b.handler_params AS base,
    json_extract_string(r.params, '$.k') AS k, json_extract_string(r.params, '$.id') AS event_id,
    CASE WHEN json_type(json_extract(r.params, '$.k')) = 'VARCHAR' THEN '"s"'
        ELSE json_extract_string(r.params, '$.k') END AS k_json
    FROM reasoned r LEFT JOIN owners o ON r.job_id IS NULL AND o.handler_name = r.handler_name
    LEFT JOIN definitions b ON b.id = o.id),
merged AS (SELECT *, CASE
    WHEN base IS NULL AND k IS NULL THEN NULL
    WHEN base IS NULL AND event_id IS NULL THEN concat('{"k":', k_json, '}')
    WHEN base IS NULL THEN concat('{"id":', event_id, ',"k":', k_json, '}')
    WHEN k IS NULL THEN base
    WHEN event_id IS NULL THEN concat(left(base, -1), ',"k":', k_json, '}')
    ELSE concat(left(regexp_replace(base, '"id":[0-9]+', concat('"id":', event_id)), -1), ',"k":', k_json, '}')
    END AS merged_params FROM based)
"""
EVENT_ID_SQL = "4611686018427387904 + CAST(msg_partition AS BIGINT) * 1099511627776 + msg_offset"
CREATED_SQL = MERGED + f"""SELECT {EVENT_ID_SQL} AS id, coalesce(job_id, resolved_id) AS job_id, handler_name, ts AS scheduled_time,
    'PENDING' AS status, merged_params AS params, 'event' AS param_source, CAST(0 AS INT) AS retry_count,
    ts AS created_at, msg_topic, msg_partition, msg_offset FROM merged WHERE reason IS NULL"""
CREATED = ["id", "job_id", "handler_name", "scheduled_time", "status", "params", "param_source", "retry_count", "created_at",
           "msg_topic", "msg_partition", "msg_offset"]
BAD_SQL = PARTS + "SELECT msg_topic, msg_partition, msg_offset, ts, value, reason FROM reasoned WHERE reason IS NOT NULL"


@query(with_ctes("triggers definitions", CREATED_SQL))
def event_executions(spark, sf):
    return ingest(fx.triggers(spark, sf), fx.definitions(spark, sf)).created.select(*CREATED)


@query(with_ctes("triggers definitions", BAD_SQL))
def bad_triggers(spark, sf):
    return ingest(fx.triggers(spark, sf), fx.definitions(spark, sf)).quarantined


@query(with_ctes("triggers definitions", MERGED + """SELECT msg_partition, msg_offset,
    concat(CASE WHEN base IS NOT NULL THEN '"action":"sync",' END,
        CASE WHEN base IS NOT NULL OR event_id IS NOT NULL THEN concat('"id":',
            coalesce(event_id, json_extract_string(base, '$.id')), ',') END,
        CASE WHEN k IS NOT NULL THEN concat('"k":', k_json, ',') END,
        CASE WHEN base IS NOT NULL THEN concat('"region":"', json_extract_string(base, '$.region'), '"') END)
    AS merged FROM merged WHERE reason IS NULL AND merged_params IS NOT NULL"""))
def merged_params_in_key_order(spark, sf):
    rows = enrich_triggers(fx.triggers(spark, sf), fx.definitions(spark, sf)).filter("reason IS NULL")
    text = F.expr(p.sorted_json("params_map"))
    # Both sides drop the braces; the SQL leaves a trailing comma where no region follows.
    body = F.expr("substring(text, 2, length(text) - 2)")
    return rows.select("msg_partition", "msg_offset", text.alias("text")).filter("text IS NOT NULL").select(
        "msg_partition", "msg_offset", F.concat(body, F.when(~F.col("text").contains("region"), ",").otherwise(
            "")).alias("merged"))
