"""JSON parameters, results and trigger messages as ``map<string, variant>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.schemas import INVALID_PARAMS


def unwrap(text: str) -> str:
    """SQL that takes one layer off a JSON string that holds JSON."""
    return f"""CASE WHEN startswith(ltrim({text}), '"') THEN try_variant_get(try_parse_json({text}), '$', 'string')
        ELSE {text} END"""


STRICT = "map('allowSingleQuotes', 'false')"


def whole_value(text: str) -> str:
    """SQL whether a text is one JSON value and nothing else: the parser stops after the first value of a text, so the
    text is set between two keys, of which the second must be found."""
    framed = f"""from_json(concat('{{"x":', {text}, ',"y":1}}'), 'map<string, string>', {STRICT})"""
    return f"coalesce(transform(array({framed}), f -> size(f) = 2 AND map_contains_key(f, 'y'))[0], false)"


def as_map(text: str) -> str:
    """SQL map<string, variant> of a JSON object; NULL for anything else. A repeated key keeps its last value."""
    parsed = f"""from_json(IF(ltrim({text}) LIKE '{{%' AND {whole_value(text)}, {text}, NULL),
        'map<string, variant>', {STRICT})"""
    last = """filter(map_entries(m), (e, i) -> NOT exists(slice(map_keys(m), i + 2, size(m)), k -> k = e.key))"""
    return f"""transform(array({parsed}), m -> IF(size(array_distinct(map_keys(m))) = size(m), m,
        map_from_entries({last})))[0]"""


EMPTY_MAP = "from_json('{}', 'map<string, variant>')"


def kind_of(value: str) -> str:
    return f"schema_of_variant({value})"


def merge_params(base: str, event: str) -> str:
    """SQL shallow merge of two maps: the event wins, an explicit null too; keys keep their first place."""
    return f"""map_concat(
        transform_values({base}, (k, v) -> IF(map_contains_key({event}, k), {event}[k], v)),
        map_filter({event}, (k, v) -> NOT map_contains_key({base}, k)))"""


def encode_params(params: str) -> str:
    """SQL JSON text of a map; NULL for no parameters."""
    return f"IF(size({params}) = 0, NULL, to_json({params}))"


def sorted_json(params: str) -> str:
    """SQL JSON text with keys in order, for comparing."""
    return f"""IF(size({params}) = 0, NULL, to_json(map_from_entries(array_sort(map_entries({params}),
        (l, r) -> CASE WHEN l.key < r.key THEN -1 WHEN l.key > r.key THEN 1 ELSE 0 END))))"""


def _is_null(value: str) -> str:
    return f"coalesce({value} IS NULL OR is_variant_null({value}), true)"


def _typed_error(field: str, good: str) -> str:
    return f"WHEN NOT ({good}) THEN '{field}'"


def _text_ok(value: str) -> str:
    return f"{_is_null(value)} OR {kind_of(value)} = 'STRING'"


def _int_ok(value: str) -> str:
    return f"""{_is_null(value)} OR ({kind_of(value)} IN ('BIGINT', 'BOOLEAN', 'STRING') AND
        try_variant_get({value}, '$', 'bigint') IS NOT NULL) OR
        coalesce(try_variant_get({value}, '$', 'double') = try_variant_get({value}, '$', 'bigint'), false)"""


def parse_params(df: DataFrame, column: str = "params") -> DataFrame:
    """Adds the known parameters, the remaining ones and ``params_error`` (NULL where they are valid)."""
    out = df.withColumn("_text", F.expr(unwrap(f"`{column}`")))
    out = out.withColumn("_map", F.expr(
        f"IF(coalesce(trim(_text), '') = '', {EMPTY_MAP}, {as_map('_text')})"))
    bad = f"""CASE WHEN _map IS NULL THEN 'not a JSON object'
        WHEN map_contains_key(_map, 'action') AND ({_is_null("_map['action']")}
            OR {kind_of("_map['action']")} <> 'STRING') THEN 'action'
        {_typed_error('id', _int_ok("_map['id']"))}
        {_typed_error('name', _text_ok("_map['name']"))}
        {_typed_error('value', _text_ok("_map['value']"))} END"""
    out = out.withColumn("_bad", F.expr(bad))
    ok = F.col("_bad").isNull()
    return out.select(
        *df.columns,
        F.when(ok, F.expr("coalesce(try_variant_get(_map['action'], '$', 'string'), 'read')")).alias("param_action"),
        F.when(ok, F.expr("try_variant_get(_map['id'], '$', 'bigint')")).alias("param_id"),
        F.when(ok, F.expr("try_variant_get(_map['name'], '$', 'string')")).alias("param_name"),
        F.when(ok, F.expr("try_variant_get(_map['value'], '$', 'string')")).alias("param_value"),
        F.when(ok, F.expr("map_filter(_map, (k, v) -> NOT k IN ('action', 'id', 'name', 'value'))"))
        .alias("param_extras"),
        F.concat(F.lit(INVALID_PARAMS), F.col("_bad")).alias("params_error"))


def parse_result(df: DataFrame, column: str = "result") -> DataFrame:
    """Adds the known result fields; ``success`` defaults to true, ``data`` stays JSON text."""
    out = df.withColumn("_map", F.expr(as_map(f"`{column}`")))

    def get(key: str, kind: str) -> Column:
        return F.expr(f"try_variant_get(_map['{key}'], '$', '{kind}')")

    return out.select(
        *df.columns,
        get("action", "string").alias("result_action"),
        F.expr("CASE WHEN _map IS NOT NULL THEN coalesce(try_variant_get(_map['success'], '$', 'boolean'), true) END")
        .alias("result_success"),
        get("id", "bigint").alias("result_id"), get("count", "bigint").alias("result_count"),
        F.expr(f"IF({_is_null('''_map['data']''')}, NULL, to_json(_map['data']))").alias("result_data"),
        get("error", "string").alias("result_error"),
        F.expr("map_filter(_map, (k, v) -> NOT k IN ('action','success','id','count','data','error'))")
        .alias("result_extras"))


def parse_trigger(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``handler_name``, ``event_params`` (a map), ``job_id`` and ``reason`` for messages no one can run.

    A missing or null ``params`` is an empty object; a job id of 0 is no job id.
    """
    out = df.withColumn("_map", F.expr(as_map(f"cast(`{column}` AS STRING)")))
    out = out.withColumns({
        "handler_name": F.expr("""coalesce(nullif(try_variant_get(_map['handler_name'], '$', 'string'), ''),
            nullif(try_variant_get(_map['handler'], '$', 'string'), ''))"""),
        "_params": F.expr("_map['params']"),
        "job_id": F.expr("nullif(try_variant_get(_map['job_id'], '$', 'bigint'), 0L)"),
        "_job_given": F.expr(f"NOT ({_is_null('''_map['job_id']''')})"),
    })
    no_params = _is_null("_params")
    out = out.withColumn("event_params", F.expr(
        f"IF({no_params}, {EMPTY_MAP}, try_variant_get(_params, '$', 'map<string, variant>'))"))
    reason = F.expr("""CASE WHEN _map IS NULL THEN 'unparsable' WHEN handler_name IS NULL THEN 'missing_handler'
        WHEN event_params IS NULL THEN 'params_not_object'
        WHEN _job_given AND job_id IS NULL AND try_variant_get(_map['job_id'], '$', 'bigint') IS NULL
        THEN 'unknown_job_id' END""")
    return out.select(*df.columns, "handler_name", "event_params", "job_id", reason.alias("reason"))
