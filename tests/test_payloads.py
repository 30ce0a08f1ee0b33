"""JSON parameters, merging, results, triggers, handlers."""

import json
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schedlake.functions import params as p
from schedlake.operators import handlers as h


def _one(spark, text, name="params"):
    return spark.createDataFrame([(text,)], f"{name} string")


@pytest.mark.parametrize("text, wanted", [
    ('{"id":"12","action":"go","z":[1,{"k":2.5}]}', ("go", 12, None, None)),
    ('{"id":2.0,"name":"n","value":"v"}', ("read", 2, "n", "v")),
    ('"{\\"id\\":1}"', ("read", 1, None, None)),
    (None, ("read", None, None, None)), ("", ("read", None, None, None)), ("{}", ("read", None, None, None)),
    ('{"id":null}', ("read", None, None, None)),
])
def test_valid_params(spark, text, wanted):
    r = p.parse_params(_one(spark, text)).first()
    assert (r.param_action, r.param_id, r.param_name, r.param_value) == wanted and r.params_error is None


@pytest.mark.parametrize("text, error", [
    ("[1]", "not a JSON object"), ("3", "not a JSON object"), ("bad{", "not a JSON object"),
    ("null", "not a JSON object"), ('{"id":"q"}', "id"), ('{"id":2.5}', "id"), ('{"name":3}', "name"),
    ('{"value":true}', "value"), ('{"action":null}', "action")])
def test_invalid_params(spark, text, error):
    r = p.parse_params(_one(spark, text)).first()
    assert r.params_error == f"Invalid params: {error}" and r.param_action is None and r.param_extras is None


@pytest.mark.parametrize("base, event", [
    ({"a": 1, "b": {"x": [1, 2]}}, {"b": None, "c": "t"}), ({}, {"a": 1}), ({"a": 1.5}, {}), ({}, {}),
    ({"id": 1, "region": "r"}, {"id": 2, "k": True})])
def test_merge_is_a_shallow_dict_merge(spark, base, event):
    df = spark.createDataFrame([(json.dumps(base), json.dumps(event))], "b string, e string")
    maps = df.select(F.expr(p.as_map("b")).alias("b"), F.expr(p.as_map("e")).alias("e"))
    got = maps.select(F.expr(p.merge_params("b", "e")).alias("m")).select(F.expr(p.encode_params("m"))).first()[0]
    merged = {**base, **event}
    assert got == (json.dumps(merged, separators=(",", ":")) if merged else None)


def test_repeated_key_keeps_its_last_value(spark):
    got = _one(spark, '{"a":1,"b":2,"a":3}').select(F.expr(p.encode_params(p.as_map("params")))).first()[0]
    assert json.loads(got) == {"a": 3, "b": 2}


@pytest.mark.parametrize("text, handler, job, reason", [
    ('{"handler":"h","params":{"k":1}}', "h", None, None),
    ('{"handler_name":"","handler":"g","job_id":0}', "g", None, None),
    ('{"handler_name":"a","params":null,"job_id":5}', "a", 5, None),
    ('{"handler_name":"a","params":[1]}', "a", None, "params_not_object"),
    ('{"handler_name":"a","params":"{}"}', "a", None, "params_not_object"),
    ('{"handler_name":"a","job_id":"x"}', "a", None, "unknown_job_id"),
    ('{"params":{}}', None, None, "missing_handler"), ("x", None, None, "unparsable"), (None, None, None, "unparsable"),
    ("[1]", None, None, "unparsable")])
def test_triggers(spark, text, handler, job, reason):
    r = p.parse_trigger(_one(spark, text, "value")).first()
    assert (r.handler_name, r.job_id, r.reason) == (handler, job, reason)


def test_results(spark):
    r = p.parse_result(_one(spark, '{"action":"s","count":3,"data":{"x":[1]},"extra":1}', "result")).first()
    assert (r.result_action, r.result_success, r.result_count, r.result_data) == ("s", True, 3, '{"x":[1]}')
    r = p.parse_result(_one(spark, '{"action":"s","success":false,"error":"e"}', "result")).first()
    assert (r.result_success, r.result_error, r.result_data) == (False, "e", None)


def test_handlers_are_isolated(spark):
    registry = h.Registry()
    big = 2 ** 60 + 1

    @registry.handler("ok")
    def ok(params):
        return {"action": params["action"], "id": params["id"], "extra": params.get("x")}

    @registry.handler("db")
    def db(params):
        raise h.DatabaseFailure("lost")

    @registry.handler("odd")
    def odd(params):
        return {"action": object()}

    @registry.handler("slow")
    def slow(params):
        import time
        time.sleep(0.05)

    rows = [(1, "ok", f'{{"id":{big},"x":"é"}}', 60), (2, "db", None, 60), (3, "odd", None, 60), (4, "who", None, 60),
            (5, "ok", "[]", 60), (6, "slow", None, 0)]
    df = spark.createDataFrame(rows, "id long, handler_name string, params string, timeout_seconds int")
    got = {r.id: r for r in h.run_handlers(df, registry).collect()}
    assert got[1].kind == "complete" and json.loads(got[1].result) == {
        "action": "read", "success": True, "id": big, "count": None, "data": None, "error": None, "extra": "é"}
    assert (got[2].kind, got[2].error_message) == ("fail", "Database error: lost")
    assert got[3].kind == "fail" and "serializable" in got[3].error_message
    assert got[4].error_message == "Handler not found: who"
    assert got[5].error_message == "Invalid params: not a JSON object"
    assert got[6].kind == "timeout"
    assert registry.names() == ["db", "odd", "ok", "slow"]


def test_batch_handlers_are_bisected(spark):
    registry = h.Registry()

    @registry.batch_handler("whole")
    def whole(rows):
        if 13 in rows.column("id").to_pylist():
            raise ValueError("13")
        return [{"action": "w", "count": len(rows)}] * len(rows)

    @registry.batch_handler("short")
    def short(rows):
        return []

    @registry.batch_handler("arrow")
    def arrow(rows):
        return pa.array([{"action": "a", "data": v} for v in rows.column("value").to_pylist()])

    @registry.batch_handler("mixed")
    def mixed(rows):
        kinds = [h.PoolExhausted("no"), {"count": 1}, {"action": object()}, None, {"action": "m"}]
        return [kinds[i] for i in rows.column("id").to_pylist()]

    @registry.batch_handler("slow")
    def slow(rows):
        try:
            time.sleep(3600 if 7 in rows.column("id").to_pylist() else 0)
        except Exception:
            raise AssertionError("a handler cannot hold on to its time")
        return [None] * len(rows)

    rows = [(i, "whole", f'{{"id":{i}}}', 9) for i in range(40)] + [(100 + i, "slow", f'{{"id":{i}}}', None if i == 3 else 1) for i in range(10)]
    rows += [(200, "short", None, 9), (201, "short", None, 9), (300, "arrow", '{"value":"é"}', 9), (301, "arrow", None, 9)]
    rows += [(400 + i, "mixed", f'{{"id":{i}}}', 9) for i in range(5)] + [(500, "whole", "[]", 9)]
    df = spark.createDataFrame(rows, "id long, handler_name string, params string, timeout_seconds int").coalesce(1)
    got = {r.id: r for r in h.run_handlers(df, registry).collect()}
    assert len(got) == len(rows) and (got[13].kind, got[13].error_message) == ("fail", "13")
    assert all(got[i].kind == "complete" and json.loads(got[i].result)["action"] == "w" for i in range(40) if i != 13)
    assert [i for i in range(100, 110) if got[i].kind == "timeout"] == [107] and got[106].kind == "complete" and got[106].result is None
    assert {got[i].error_message for i in (200, 201)} == {"0 results for 1 rows"}
    assert [json.loads(got[i].result)["data"] for i in (300, 301)] == ["é", None]
    assert [got[400 + i].kind for i in range(5)] == ["fail", "fail", "fail", "complete", "complete"]
    assert got[400].error_message == "Connection pool exhausted: no" and got[401].error_message == "result without an action"
    assert got[500].error_message == "Invalid params: not a JSON object"
    assert registry.names() == ["arrow", "mixed", "short", "slow", "whole"]


def test_calls_are_ended_in_any_thread():
    def stuck():
        time.sleep(0.2)

    def threaded(box):
        with h.Watchdog() as dog:
            box.extend([dog.signals, dog.within(0.01, stuck), dog.within(5, lambda: 3)])

    with h.Watchdog() as dog:
        assert dog.signals and dog.within(0.01, stuck) == (False, None) and dog.within(5, lambda: 3) == (True, 3)
        with pytest.raises(KeyError):
            dog.within(5, lambda: {}["x"])
    box = []
    thread = threading.Thread(target=threaded, args=(box,))
    thread.start()
    thread.join()
    assert box == [False, (False, None), (True, 3)]
