"""Cron grammar: golden fires, errors, and random expressions against a minute-by-minute test."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from schedlake.functions.cron_fields import parse_cron
from schedlake.operators.occurrences import cron_occurrences, due, prev_fire, with_fires

AS_OF = datetime(2024, 1, 15, 9, 0, 30)
D = datetime

GOLDEN = {
    "0 0 29 2 *": [D(2024, 2, 29), D(2028, 2, 29)],
    "0 0 * * 7": [D(2024, 1, 21), D(2024, 1, 28)],
    "0 0 * * FRI-MON": [D(2024, 1, 19), D(2024, 1, 20)],
    "5/20 * * * *": [D(2024, 1, 15, 9, 5), D(2024, 1, 15, 9, 25)],
    "@midnight": [D(2024, 1, 16), D(2024, 1, 17)],
    "@yearly": [D(2025, 1, 1), D(2026, 1, 1)],
    "*/10 * * * * 30": [D(2024, 1, 15, 9, 10, 30), D(2024, 1, 15, 9, 20, 30)],
    "* * * * * *": [D(2024, 1, 15, 9, 0, 31), D(2024, 1, 15, 9, 0, 32)],
    "0 0 L * *": [D(2024, 1, 31), D(2024, 2, 29)],
    "0 0 * * 5#2": [D(2024, 2, 9), D(2024, 3, 8)],
    "0 0 * * L5": [D(2024, 1, 26), D(2024, 2, 23)],
    "0 0 * 2 0#5": [D(2032, 2, 29), D(2060, 2, 29)],
    "0 0 13 * 5": [D(2024, 1, 19), D(2024, 1, 26)],
    "0 9 15 1 *": [D(2025, 1, 15, 9), D(2026, 1, 15, 9)],
    "0 0 31 2 *": [],
    "0 0 30 feb *": [],
}
ERRORS = {
    "60 * * * *": "out_of_range", "* * * *": "field_count", "* * * * * * *": "field_count", "": "field_count",
    "*/0 * * * *": "zero_step", "0 0 * FOO *": "bad_token", "1- * * * *": "bad_token", "*-5 * * * *": "bad_token",
    "1,,2 * * * *": "bad_token", "0 0 0 * *": "out_of_range", "0 0 * 13 *": "out_of_range",
    "0 0 * * 8": "out_of_range", "99999999999 * * * *": "out_of_range", "a b c d e": "bad_token",
}


def _defs(spark, expressions):
    return spark.createDataFrame(list(enumerate(expressions)), "id long, cron_expression string")


def test_golden_next_fires(spark):
    names = list(GOLDEN)
    rows = {r.cron_expression: r.fires for r in with_fires(_defs(spark, names), AS_OF, 2).collect()}
    assert rows == GOLDEN


def test_errors(spark):
    rows = parse_cron(_defs(spark, list(ERRORS))).collect()
    assert {r.cron_expression: r.cron_error for r in rows} == ERRORS
    assert all(r.minutes is None and r.dom_star is None for r in rows)


def test_missing_expression_is_an_error_and_keeps_its_row(spark):
    rows = with_fires(_defs(spark, [None, "0 * * * *"]), AS_OF, 1).orderBy("id").collect()
    assert [(r.cron_error, len(r.fires)) for r in rows] == [("field_count", 0), (None, 1)]


def test_prev_is_strictly_before_and_next_strictly_after(spark):
    at = datetime(2024, 1, 15, 9, 0)
    defs = _defs(spark, ["0 9 * * *", "0 0 29 2 *"])
    assert [r.tick for r in prev_fire(defs, at).orderBy("id").collect()] == [D(2024, 1, 14, 9), D(2020, 2, 29)]
    assert with_fires(defs, at, 1).orderBy("id").first().fires == [D(2024, 1, 16, 9)]


def _random_field(rng, low, high):
    def token():
        a, b = sorted((rng.randint(low, high), rng.randint(low, high)))
        return rng.choice(["*", str(a), f"{a}-{b}", f"*/{rng.randint(1, 9)}", f"{a}-{b}/{rng.randint(1, 5)}",
                           f"{a}/{rng.randint(1, 7)}", f"{b}-{a}"])
    return ",".join(token() for _ in range(rng.choice([1, 1, 2])))


def _values(text, low, high, top):
    """The set of one field, by the book."""
    out = set()
    for tok in text.split(","):
        body, _, step = tok.partition("/")
        if body == "*":
            a, b = low, high
        elif "-" in body:
            a, b = map(int, body.split("-"))
        else:
            a = int(body)
            b = top if step else a
        size = high - low + 1
        if a > b:
            b += size
        out |= {(v - low) % size + low for v in range(a, b + 1, int(step or 1))}
    return out


def _naive(expression, t):
    mi, ho, dom, mon, dow = expression.split()
    doms, dows = _values(dom, 1, 31, 31), _values(dow, 0, 6, 7)
    day = t.day in doms
    week = (t.weekday() + 1) % 7 in dows
    dom_open = dom == "*" or (len(doms) == 31 and "*" in dow)
    dow_open = dow == "*" or (len(dows) == 7 and "*" in dom)
    fits = (day and week) if dom_open or dow_open else (day or week)
    return (t.minute in _values(mi, 0, 59, 59) and t.hour in _values(ho, 0, 23, 23)
            and t.month in _values(mon, 1, 12, 12) and fits)


def test_random_expressions_match_a_minute_by_minute_test(spark):
    rng = random.Random(7)
    names = [" ".join(_random_field(rng, *r) for r in ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)))
             for _ in range(60)]
    names = sorted(set(names))
    # Both ends lie inside an hour, so the cut hours are tested too.
    start, end = datetime(2024, 2, 27, 5, 17, 30), datetime(2024, 3, 3, 11, 41)
    got = {}
    for r in cron_occurrences(_defs(spark, names), start, end).collect():
        got.setdefault(names[r.id], set()).add(r.tick)
    first = datetime(2024, 2, 27, 5, 18)
    minutes = [first + timedelta(minutes=i) for i in range(int((end - first).total_seconds() // 60))]
    for name in names:
        assert got.get(name, set()) == {t for t in minutes if _naive(name, t)}, name


def test_next_and_prev_agree_with_occurrences(spark):
    rng = random.Random(11)
    names = [" ".join(_random_field(rng, *r) for r in ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)))
             for _ in range(25)]
    at = datetime(2024, 6, 15, 12, 30)
    defs = _defs(spark, names)
    ticks = {}
    for r in cron_occurrences(defs, datetime(2024, 6, 1), datetime(2024, 7, 1)).collect():
        ticks.setdefault(r.id, []).append(r.tick)
    for forward in (True, False):
        for r in with_fires(defs, at, 3, forward).collect():
            mine = sorted((t for t in ticks.get(r.id, []) if (t > at if forward else t < at)), reverse=not forward)[:3]
            assert r.fires[:len(mine)] == mine, names[r.id]
            assert len(r.fires) == 3 or not mine


@pytest.mark.parametrize("interval", [60, 600, 7200])
def test_due_window(spark, interval):
    defs = _defs(spark, ["* * * * *", "30 8 * * *", "0 9 * * *", "0 7 * * *"])
    every = {(r.id, r.scheduled_time) for r in due(defs, AS_OF, interval, catch_up=True).collect()}
    last = {(r.id, r.scheduled_time) for r in due(defs, AS_OF, interval).collect()}
    begin = AS_OF - timedelta(seconds=interval)
    minutes = [datetime(2024, 1, 15, 6) + timedelta(minutes=i) for i in range(300)]
    wanted = {(0, t) for t in minutes} | {(1, D(2024, 1, 15, 8, 30)), (2, D(2024, 1, 15, 9)), (3, D(2024, 1, 15, 7))}
    wanted = {(i, t) for i, t in wanted if begin <= t < AS_OF}
    assert every == wanted
    assert last == {(i, max(t for j, t in wanted if j == i)) for i, _ in wanted}




def test_many_fires_equal_few(spark, monkeypatch):
    """Ranks opened in stretches give what one array gives, also past the end of a stretch of stretches."""
    from schedlake.operators import occurrences as o

    defs = _defs(spark, ["*/7 * * * *", "0 0 29 2 *", "30 4 1 1 0 15", "0 0 31 2 *", "x"])
    whole = sorted(map(tuple, o.next_fires(defs, AS_OF, 30).collect()))
    monkeypatch.setattr(o, "RANKS", 3)
    assert sorted(map(tuple, o.next_fires(defs, AS_OF, 30).collect())) == whole
    counted = {r.id: r for r in o.fire_counts(defs, AS_OF, "2024-02-20 00:00:00").collect()}
    ticks = o.cron_occurrences(defs.filter("cron_expression <> 'x'"), AS_OF, "2024-02-20 00:00:00").groupBy("id").agg(
        F.count("*").alias("n"), F.min("tick").alias("first")).collect()
    assert {r.id: (r.fires, r.first_tick) for r in counted.values() if r.fires} == {r.id: (r.n, r.first) for r in ticks}
    assert counted.keys() == {r.id for r in defs.collect()}


def test_opened_fires_leave_their_calendar_behind(spark):
    """Dense fires of one file of definitions come from many tasks, whose rows hold no calendar, and are all there."""
    from schedlake.operators import occurrences as o

    defs = _defs(spark, ["* * * * *", "*/15 * * * *"] * 3).coalesce(1)
    for opened, n in ((o.next_fires(defs, AS_OF, 600), 6 * 600), (due(defs, AS_OF, 86400, catch_up=True), 3 * (1440 + 96))):
        assert opened.count() == n == opened.distinct().count()
        assert opened.rdd.getNumPartitions() >= 8
        plan = opened._jdf.queryExecution().optimizedPlan().toString()
        wide = next(line for line in plan.splitlines() if "Generate posexplode" in line)
        assert "year_days" not in wide
    both = o.next_fires(defs, AS_OF, 300).groupBy("n").agg(F.count("*").alias("c")).collect()
    assert {r.n: r.c for r in both} == dict.fromkeys(range(1, 301), 6)


def test_dense_fires_of_every_dense_definition(spark, tmp_path):
    """No definition that fires every minute or quarter of an hour is left out, whatever its id ends in."""
    import duckdb

    from oracle import compare
    from schedlake.queries import ORACLES, QUERIES
    from schedlake.queries.cron import DENSE

    spark.range(60).selectExpr("id AS s_suppkey", "concat('supplier ', id) AS s_name", "cast(id % 25 AS INT) AS s_nationkey",
                               "cast(id AS DOUBLE) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    fires = QUERIES["next_fires_dense"](spark, str(tmp_path)).persist()
    rows = fires.groupBy("id").agg(
        F.count("*").alias("fires"), F.count_distinct("tick").alias("ticks"), F.max("n").alias("last")).collect()
    ids = [k + 1 for k in range(60) if k % 12 in (0, 9)]
    assert {i % 10 for i in ids} == set(range(10))
    assert sorted(map(tuple, rows)) == [(i, DENSE, DENSE, DENSE) for i in ids]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert compare(spark, con, "next_fires_dense", lambda *_: fires, ORACLES["next_fires_dense"], str(tmp_path)) is None
    fires.unpersist()
