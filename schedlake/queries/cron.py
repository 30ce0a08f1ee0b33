"""Cron parsing, occurrences, fires, due decisions."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.functions.clock import elapsed_seconds, truncate_seconds
from schedlake.functions.cron_fields import parse_cron
from schedlake.operators import occurrences as o
from schedlake.queries.registry import query


def _list(start: int, stop: int, step: int = 1) -> str:
    return f"array_to_string(range({start}, {stop}, {step}), ',')"


@query(with_ctes("definitions", f"""WITH kinds AS (SELECT id, cron_expression, (id - 1) % 12 AS k FROM definitions)
SELECT id, cron_expression,
  CASE WHEN k < 11 THEN '0' END AS seconds,
  CASE k WHEN 0 THEN '0,15,30,45' WHEN 2 THEN '30' WHEN 5 THEN '5,35' WHEN 7 THEN '10'
    WHEN 9 THEN {_list(0, 60)} WHEN 11 THEN NULL ELSE '0' END AS minutes,
  CASE WHEN k IN (0, 1, 9) THEN {_list(0, 24)} WHEN k = 2 THEN '2' WHEN k = 3 THEN '9' WHEN k IN (4, 10) THEN '0'
    WHEN k = 5 THEN '8,10,12,14,16,18' WHEN k = 6 THEN '12' WHEN k = 7 THEN '4' WHEN k = 8 THEN '6' END AS hours,
  CASE k WHEN 4 THEN '1' WHEN 6 THEN '13' WHEN 10 THEN '31' WHEN 11 THEN NULL ELSE {_list(1, 32)} END AS doms,
  CASE k WHEN 7 THEN '1,7' WHEN 8 THEN '1,2,3' WHEN 10 THEN '2' WHEN 11 THEN NULL ELSE {_list(1, 13)} END AS months,
  CASE k WHEN 3 THEN '1,2,3,4,5' WHEN 6 THEN '5' WHEN 8 THEN '0' WHEN 11 THEN NULL ELSE {_list(0, 7)} END AS dows,
  CASE WHEN k < 11 THEN k NOT IN (4, 6, 10) END AS dom_star, CASE WHEN k < 11 THEN k NOT IN (3, 6, 8) END AS dow_star,
  CASE WHEN k = 11 THEN 'field_count' END AS cron_error FROM kinds"""))
def cron_fields(spark, sf):
    parsed = parse_cron(fx.definitions(spark, sf).select("id", "cron_expression"))
    sets = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
            for c in ("seconds", "minutes", "hours", "doms", "months", "dows")]
    return parsed.select("id", "cron_expression", *sets, "dom_star", "dow_star", "cron_error")


@query(with_ctes("ticks", "SELECT id, tick FROM ticks"))
def cron_occurrences(spark, sf):
    return o.cron_occurrences(fx.definitions(spark, sf), fx.RANGE_START, fx.RANGE_END)


@query(with_ctes("ticks", f"SELECT id, max(tick) AS tick FROM ticks WHERE tick < TIMESTAMP '{fx.AS_OF}' GROUP BY id"))
def previous_fires(spark, sf):
    return o.prev_fire(fx.definitions(spark, sf), fx.AS_OF)


@query(with_ctes("wide_ticks", f"""SELECT id, n, tick FROM (SELECT id, tick, CAST(row_number() OVER (
    PARTITION BY id ORDER BY tick) AS INT) AS n FROM wide_ticks WHERE tick > TIMESTAMP '{fx.AS_OF}') WHERE n <= 2"""))
def next_fires(spark, sf):
    return o.next_fires(fx.definitions(spark, sf), fx.AS_OF, 2)


RARE = ["0 0 1 1 *", "0 0 29 2 *", "0 0 * 2 1#5"]
MANY = 80


@query(with_ctes("definitions", f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-16', DATE '9999-12-31',
    INTERVAL 1 DAY)) AS TIMESTAMP) AS tick),
fires AS (SELECT 0 AS k, tick FROM days WHERE month(tick) = 1 AND day(tick) = 1
    UNION ALL SELECT 1, tick FROM days WHERE month(tick) = 2 AND day(tick) = 29
    UNION ALL SELECT 2, tick FROM days WHERE month(tick) = 2 AND day(tick) = 29 AND dayofweek(tick) = 1),
numbered AS (SELECT k, tick, CAST(row_number() OVER (PARTITION BY k ORDER BY tick) AS INT) AS n FROM fires)
SELECT id, n, tick FROM definitions JOIN numbered ON k = id % 3 WHERE n <= {MANY}"""))
def next_fires_many(spark, sf):
    """Fires that lie centuries ahead: yearly, on leap days, and on leap days that are a fifth Monday."""
    rare = F.element_at(F.array(*[F.lit(e) for e in RARE]), (F.col("id") % 3 + 1).cast("int"))
    defs = fx.definitions(spark, sf).withColumn("cron_expression", rare)
    return o.next_fires(defs, fx.AS_OF, MANY)


#: Fires that lie close together, far more of them than a day holds.
DENSE = 10_000


@query(with_ctes("definitions", f"""WITH minutes AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-15 09:01:00', TIMESTAMP '2024-09-01', INTERVAL 1 MINUTE)) AS t),
fires AS (SELECT 0 AS p, t FROM minutes WHERE minute(t) % 15 = 0 UNION ALL SELECT 1, t FROM minutes),
numbered AS (SELECT p, t AS tick, CAST(row_number() OVER (PARTITION BY p ORDER BY t) AS INT) AS n FROM fires)
SELECT id, n, tick FROM definitions JOIN numbered ON p = CASE (id - 1) % 12 WHEN 0 THEN 0 WHEN 9 THEN 1 END
WHERE n <= {DENSE}"""))
def next_fires_dense(spark, sf):
    """Ten thousand fires each of the definitions that fire every minute or quarter of an hour."""
    often = "cron_expression IN ('*/15 * * * *', '* * * * *')"
    return o.next_fires(fx.definitions(spark, sf).filter(often), fx.AS_OF, DENSE)


YEAR_END = "2025-01-15 09:00:30"


@query(with_ctes("definitions", f"""WITH minutes AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-15 09:01:00',
    TIMESTAMP '{YEAR_END}', INTERVAL 1 MINUTE)) AS t),
{fx.CTE["kind_ticks"].replace("SELECT k, t", "year_ticks AS (SELECT k, count(*) AS n, min(t) AS t", 1)} GROUP BY k)
SELECT handler_name, min(t) AS next_tick, CAST(sum(n) AS BIGINT) AS fire_count, count(*) AS job_count
FROM definitions JOIN year_ticks ON k = (id - 1) % 12 WHERE is_enabled GROUP BY handler_name"""))
def upcoming_by_year(spark, sf):
    """The forecast for a year, counted without opening its fires."""
    return o.upcoming(fx.definitions(spark, sf), fx.AS_OF, 366 * 86400, ["handler_name"])


@query(with_ctes("ticks", f"""SELECT id, max(tick) AS scheduled_time FROM ticks WHERE tick < TIMESTAMP '{fx.AS_OF}'
    AND tick >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 60 SECOND GROUP BY id"""))
def due_definitions(spark, sf):
    return o.due(fx.definitions(spark, sf), fx.AS_OF).select("id", "scheduled_time")


@query(with_ctes("ticks", f"""SELECT id, tick AS scheduled_time FROM ticks WHERE tick < TIMESTAMP '{fx.AS_OF}'
    AND tick >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 2 DAY"""))
def due_definitions_catching_up(spark, sf):
    return o.due(fx.definitions(spark, sf), fx.AS_OF, 2 * 86400, catch_up=True).select("id", "scheduled_time")


GAPS = """SELECT id, tick, lead(tick) OVER (PARTITION BY id ORDER BY tick) AS next_tick FROM ticks"""


@query(with_ctes("ticks", f"""SELECT id, tick, next_tick, date_diff('second', tick, next_tick) AS gap_seconds
    FROM ({GAPS})"""))
def fire_gaps(spark, sf):
    return o.fire_gaps(o.cron_occurrences(fx.definitions(spark, sf), fx.RANGE_START, fx.RANGE_END))


@query(with_ctes("ticks", f"""SELECT id, min(date_diff('second', tick, next_tick)) AS min_gap_seconds
    FROM ({GAPS}) WHERE next_tick IS NOT NULL GROUP BY id"""))
def minimum_fire_gaps(spark, sf):
    return o.minimum_gaps(o.cron_occurrences(fx.definitions(spark, sf), fx.RANGE_START, fx.RANGE_END))


@query(with_ctes("ticks", f"""SELECT id, max(tick) AS prev_tick FROM ticks WHERE tick < TIMESTAMP '{fx.AS_OF}'
    GROUP BY id"""))
def previous_fire_of_occurrences(spark, sf):
    ticks = o.cron_occurrences(fx.definitions(spark, sf), fx.RANGE_START, fx.RANGE_END)
    return o.previous_fire(ticks, fx.AS_OF)


@query(with_ctes("executions", """SELECT id, date_trunc('second', created_at) AS created_second,
    CAST(date_diff('microsecond', created_at, finished_at) AS DOUBLE) / 1000000.0 AS total_seconds FROM executions"""))
def execution_clock(spark, sf):
    return fx.executions(spark, sf).select("id", truncate_seconds("created_at").alias("created_second"),
                                           elapsed_seconds("created_at", "finished_at").alias("total_seconds"))


#: Expressions beyond the twelve kinds of the fixture, each with the minutes it fires in and the seconds after them.
GRAMMAR = [
    ("0 0 L * *", "hour(t) = 0 AND minute(t) = 0 AND CAST(t AS DATE) = last_day(t)", 0),
    ("0 9 * * 1#2", "hour(t) = 9 AND minute(t) = 0 AND dayofweek(t) = 1 AND day(t) BETWEEN 8 AND 14", 0),
    ("0 18 * * L5", "hour(t) = 18 AND minute(t) = 0 AND dayofweek(t) = 5 AND day(t) > day(last_day(t)) - 7", 0),
    ("@daily", "hour(t) = 0 AND minute(t) = 0", 0),
    ("0 0 * * FRI-MON", "hour(t) = 0 AND minute(t) = 0 AND dayofweek(t) IN (5, 6, 0, 1)", 0),
    ("5/20 * * * *", "minute(t) IN (5, 25, 45)", 0),
    ("*/10 * * * * 30", "minute(t) % 10 = 0", 30),
    ("0 0 29 2 *", "hour(t) = 0 AND minute(t) = 0 AND month(t) = 2 AND day(t) = 29", 0),
    ("0 0 * * 7", "hour(t) = 0 AND minute(t) = 0 AND dayofweek(t) = 0", 0),
    ("@weekly", "hour(t) = 0 AND minute(t) = 0 AND dayofweek(t) = 0", 0),
    ("0 12 1-7 * 1", "hour(t) = 12 AND minute(t) = 0 AND (day(t) <= 7 OR dayofweek(t) = 1)", 0),
    ("@hourly", "minute(t) = 0", 0),
]
GRAMMAR_RANGE = ("2024-01-20 00:00:00", "2024-03-05 00:00:00")
GRAMMAR_SQL = " UNION ALL ".join(
    f"SELECT {k} AS k, t + INTERVAL {seconds} SECOND AS tick FROM minutes WHERE {test}"
    for k, (_, test, seconds) in enumerate(GRAMMAR))


@query(with_ctes("definitions", f"""WITH minutes AS (SELECT unnest(generate_series(TIMESTAMP '{GRAMMAR_RANGE[0]}',
    TIMESTAMP '{GRAMMAR_RANGE[1]}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t),
fires AS ({GRAMMAR_SQL})
SELECT id, tick FROM definitions JOIN fires ON k = id % {len(GRAMMAR)}"""))
def cron_grammar(spark, sf):
    """Last days, numbered and last weekdays, aliases, wraps, steps with a start, seconds and leap days."""
    chosen = F.element_at(F.array(*[F.lit(e) for e, _, _ in GRAMMAR]), (F.col("id") % len(GRAMMAR) + 1).cast("int"))
    defs = fx.definitions(spark, sf).withColumn("cron_expression", chosen)
    return o.cron_occurrences(defs, *GRAMMAR_RANGE)
