"""Cron occurrences: ticks in a range, previous and next fires, due decisions, gaps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.calendar import LAST_INSTANT, PLAN_COLUMNS, calendar_plan, fires_until, literal, nth_fire
from schedlake.functions.cron_fields import matches_day, per_expression
from schedlake.schemas import DEFAULT_POLL_INTERVAL_SECONDS, ntz

#: Ranks that one array holds when a range of them is opened; longer ranges are opened in two steps.
RANKS = 256


def _instant(value) -> datetime:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def _days(first: str, last: str, step: int = 1) -> str:
    """SQL array of the dates between two SQL dates that fit the row's day fields."""
    return f"filter(sequence({first}, {last}, interval {step} day), d -> {matches_day('d')})"


def cron_occurrences(defs: DataFrame, start, end, minutes: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Every tick in ``[start, end)`` as ``(id, tick)``.

    Days are filtered, once per distinct expression, before any time of day is produced. The (id, day)
    rows are spread over the cluster before the wide explodes, so a dense expression or one that many
    definitions share does not sit in one task. With ``minutes``, a column ``minute`` of distinct minutes, only
    ticks within these are produced; the others are left out before they are opened. With ``days``, rows ``id, day``,
    only those of these days.
    """
    start, end = _instant(start), _instant(end)
    last_day = max(start, end - timedelta(microseconds=1)).date()
    lo, hi = f"timestamp_ntz '{start}'", f"timestamp_ntz '{end}'"
    planned = per_expression(defs.select("id", "cron_expression"), lambda parsed: parsed.selectExpr(
        "cron_expression",
        f"{_days(f"date '{start.date()}'", f"date '{last_day}'")} AS _days",
        "transform(hours, h -> make_dt_interval(0, h, 0, 0)) AS _hours",
        "flatten(transform(minutes, m -> transform(seconds, s -> make_dt_interval(0, 0, m, s)))) AS _offsets"))
    per_day = planned.select("id", "_hours", "_offsets", F.explode("_days").alias("_day"))
    if days is not None:
        per_day = per_day.join(days.select("id", F.col("day").alias("_day")), ["id", "_day"], "left_semi")
    per_day = per_day.repartition("id", "_day")
    hours = per_day.selectExpr("id", "_offsets", "_day", "explode(_hours) AS _h").selectExpr(
        "id", "_offsets", "cast(_day AS timestamp_ntz) + _h AS _hour")
    hours = hours.filter(f"_hour < {hi} AND _hour > {lo} - interval 1 hour")
    if minutes is not None:
        wanted = minutes.groupBy(F.date_trunc("hour", "minute").cast("timestamp_ntz").alias("_wanted")).agg(
            F.collect_set(F.minute("minute")).alias("_minutes"))  # at most 60 an hour
        hours = hours.join(wanted, F.col("_hour") == F.col("_wanted")).selectExpr(
            "id", "_hour", "filter(_offsets, o -> array_contains(_minutes, extract(MINUTE FROM o))) AS _offsets")
    if any(t.minute or t.second or t.microsecond for t in (start, end)):
        # Only the hours that the range cuts test each tick. A lambda would take the explode out of generated
        # code, so it stays in a projection of its own.
        hours = hours.selectExpr("id", "_hour", f"""IF(_hour >= {lo} AND _hour <= {hi} - interval 1 hour, _offsets,
            filter(_offsets, o -> _hour + o >= {lo} AND _hour + o < {hi})) AS _offsets""")
    return hours.selectExpr("id", "_hour", "explode(_offsets) AS _o").selectExpr("id", "_hour + _o AS tick")


def day_digests(defs: DataFrame, start, end) -> DataFrame:
    """``id, day, n, digest``: how many ticks a definition has on each whole day that begins in ``[start, end)``, and their
    combined hash. Both are the same on all its days, so they are worked out once per distinct expression."""
    start, end = _instant(start), _instant(end)
    digest = f"""aggregate(hours, 0L, (a, h) -> a ^ aggregate(minutes, 0L, (b, m) -> b ^ aggregate(seconds, 0L,
        (c, s) -> c ^ {time_hash('(h * 3600 + m * 60 + s) * 1000000L')})))"""
    planned = per_expression(defs.select("id", "cron_expression"), lambda parsed: parsed.selectExpr(
        "cron_expression", f"{_days(f"date '{start.date()}'", f"date '{max(start, _just_before(end)).date()}'")} AS _days",
        "cast(size(hours) AS BIGINT) * size(minutes) * size(seconds) AS n", f"{digest} AS digest"))
    return planned.select("id", F.explode("_days").alias("day"), "n", "digest")


def time_hash(micros: str) -> str:
    """SQL hash of a time of day."""
    return f"xxhash64(cast({micros} AS BIGINT))"


def _ranks(instants: dict[str, datetime], defs: DataFrame, plan_columns: list[str] = PLAN_COLUMNS) -> DataFrame:
    """Definitions with columns of ``calendar_plan`` and the number of fires until each instant, counted once per
    distinct expression. Rows that cannot be read, or never fire, have zeros."""
    def count(parsed: DataFrame) -> DataFrame:
        plan = calendar_plan(parsed)
        alive = "cron_error IS NULL AND cycle_days > 0"
        counts = [f"CASE WHEN {alive} THEN {fires_until(literal(t))} ELSE 0L END AS {name}" for name, t in instants.items()]
        return plan.selectExpr("cron_expression", "cron_error", *plan_columns, *counts)

    return per_expression(defs, count)


def _just_before(instant: datetime) -> datetime:
    return instant - timedelta(microseconds=1)


def _stretches(ranges: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``_expression, _first, _last`` and the first rank ``_begin`` of each stretch of ``RANKS`` of a range."""
    names = [*keep, "_expression", "_first", "_last"]
    far = ranges.selectExpr(*names, f"explode(sequence(0L, (_last - _first) div {RANKS * RANKS})) AS _far")
    return far.selectExpr(*names, f"""explode(sequence(_first + _far * {RANKS * RANKS},
        least(_last, _first + (_far + 1) * {RANKS * RANKS} - 1), {RANKS}L)) AS _begin""")


def _opened(ranked: DataFrame, first: str, last: str, keep: list[str]) -> DataFrame:
    """``keep``, ``rank`` and ``tick`` for the fires of the ranks ``first`` to ``last``, two SQL columns.

    A range is opened in stretches of ``RANKS``, so no array grows with it. The ticks of a stretch are worked out once per
    distinct expression and range; the definitions take them over, and the (definition, stretch) rows, which carry no
    calendar, are spread over a fixed number of tasks before the wide explode: a quarter of those of a shuffle.
    """
    some = ranked.filter(f"{last} >= {first}").selectExpr(
        *[f"`{c}`" for c in keep], "cron_expression AS _expression", f"{first} AS _first", f"{last} AS _last")
    asked = _stretches(some.select("_expression", "_first", "_last").distinct(), [])
    asked = asked.withColumnRenamed("_expression", "cron_expression").repartition("cron_expression", "_begin")
    ticks = per_expression(asked, calendar_plan).selectExpr(
        "cron_expression AS _expression", "_first", "_last", "_begin",
        f"transform(sequence(_begin, least(_last, _begin + {RANKS - 1})), r -> {nth_fire('r')}) AS _ticks")
    tasks = max(8, int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    held = _stretches(some, [f"`{c}`" for c in keep]).join(ticks, ["_expression", "_first", "_last", "_begin"]).select(
        *[f"`{c}`" for c in keep], "_begin", "_ticks").repartition(tasks, f"`{keep[0]}`", "_begin")
    return held.select(*[f"`{c}`" for c in keep], "_begin", F.posexplode("_ticks").alias("_i", "tick")).select(
        *[f"`{c}`" for c in keep], (F.col("_begin") + F.col("_i")).alias("rank"), "tick")


def with_fires(defs: DataFrame, as_of, n: int = 2, forward: bool = True, window_seconds: int | None = None) -> DataFrame:
    """Definitions with ``cron_error`` and an array ``fires``: up to n ticks strictly after ``as_of``
    (strictly before it with ``forward=False``), nearest first; n is small, ``next_fires`` takes any.

    With ``window_seconds`` also ``latest``, the last tick in the window before ``as_of``, and ``window_first`` and
    ``window_last``, the ranks of all of them.
    """
    now = _instant(as_of)
    instants = {"_last": LAST_INSTANT, "_now": now if forward else _just_before(now), "window_last": _just_before(now)}
    if window_seconds is not None:
        instants["_window"] = _just_before(now - timedelta(seconds=window_seconds))

    def fires(parsed: DataFrame) -> DataFrame:
        plan = calendar_plan(parsed)
        alive = "cron_error IS NULL AND cycle_days > 0"
        out = plan.selectExpr("*", *[
            f"CASE WHEN {alive} THEN {fires_until(literal(t))} ELSE 0L END AS {name}" for name, t in instants.items()])
        ranks = (f"filter(sequence(_now + 1, _now + {n}), r -> r <= _last)" if forward
                 else f"filter(sequence(_now, _now - {n - 1}), r -> r >= 1)")
        columns = [f"transform({ranks}, r -> {nth_fire('r')}) AS fires"]
        if window_seconds is not None:
            columns += ["_window + 1 AS window_first", "window_last",
                        f"CASE WHEN window_last > _window THEN {nth_fire('window_last')} END AS latest"]
        return out.selectExpr("cron_expression", "cron_error", *columns)

    return per_expression(defs, fires)


def next_fires(defs: DataFrame, as_of, n: int = 2) -> DataFrame:
    """The n ticks strictly after ``as_of`` as ``(id, n, tick)``; fewer only where the year 9999 ends the calendar."""
    rows = defs.select("id", "cron_expression")
    if n <= RANKS:  # few enough for an array, which is made once per distinct expression
        return with_fires(rows, as_of, n).select("id", F.posexplode("fires").alias("_i", "tick")).select(
            "id", (F.col("_i") + 1).alias("n"), "tick")
    ranked = _ranks({"_now": _instant(as_of), "_end": LAST_INSTANT}, rows, [])
    ticks = _opened(ranked, "_now + 1", f"least(_end, _now + {n})", ["id", "_now"])
    return ticks.selectExpr("id", "cast(rank - _now AS INT) AS n", "tick")


def prev_fire(defs: DataFrame, as_of) -> DataFrame:
    """The latest tick strictly before ``as_of`` as ``(id, tick)``; rows that never fired are absent."""
    return with_fires(defs.select("id", "cron_expression"), as_of, 1, forward=False).select(
        "id", F.explode("fires").alias("tick"))


def fire_counts(defs: DataFrame, start, end) -> DataFrame:
    """Definitions with the number of their ticks in ``[start, end)`` as ``fires`` and the first of them as
    ``first_tick``, counted without opening any."""
    instants = {"_before": _just_before(_instant(start)), "_last": _just_before(_instant(end))}
    ranked = _ranks(instants, defs)
    return ranked.selectExpr(*[f"`{c}`" for c in defs.columns], "_last - _before AS fires",
                             f"CASE WHEN _last > _before THEN {nth_fire('_before + 1')} END AS first_tick")


def due(defs: DataFrame, as_of, poll_interval: int = DEFAULT_POLL_INTERVAL_SECONDS,
        catch_up: bool = False) -> DataFrame:
    """Definitions due at ``as_of`` with their ``scheduled_time``.

    The latest tick within the poll interval, or with ``catch_up`` every tick in it.
    """
    return due_of(with_fires(defs, as_of, 1, window_seconds=poll_interval), defs.columns, catch_up)


def due_of(searched: DataFrame, columns: list[str], catch_up: bool = False) -> DataFrame:
    """``due`` for definitions that ``with_fires`` has searched with a window."""
    if catch_up:
        return _opened(searched, "window_first", "window_last", columns).drop("rank").withColumnRenamed("tick", "scheduled_time")
    return searched.filter("latest IS NOT NULL").select(*columns, F.col("latest").alias("scheduled_time"))


def fire_gaps(occurrences: DataFrame) -> DataFrame:
    """Each tick with the next tick of the same definition and the seconds between them."""
    w = Window.partitionBy("id").orderBy("tick")
    out = occurrences.withColumn("next_tick", F.lead("tick").over(w))
    return out.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("tick"), F.col("next_tick")))


def minimum_gaps(occurrences: DataFrame) -> DataFrame:
    """The true smallest gap per definition over the horizon of ``occurrences``."""
    return fire_gaps(occurrences).filter("gap_seconds IS NOT NULL").groupBy("id").agg(
        F.min("gap_seconds").alias("min_gap_seconds"))


def previous_fire(occurrences: DataFrame, as_of) -> DataFrame:
    """Latest tick before ``as_of`` per definition, taken from given occurrences."""
    return occurrences.filter(F.col("tick") < ntz(as_of)).groupBy("id").agg(F.max("tick").alias("prev_tick"))


def upcoming(defs: DataFrame, as_of, horizon_seconds: int, keys: list[str]) -> DataFrame:
    """Forecast per group: enabled definitions' earliest next fire and number of fires in the horizon.

    Fires are counted, not opened, so the horizon may be any.
    """
    start = _instant(as_of) + timedelta(microseconds=1)
    counted = fire_counts(defs.filter("is_enabled"), start, start + timedelta(seconds=horizon_seconds))
    return counted.filter("fires > 0").groupBy(*keys).agg(
        F.min("first_tick").alias("next_tick"), F.sum("fires").alias("fire_count"),
        F.count("*").alias("job_count"))
