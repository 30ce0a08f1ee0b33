"""Cron fires by arithmetic: how many there are up to an instant, and when the n-th of them is.

A year is of one of 14 kinds, by the weekday it begins with and its length, and an expression's days are the same in all
years of a kind. The calendar repeats after 400 years. So the days of an expression are counted from the year 1 on by
adding up years of their kinds, 20 at a time, and the n-th one is found by the same sums; a day's fires are the product of
its hours, minutes and seconds. Nothing longer than a year's days is held, however far apart fires lie.

All functions give SQL over the columns of ``calendar_plan``.
"""

from __future__ import annotations

from calendar import isleap
from datetime import date, datetime

from pyspark.sql import DataFrame

from schedlake.functions.cron_fields import matches_day

BLOCK, BLOCKS = 20, 20
CYCLE_YEARS = BLOCK * BLOCKS
LAST_INSTANT = datetime(9999, 12, 31, 23, 59, 59)
PLAN_COLUMNS = ["hours", "minutes", "seconds", "year_days", "year_counts", "block_counts", "cycle_days", "per_day"]


def _sample_years() -> list[int]:
    """A year of each kind: twice the weekday of its first day, from Monday on, and one more if it is a leap year."""
    kinds = {2 * date(y, 1, 1).weekday() + isleap(y): y for y in range(2000, 2028)}
    return [kinds[k] for k in range(14)]


def _kind(year: str) -> str:
    days = f"({year} - 1 + ({year} - 1) div 4 - ({year} - 1) div 100 + ({year} - 1) div 400)"
    leap = f"({year} % 4 = 0 AND ({year} % 100 <> 0 OR {year} % 400 = 0))"
    return f"cast(pmod({days}, 7) * 2 + IF({leap}, 1, 0) AS INT)"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def calendar_plan(parsed: DataFrame) -> DataFrame:
    """Parsed expressions with their days in each kind of year and the sums over them."""
    def days(year: int) -> str:
        all_days = f"sequence(date '{year}-01-01', date '{year}-12-31', interval 1 day)"
        return f"transform(filter({all_days}, d -> {matches_day('d')}), d -> dayofyear(d))"

    fields = ["cron_expression", "cron_error", "hours", "minutes", "seconds"]
    out = parsed.selectExpr(*fields, f"array({', '.join(days(y) for y in _sample_years())}) AS year_days")
    out = out.selectExpr(*fields, "year_days", "transform(year_days, y -> size(y)) AS year_counts")
    years = f"sequence(b * {BLOCK} + 1, b * {BLOCK} + {BLOCK})"
    out = out.selectExpr(*fields, "year_days", "year_counts", f"""transform(sequence(0, {BLOCKS - 1}), b ->
        aggregate({years}, 0L, (n, y) -> n + year_counts[{_kind('y')}])) AS block_counts""")
    return out.selectExpr(
        *fields, "year_days", "year_counts", "block_counts", "aggregate(block_counts, 0L, (n, x) -> n + x) AS cycle_days",
        "cast(size(hours) AS BIGINT) * size(minutes) * size(seconds) AS per_day")


def fires_until(instant: str) -> str:
    """SQL count of the fires from the year 1 to an instant, that second included."""
    year, doy = "p.year", "p.doy"
    first = f"({year} - 1) - ({year} - 1) % {BLOCK} + 1"
    before = f"""(({year} - 1) div {CYCLE_YEARS}) * cycle_days
        + aggregate(slice(block_counts, 1, cast((({year} - 1) % {CYCLE_YEARS}) div {BLOCK} AS INT)), 0L, (n, x) -> n + x)
        + IF(({year} - 1) % {BLOCK} = 0, 0L, aggregate(sequence({first}, greatest({first}, {year} - 1)), 0L,
            (n, y) -> n + year_counts[{_kind('y')}]))
        + size(filter(year_days[p.kind], x -> x < {doy}))"""
    today = """size(filter(hours, x -> x < p.h)) * cast(size(minutes) AS BIGINT) * size(seconds)
        + IF(array_contains(hours, p.h), size(filter(minutes, x -> x < p.m)) * cast(size(seconds) AS BIGINT)
            + IF(array_contains(minutes, p.m), size(filter(seconds, x -> x <= p.s)), 0), 0)"""
    parts = f"""named_struct('year', year({instant}), 'doy', dayofyear({instant}), 'kind', {_kind(f'year({instant})')},
        'h', hour({instant}), 'm', minute({instant}), 's', cast(floor(second({instant})) AS INT))"""
    return _let(parts, "p", f"(({before}) * per_day + IF(array_contains(year_days[p.kind], {doy}), {today}, 0))")


def nth_fire(n: str) -> str:
    """SQL of the n-th fire from the year 1 on, counted from 1, which must be there."""
    def take(values: str, count: str, start: str) -> str:
        """The first of some values whose counts add up beyond what is left, and what is left then."""
        return f"""aggregate({values}, {start}, (a, v) -> IF(a.found OR a.rest < {count},
            named_struct('at', a.at, 'rest', a.rest, 'found', true),
            named_struct('at', a.at + 1, 'rest', a.rest - {count}, 'found', false)))"""

    block = take("block_counts", "v", "named_struct('at', 0, 'rest', q.day % cycle_days, 'found', false)")
    year = take(f"sequence(c.at * {BLOCK} + 1, c.at * {BLOCK} + {BLOCK})", f"year_counts[{_kind('v')}]",
                f"named_struct('at', c.at * {BLOCK} + 1, 'rest', c.rest, 'found', false)")
    day = f"date_add(make_date(cast((q.day div cycle_days) * {CYCLE_YEARS} + y.at AS INT), 1, 1), year_days[{_kind('y.at')}][cast(y.rest AS INT)] - 1)"
    time = """make_dt_interval(0, hours[cast(q.time div (cast(size(minutes) AS BIGINT) * size(seconds)) AS INT)],
        minutes[cast((q.time div size(seconds)) % size(minutes) AS INT)], seconds[cast(q.time % size(seconds) AS INT)])"""
    found = _let(block, "c", _let(year, "y", f"cast({day} AS timestamp_ntz) + {time}"))
    return _let(f"named_struct('day', ({n} - 1) div per_day, 'time', ({n} - 1) % per_day)", "q", found)


def literal(instant: datetime) -> str:
    return f"timestamp_ntz '{instant}'"
