"""Cron expressions as native columns: parsing, day match, instant match.

The expressions are SQL text: one parse on the JVM side instead of hundreds of Column calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The cron grammar.
ALIASES = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
# End of fixed values.

LAST_DAY = 0  # marks "L" within ``doms``


@dataclass(frozen=True)
class Field:
    """One cron field: value range and the greatest number a token may hold (7 is Sunday too)."""

    column: str
    low: int
    high: int
    top: int


SECOND = Field("seconds", 0, 59, 59)
MINUTE = Field("minutes", 0, 59, 59)
HOUR = Field("hours", 0, 23, 23)
DOM = Field("doms", 1, 31, 31)
MONTH = Field("months", 1, 12, 12)
DOW = Field("dows", 0, 6, 7)
FIELDS = [SECOND, MINUTE, HOUR, DOM, MONTH, DOW]

PARSED_COLUMNS = ["seconds", "minutes", "hours", "doms", "months", "dows", "nth_dows",
                  "dom_star", "dow_star", "cron_error"]

_PLAIN = r"'^(\\*|\\d+)(-\\d+)?(/\\d+)?$'"
_STAR_RANGE = r"'^\\*-'"
_NTH = r"'^([0-7]#[1-5]|l[0-7])$'"


def _spelled(text: str, names: list[str], first: int) -> str:
    """SQL that swaps month or weekday names for numbers, only where letters occur."""
    out = text
    for offset, name in enumerate(names):
        out = f"replace({out}, '{name}', '{first + offset}')"
    return f"CASE WHEN {text} RLIKE '[a-z][a-z][a-z]' THEN {out} ELSE {text} END"


# Token text -> struct(start, end, step, error) for ``*``, ``a``, ``a-b``, each with an optional ``/n``;
# then the set of values, where a range that runs backwards wraps past the end of the field.
_SPLIT_TOKENS = f"""transform(_fields, f -> named_struct('low', f.low, 'top', f.top, 'span', f.high - f.low + 1,
    'tokens', transform(filter(split(f.text, ','), t -> NOT f.special OR t <> ''), t -> named_struct(
        'ok', t RLIKE {_PLAIN} AND NOT t RLIKE {_STAR_RANGE},
        'star', startswith(t, '*'),
        'a', try_cast(regexp_extract(t, {_PLAIN}, 1) AS INT),
        'b', substring(regexp_extract(t, {_PLAIN}, 2), 2),
        'n', substring(regexp_extract(t, {_PLAIN}, 3), 2)))))"""
_RESOLVE_TOKENS = """transform(_split, f -> named_struct('low', f.low, 'top', f.top, 'span', f.span,
    'tokens', transform(f.tokens, p -> named_struct(
        'ok', p.ok,
        'start', CASE WHEN p.star THEN f.low ELSE p.a END,
        'end', CASE WHEN p.star THEN f.top WHEN p.b <> '' THEN try_cast(p.b AS INT)
                    WHEN p.n <> '' THEN f.top ELSE p.a END,
        'step', CASE WHEN p.n = '' THEN 1 ELSE try_cast(p.n AS INT) END))))"""
_CHECK_TOKENS = """transform(_resolved, f -> named_struct('low', f.low, 'span', f.span,
    'tokens', transform(f.tokens, p -> named_struct('start', p.start, 'end', p.end, 'step', p.step,
        'error', CASE WHEN NOT p.ok THEN 'bad_token'
            WHEN p.step IS NULL OR NOT coalesce(p.start BETWEEN f.low AND f.top AND p.end BETWEEN f.low AND f.top,
                                                false) THEN 'out_of_range'
            WHEN p.step = 0 THEN 'zero_step' END))))"""
_VALUES = """transform(_checked, f -> array_sort(array_distinct(transform(
    flatten(transform(f.tokens, p -> sequence(p.start, IF(p.start > p.end, p.end + f.span, p.end), p.step))),
    v -> pmod(v - f.low, f.span) + f.low))))"""


def parse_cron(defs: DataFrame, column: str = "cron_expression") -> DataFrame:
    """Adds the six integer sets of each expression plus ``nth_dows``, the star flags and ``cron_error``.

    Fields: ``minute hour dom month dow [second]``. ``doms`` holds 0 for ``L``; ``nth_dows`` holds
    ``weekday * 10 + n`` for ``weekday#n`` and ``weekday * 10`` for the last such weekday.
    """
    kept = [c for c in defs.columns if c not in PARSED_COLUMNS]
    text = f"lower(trim(`{column}`))"
    aliases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())
    names = [f"`{c}`" for c in kept]
    out = defs.selectExpr(*names, rf"split(CASE {text} {aliases} ELSE {text} END, '\\s+') AS _parts")

    def part(i: int) -> str:
        return f"coalesce(try_element_at(_parts, {i + 1}), '0')"

    out = out.selectExpr(
        *names, "coalesce(size(_parts) IN (5, 6), false) AS _counted",
        f"{part(0)} AS _minutes", f"{part(1)} AS _hours", f"{part(5)} AS _seconds",
        f"replace({part(2)}, '?', '*') AS _doms",
        f"{_spelled(part(3), MONTHS, 1)} AS _months",
        f"replace({_spelled(part(4), WEEKDAYS, 0)}, '?', '*') AS _dows")
    # Special tokens leave their own trace and are taken out before the plain grammar.
    plain = {SECOND: "_seconds", MINUTE: "_minutes", HOUR: "_hours", MONTH: "_months",
             DOM: "array_join(filter(split(_doms, ','), t -> t <> 'l'), ',')",
             DOW: f"array_join(filter(split(_dows, ','), t -> NOT t RLIKE {_NTH}), ',')"}
    special = {DOM: "array_contains(split(_doms, ','), 'l')", DOW: f"exists(split(_dows, ','), t -> t RLIKE {_NTH})"}
    fields = ", ".join(
        f"named_struct('text', {plain[f]}, 'low', {f.low}, 'high', {f.high}, 'top', {f.top}, "
        f"'special', {special.get(f, 'false')})" for f in FIELDS)
    nth = f"""array_sort(array_distinct(transform(filter(split(_dows, ','), t -> t RLIKE {_NTH}), t ->
        IF(startswith(t, 'l'), pmod(cast(substring(t, 2, 1) AS INT), 7) * 10,
           pmod(cast(substring(t, 1, 1) AS INT), 7) * 10 + cast(substring(t, 3, 1) AS INT)))))"""
    carried = [*names, "_counted", "_doms", "_dows"]
    out = out.selectExpr(*carried, f"{nth} AS _nth", f"array({fields}) AS _fields")
    carried.append("_nth")
    out = out.selectExpr(*carried, f"{_SPLIT_TOKENS} AS _split")
    out = out.selectExpr(*carried, f"{_RESOLVE_TOKENS} AS _resolved")
    out = out.selectExpr(*carried, f"{_CHECK_TOKENS} AS _checked")
    out = out.selectExpr(*carried, "_checked", """CASE WHEN NOT _counted THEN 'field_count' ELSE try_element_at(
        filter(flatten(transform(_checked, f -> f.tokens.error)), e -> e IS NOT NULL), 1) END AS cron_error""")
    out = out.selectExpr(*carried, "cron_error", f"CASE WHEN cron_error IS NULL THEN {_VALUES} END AS _values")
    # A day field is open when it is "*", or covers everything next to an open one.
    return out.selectExpr(
        *names, "_values[0] AS seconds", "_values[1] AS minutes", "_values[2] AS hours",
        f"""CASE WHEN cron_error IS NULL THEN IF(array_contains(split(_doms, ','), 'l'),
            concat(array({LAST_DAY}), _values[3]), _values[3]) END AS doms""",
        "_values[4] AS months", "_values[5] AS dows", "IF(cron_error IS NULL, _nth, NULL) AS nth_dows",
        "IF(cron_error IS NULL, _doms = '*' OR (size(_values[3]) = 31 AND contains(_dows, '*')), NULL) AS dom_star",
        "IF(cron_error IS NULL, _dows = '*' OR (size(_values[5]) = 7 AND contains(_doms, '*')), NULL) AS dow_star",
        "cron_error")


def _once(df: DataFrame) -> DataFrame:
    """One row per expression behind an aggregate, so that later filters do not re-evaluate its columns."""
    values = [F.any_value(c).alias(c) for c in df.columns if c != "cron_expression"]
    return df.groupBy("cron_expression").agg(*values)


def per_expression(defs: DataFrame, compute=None) -> DataFrame:
    """Joins cron columns to definitions, worked out once per distinct expression.

    Many definitions share an expression, so parsing and calendar search run on the distinct ones. The
    join carries no hint: Spark broadcasts the result below its size threshold and otherwise shuffles,
    where adaptive execution splits an expression that many definitions share.
    """
    parsed = _once(parse_cron(defs.select("cron_expression").distinct()))
    found = _once(compute(parsed)) if compute else parsed
    right = found.withColumnRenamed("cron_expression", "_expression")
    return defs.join(right, F.col("cron_expression").eqNullSafe(F.col("_expression")), "left").drop("_expression")


def matches_day(day: str) -> str:
    """SQL test whether a date fits the parsed day fields of its row.

    With both day fields restricted a date fits on either of them, otherwise on both.
    """
    dom = f"(array_contains(doms, day({day})) OR (doms[0] = {LAST_DAY} AND {day} = last_day({day})))"
    dow = f"""(array_contains(dows, dayofweek({day}) - 1) OR (size(nth_dows) > 0 AND (
        array_contains(nth_dows, (dayofweek({day}) - 1) * 10 + (day({day}) + 6) div 7)
        OR (array_contains(nth_dows, (dayofweek({day}) - 1) * 10) AND date_add({day}, 7) > last_day({day})))))"""
    return f"""(array_contains(months, month({day})) AND IF(dom_star OR dow_star, {dom} AND {dow}, {dom} OR {dow}))"""
