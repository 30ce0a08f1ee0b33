"""Time helpers on TIMESTAMP_NTZ columns (UTC at rest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate(unit: str, col) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ (the built-in returns TIMESTAMP)."""
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def truncate_seconds(col) -> Column:
    return truncate("second", col)


def elapsed_micros(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def elapsed_seconds(start, end) -> Column:
    """Seconds from start to end, with the fraction kept."""
    return elapsed_micros(start, end) / F.lit(1_000_000.0)


def to_display_tz(df: DataFrame, columns: list[str], tz: str = "Asia/Seoul") -> DataFrame:
    """UTC columns shown in the display time zone."""
    return df.withColumns({
        c: F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(c)) for c in columns
    })
