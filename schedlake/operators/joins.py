"""Joins that stay even when many rows have no key.

No join here carries a broadcast hint: Spark broadcasts a side below its size threshold (by file sizes, or by
the measured size of a finished stage) and otherwise shuffles, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_SPREAD = 512


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str,
                spread_by: list[str]) -> DataFrame:
    """Equi-join for ``left``/``left_anti`` where rows without a key match nothing.

    In a shuffle all NULL keys would meet in one task, so they get a second key from ``spread_by``.
    """
    slot = F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SPREAD))
    spread = left.withColumn("_slot", F.when(F.col(left_key).isNull(), slot).otherwise(F.lit(0)))
    # Always 0, but not a constant to the optimizer, which would fold the second key away.
    keyed = right.withColumn("_zero", F.pmod(F.xxhash64(right_key), F.lit(1)))
    on: Column = (F.col(left_key) == F.col(right_key)) & (F.col("_slot") == F.col("_zero"))
    joined = spread.join(keyed, on, how)
    return joined.drop("_slot", "_zero")


def missing(keys: DataFrame, df: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``keys`` that ``df`` does not hold.

    The (usually far larger) table is first reduced to the wanted keys, so that a small key set is
    broadcast against it instead of the table being shuffled.
    """
    names = [on] if isinstance(on, str) else on
    found = df.select(*names).join(keys.select(*names).distinct(), names, "left_semi").distinct()
    return keys.join(found, names, "left_anti")
