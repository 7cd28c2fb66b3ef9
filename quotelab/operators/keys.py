"""Joins and deduplication on keys that may be null.

A moneyline quote has no line, yet its null line is part of its key, so keys compare with ``<=>``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROPOSITION = ("event_id", "market", "subject", "line")
NULLABLE = ("line",)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left", nullable=NULLABLE) -> DataFrame:
    """Equi-join that also matches null with null on the nullable keys; keeps the left copy of the keys.

    Only keys that can be null pay for ``<=>``; all stay hash or sort-merge join keys.
    """
    renamed = right.select([F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    tests = [left[c].eqNullSafe(renamed[f"__{c}"]) if c in nullable else left[c] == renamed[f"__{c}"] for c in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, tests), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{c}" for c in keys])


def first_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """The first row per key under a total order.

    Spark limits each map task to one row per key before the shuffle (window group limit), so a hot key
    sends one row per task and not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
