"""Expanding walk-forward folds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.session import materialise


def make_folds(df: DataFrame, date: str = "game_date", burn_days: int = 400, step_days: int = 45) -> DataFrame:
    """(fold, train_end, test_start, test_end): contiguous test windows after a burn-in, the last one clipped."""
    ends = df.agg(F.min(F.to_date(date)).alias("lo"), F.max(F.to_date(date)).alias("hi"))
    first = F.date_add("lo", burn_days)
    starts = F.when(first <= F.col("hi"), F.sequence(first, F.col("hi"), F.make_interval(days=F.lit(step_days))))
    f = ends.select("hi", F.posexplode(starts).alias("fold", "test_start"))
    return f.select(
        "fold", F.date_sub("test_start", 1).alias("train_end"), "test_start",
        F.least(F.date_add("test_start", step_days - 1), F.col("hi")).alias("test_end"))


def fold_sizes(df: DataFrame, folds: DataFrame, date: str = "game_date") -> DataFrame:
    """Training and test rows of each fold, from counts per date."""
    per_day = df.groupBy(F.to_date(date).alias("d")).agg(F.count("*").alias("n"))
    j = folds.join(per_day, F.col("d") <= F.col("test_end"), "left")
    return j.groupBy(*folds.columns).agg(
        F.coalesce(F.sum(F.when(F.col("d") <= F.col("train_end"), F.col("n"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(F.col("d") >= F.col("test_start"), F.col("n"))), F.lit(0)).alias("test_rows"))


def date_fold(df: DataFrame, k: int, date: str = "game_date", out: str = "oof_fold") -> DataFrame:
    """Adds a fold number in [0, k) such that a date never straddles folds.

    The ranking runs over distinct dates, of which there are as many as days.
    """
    return _with_fold(df, _ranked_days(df, k, date, out), date)


def stored_fold(df: DataFrame, k: int, date: str = "game_date", out: str = "oof_fold") -> DataFrame:
    """``date_fold`` of a stored ``df``: the days are ranked and stored once, and each read of the rows looks its fold up."""
    return _with_fold(df, materialise(_ranked_days(df, k, date, out), "days"), date)


def _ranked_days(df: DataFrame, k: int, date: str, out: str) -> DataFrame:
    days = df.select(F.to_date(date).alias("__d")).distinct()
    return days.withColumn(out, F.pmod(F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("__d")) - 1, F.lit(k)))


def _with_fold(df: DataFrame, ranked: DataFrame, date: str) -> DataFrame:
    return df.withColumn("__d", F.to_date(date)).join(ranked, "__d").drop("__d")
