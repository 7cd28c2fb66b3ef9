"""Ordered computations that stay parallel when one group holds much of the data.

A window over a group puts the whole group into one task. The functions here cut a group into chunks that
follow its order, summarise the chunks with partial aggregation, and carry only the summaries across them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.session import materialise


def ordered_rank(
    df: DataFrame,
    groups: list[str],
    value: Column,
    tie: list[str],
    rank: str = "rank",
    total: str = "group_rows",
) -> DataFrame:
    """Row number (from 1) within ``groups`` by (value, tie), and the size of the group.

    The rows are dealt by ranges of (groups, value, tie), so that a group, or one value in it, that holds a third of
    all rows still spreads over many tasks. Rows are numbered as they are stored, in order within a range; the ranges' counts,
    at most one per group and range, give the offsets. ``tie`` makes the order total; columns of any type that sorts will do.
    """
    order = [*[F.col(c) for c in groups], F.col("__v"), *[F.col(c) for c in tie]]
    d = df.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    d = materialise(d.drop("__v").withColumn("__at", F.monotonically_increasing_id()), "ranges")  # the range in the upper bits, then the row in it
    # Structs are equal where both have a null, and one key needs one shuffle.
    d = d.withColumn("__cell", F.struct(*groups, F.shiftright("__at", 33).alias("__range")))
    cells = d.groupBy("__cell").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = [F.col(f"__cell.{c}") for c in groups]
    before = Window.partitionBy(*group).orderBy("__cell.__range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "__cell",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
        F.sum("__n").over(Window.partitionBy(*group)).alias(total),
    )
    return d.join(cells, "__cell").select(*df.columns, (F.col("__at") + F.col("__shift")).alias(rank), total)


def running_totals(df: DataFrame, groups: list[str], value: str, bin: Column, sums: list[str]) -> DataFrame:
    """One row per (groups, value) with the sums of its rows and, as ``<sum>_below``, those of smaller values.

    Equal values collapse in the partial aggregation; prefix sums run inside bins and over bin totals.
    """
    v = df.groupBy(*groups, value).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("__bin", bin)
    bins = v.groupBy(*groups, "__bin").agg(*[F.sum(c).alias(f"__b_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *groups, "__bin", *[F.coalesce(F.sum(f"__b_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums]
    )
    within = Window.partitionBy(*groups, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return v.join(bins, [*groups, "__bin"]).select(
        *groups,
        value,
        *sums,
        *[(F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_below") for c in sums],
    )


def quantile_bin(df: DataFrame, groups: list[str], value: str, n_bins: int = 64) -> DataFrame:
    """Adds ``__w``: how many of the group's ``n_bins - 1`` splitters lie at or below ``value``.

    The splitters are approximate quantiles of the rows, from sketches that merge across tasks, so bins hold about the
    same number of rows however heavy the tail is. Values in a higher bin are larger; equal ones share a bin.
    """
    probs = [i / n_bins for i in range(1, n_bins)]
    ends = df.groupBy(*groups).agg(F.array_distinct(F.percentile_approx(value, probs, 50 * n_bins)).alias("__splits"))
    below = F.size(F.filter(F.coalesce("__splits", F.array().cast(ends.schema["__splits"].dataType)), lambda s: s <= F.col(value)))
    return df.join(ends, groups).withColumn("__w", below).drop("__splits")


def quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], n_bins: int = 64) -> DataFrame:
    """Exact interpolated quantiles per group: one row per (groups, i) with the i-th of ``probs`` as ``q``.

    Counts per bin locate the order statistics; only the bins that hold one are looked into. Nothing grows with
    the group except the counts of distinct values inside those bins.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    ranked = quantile_bin(counts, groups, value, n_bins)
    bins = ranked.groupBy(*groups, "__w").agg(F.sum("n").alias("bn"))
    upto = Window.partitionBy(*groups).orderBy("__w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.select(
        *groups, "__w", "bn", (F.sum("bn").over(upto) - F.col("bn")).alias("off"),
        F.sum("bn").over(Window.partitionBy(*groups)).alias("total"),
    )
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    h = (F.col("total") - 1) * F.col("t.p")
    wanted = (
        bins.select(*groups, "__w", "off", "bn", "total", F.explode(targets).alias("t"))
        .select(*groups, "__w", "off", "bn", F.col("t.i").alias("i"), F.floor(h).alias("k"), (h - F.floor(h)).alias("frac"))
        .filter((F.col("k") + 1 >= F.col("off")) & (F.col("k") < F.col("off") + F.col("bn")))
    )
    within = Window.partitionBy(*groups, "__w").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranked.join(bins.select(*groups, "__w", F.col("off").alias("o")).join(
        wanted.select(*groups, "__w").distinct(), [*groups, "__w"], "left_semi"), [*groups, "__w"])
    inside = inside.withColumn("hi", F.col("o") + F.sum("n").over(within)).withColumn("lo", F.col("hi") - F.col("n"))
    hits = wanted.join(inside, [*groups, "__w"])
    at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col(value)))
    k = F.col("k")
    return (
        hits.groupBy(*groups, "i")
        .agg(at(k).alias("a"), at(k + 1).alias("b"), F.max("frac").alias("frac"))
        .select(*groups, "i", (F.col("a") + F.col("frac") * (F.coalesce("b", "a") - F.col("a"))).alias("q"))
    )
