"""Connected components of a graph given by its edges, without gathering any component."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.session import discard, materialise


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """One round of star contraction over edges (u, v) with v < u: every vertex hands its neighbours to its least one.

    The small star moves the neighbours below a vertex, the large star those above it; both keep the components. The second
    result is the stored table of least neighbours, which can go once the first is stored.
    """
    if small:
        near = edges
        least = materialise(near.groupBy("u").agg(F.min("v").alias("m")), "least")  # stored: a join of two shuffles can split a hub
        moved = near.join(least, "u")
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        moved = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u, v) that is not the least of its component; ids are longs.

    Alternates the two stars until nothing changes, which takes a logarithmic number of rounds in practice.
    Every round is stored, so that lost executors cost one round. Loops and repeated edges do no harm.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    digest = lambda d: d.agg(F.count("*"), *[F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("u", "v"), ("v", "u"))]).first()
    seen = digest(now)
    while True:
        large, first = _star(now, small=False)
        large = materialise(large, "edges")
        small, second = _star(large, small=True)
        after = materialise(small, "edges")
        for done in (now, large, first, second):
            discard(done)
        now, before, seen = after, seen, digest(after)
        if seen == before:
            return now.select("u", F.col("v").alias("root"))
