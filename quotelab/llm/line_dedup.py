"""Removal of boilerplate lines: those that stand on many sites.

Every line has a HyperLogLog sketch of the sites it stands on, merged by aggregation. Sketches that are clearly above or
below the threshold decide at once; lines near it get an exact distinct count. A line with at least ``min_sites`` sites is
boilerplate: its first place (least document id, then position) stays, and all others are removed, so a document that is
copied across sites loses its text in all copies but the first. Lines are told apart by 128-bit hashes of their trimmed text.

Null texts stay null and have no lines; blank lines are kept and never counted; a null site counts as no site. A line in a
document with a null id counts, and is kept only if no document with an id holds it. Rows with the same id and text are
treated alike. Texts shorter or longer need no other care: a line is hashed once, whatever its length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.session import materialise

#: Sites from which on a line is boilerplate.
MIN_SITES = 4
#: Base-2 logarithm of a sketch's buckets: a standard error of 1.04 / 64, under two percent.
LG_BUCKETS = 12
#: Relative distance from the threshold within which the count is made exact: more than six standard errors.
NEAR = 0.1


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that is not blank: doc_id, rid, site, pos and the two halves of the line's hash."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[site_col].cast("string").alias("site"))
    rows = rows.withColumn("rid", _row_hash(F.col("doc_id"), F.col("text")))
    line = F.trim(F.col("line"))
    lines = rows.select("doc_id", "rid", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(line != "").select("doc_id", "rid", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites; ``first`` is the place that stays."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid", "pos")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_BUCKETS).alias("sketch"), F.min(place).alias("first"))
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
    low, high = min(min_sites * (1 - NEAR), min_sites - 1), max(min_sites * (1 + NEAR), min_sites + 1)
    spread = materialise(spread.filter(F.col("sites") >= low), "spread")
    near = spread.filter(F.col("sites") <= high)
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites)
    return spread.filter(F.col("sites") > high).select("h1", "h2", "first").unionByName(
        near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
             site_col: str = "source") -> DataFrame:
    """(doc_id, rid, gone): the positions of the lines to remove, for rows that lose any."""
    lines = _lines(docs, id_col, text_col, site_col)
    common = materialise(boilerplate(lines, min_sites), "boilerplate")
    first = F.col("first")
    stays = (F.col("doc_id").eqNullSafe(first["doc_id"])) & (F.col("rid") == first["rid"]) & (F.col("pos") == first["pos"])
    return lines.join(common, ["h1", "h2"]).filter(~stays).groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("gone"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                     site_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns as a struct), new ``text``, n_lines and n_removed."""
    gone = removals(docs, min_sites, id_col, text_col, site_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"),
                       docs[text_col].alias("text")).withColumn("rid", _row_hash(F.col("doc_id"), F.col("text")))
    gone = gone.select(F.col("doc_id").alias("g_doc"), F.col("rid").alias("g_rid"), "gone")
    both = rows.join(gone, (F.col("rid") == F.col("g_rid")) & F.col("doc_id").eqNullSafe(F.col("g_doc")), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda k: F.get(lines, k))
    return both.select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *[F.when(x.isNull(), 0).otherwise(F.size(x)).cast("long").alias(name) for x, name in ((lines, "n_lines"), (F.col("gone"), "n_removed"))],
    )


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` with the lines removed; every row stays, if only with an empty text."""
    kept = drop_boilerplate(docs, min_sites, text_col=text_col, **columns)
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
