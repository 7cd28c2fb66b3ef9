"""Scores from terms worked out once a block equal those from standardised rows."""
from pyspark.sql import functions as F

from quotelab.operators import model as MD


def test_score_equals_the_formula_on_standardised_rows(spark):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000003)) / 1000003.0
    d = spark.range(1200).select("id", F.concat(F.lit("m|"), (F.col("id") % 2).cast("string")).alias("market"), F.when(u(1) < 0.8, u(2)).alias("x"), F.lit(3).alias("same"), F.lit(None).cast("double").alias("none"),
                                 (u(3) < 0.4).cast("double").alias("won"), (F.col("id") % 3).cast("int").alias("oof_fold"))
    features = ["x", "same", "none"]
    m = MD.fit_blocks(d, features, "won", l2=1e-3)
    want = MD.standardised(d, m.stats, "market", features).withColumn("block", MD.block("market", F.col("oof_fold"))).join(m.coefficients, "block")
    want = {r.id: r.p for r in want.select("id", MD._probability(MD._inputs(features)).alias("p")).collect()}
    scored = m.score(d, "p", F.col("oof_fold"))
    got = {r.id: r.p for r in scored.collect()}
    assert len(got) == 1200 and all(abs(got[i] - want[i]) < 1e-12 for i in want) and len(set(got.values())) > 500
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # one of blocks and scales, one of rows
    unknown = d.withColumn("market", F.lit("new"))
    assert m.score(unknown, "p").isEmpty() and m.score(unknown, "p", how="left").filter("p IS NULL").count() == 1200
