"""Known-truth checks of model, correction and walk-forward."""
import pytest
from pyspark.sql import functions as F

from catalog.adapters import TEST_BOOKS
from quotelab.functions import pricing as P
from quotelab.operators import model as MD
from quotelab.operators import selection as SE
from quotelab.plans import walk as W

FEATURES = ["noise", "signal"]


def u(*salt):
    return F.pmod(F.xxhash64("id", *[F.lit(s) for s in salt]), F.lit(1000003)) / 1000003.0


@pytest.fixture(scope="module")
def props(spark):
    """Market a is efficient; in market b the price misses a signal."""
    d = spark.range(20000).withColumns({"market": F.when(F.col("id") % 2 == 0, "a").otherwise("b"), "p_cons": 0.3 + 0.4 * u(1), "noise": u(2), "signal": F.when(u(3) < 0.9, u(4) - 0.5)})
    p = P.expit(P.logit(F.col("p_cons")) + F.when(F.col("market") == "b", 3 * F.coalesce("signal", F.lit(0.0))).otherwise(0.0))
    d = d.withColumns({"won": F.when(u(5) < p, 1.0).otherwise(0.0), "logit_cons": P.logit(F.col("p_cons")), "game_date": F.date_add(F.lit("2023-01-01"), (F.col("id") / 25).cast("int"))})
    return d.cache()


@pytest.mark.parametrize("booster", ["linear", "gbt"])
def test_model_gains_only_where_there_is_signal(props, booster):
    m = MD.fit_market_model(props, FEATURES, "id", booster=booster, config={**MD.CONFIGS["default"], "leaves": 7, "min_leaf": 50})
    r = {x.market: x for x in m.report.collect()}
    assert abs(r["a"].model_gain) < 0.01 and r["b"].model_gain > max(0.02, 10 * abs(r["a"].model_gain))
    scored = m.predict(props)
    assert scored.count() == 20000 and scored.filter("p_over_model IS NULL OR p_over_model <= 0 OR p_over_model >= 1").count() == 0
    assert m.oof.count() == 20000 and m.oof.select("id").distinct().count() == 20000
    if booster == "linear":
        top = MD.importances(m, props, "won", "id").filter("market = 'b'").orderBy(F.col("loss_gain").desc()).first()
        assert top.feature == "signal"


def bets(spark, n=9000):
    """Shopped prices: half of the apparent edge is the book's error in our favour, half is our own error."""
    d = spark.range(n).withColumns({"market": F.lit("m"), "anchor_src": F.when(F.col("id") % 3 == 0, "ladder").otherwise("direct"), "p_raw": 0.35 + 0.3 * u(1), "edge": 0.2 * u(2) - 0.05})
    real = F.when(F.col("anchor_src") == "direct", F.col("edge") / 2).otherwise(0.0)
    d = d.withColumns({"p_true": F.col("p_raw") + real, "p_model": F.col("p_raw") + F.col("edge")})
    return d.withColumns({"price": P.american_from_prob(F.col("p_raw")), "result": F.when(u(3) < F.col("p_true"), "win").otherwise("loss"), "book": F.lit("b1"), "n_books_cons": 5 * u(4), "lead_min": 60 * u(5),
                          "game_date": F.date_add(F.lit("2023-01-01"), (F.col("id") / 20).cast("int"))})


def test_correction_recovers_the_truth(spark):
    b = SE.add_apparent_edge(bets(spark))
    cal, kept = SE.fit_selection(b, books=TEST_BOOKS)
    assert cal.conditional is not None
    for fold in (None, F.col("oof_fold")):
        d = cal.apply(kept, fold)
        assert d.count() == 9000
        r = d.agg(F.avg(F.abs(F.col("p_cal") - F.col("p_true"))).alias("fixed"), F.avg(F.abs(F.col("p_model") - F.col("p_true"))).alias("raw")).first()
        assert r.fixed < 0.5 * r.raw
    by = {r.anchor_src: r.e for r in cal.apply(kept).filter("apparent_edge > 0.1").groupBy("anchor_src").agg(F.avg("realised_edge").alias("e")).collect()}
    assert by["direct"] > 0.03 and abs(by["ladder"]) < 0.03


def test_conditional_model_is_monotone_in_edge(spark):
    cal, kept = SE.fit_selection(SE.add_apparent_edge(bets(spark)), books=TEST_BOOKS)
    base = kept.limit(1)
    ladder = base.select("*", (F.explode(F.sequence(F.lit(-10), F.lit(20), F.lit(2)))).alias("e")).withColumn("apparent_edge", F.col("e") / 100)
    got = [r.p_cal for r in cal.apply(ladder).orderBy("apparent_edge").collect()]
    assert all(b >= a - 1e-9 for a, b in zip(got, got[1:]))


def test_efficient_market_yields_no_profit(spark, props):
    """End-to-end negative control: without signal next to nothing clears the threshold, and that makes no money."""
    p = props.filter("market = 'a'")
    hold = 0.03
    c = p.select(F.col("id"), "market", F.col("id").alias("event_id"), "game_date", F.lit("over").alias("side"), F.lit("b1").alias("book"), F.lit("direct").alias("anchor_src"), P.american_from_prob(F.col("p_cons") + hold).alias("price"), "p_cons",
                 F.lit(5.0).alias("n_books_cons"), F.lit(40.0).alias("lead_min"), F.when(F.col("won") == 1, "win").otherwise("loss").alias("result"), "noise", "signal", "logit_cons")
    d = W.walk_forward(p, c, FEATURES, ("id", "market"), "id", burn_days=400, step_days=200, books=TEST_BOOKS)
    r = d.agg(F.count("*").alias("n"), F.avg("profit").alias("roi"), (F.stddev("profit") / F.sqrt(F.count("*"))).alias("se")).first()
    assert r.n < 0.1 * c.count() and (r.n == 0 or r.roi < 2 * r.se)
