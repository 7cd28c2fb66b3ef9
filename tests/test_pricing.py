"""Closed-form facts about prices and margins."""
import math

import pytest
from pyspark.sql import functions as F

from quotelab.functions import names as N
from quotelab.functions import pricing as P


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_conversions_round_trip(spark):
    df = spark.createDataFrame([(float(p),) for p in (-400, -110, -100, 100, 150, 900)], "p double")
    for r in df.select("p", P.american_from_decimal(P.decimal_odds(F.col("p"))).alias("b"), P.american_from_prob(P.raw_prob(F.col("p"))).alias("c")).collect():
        want = 100.0 if r.p == -100 else r.p
        assert r.b == pytest.approx(want) and r.c == pytest.approx(want)


def test_every_method_sums_to_one_and_orders_longshots(spark):
    fav, dog = P.raw_prob(F.lit(-900.0)), P.raw_prob(F.lit(500.0))
    p = {m: one(spark, P.devig_pair(dog, fav, m), P.devig_pair(fav, dog, m)) for m in ("multiplicative", "additive", "power", "shin")}
    for m, r in p.items():
        assert r.c0 + r.c1 == pytest.approx(1, abs=1e-6), m
    assert p["power"].c0 < p["shin"].c0 + 1e-9 < p["multiplicative"].c0 + 1e-9


def test_group_methods_agree_with_pair(spark):
    a, b = P.raw_prob(F.lit(-130.0)), P.raw_prob(F.lit(105.0))
    for m in ("multiplicative", "additive", "power", "shin"):
        r = one(spark, P.devig_pair(a, b, m), P.devig_array(F.array(a, b), m)[0])
        assert r.c0 == pytest.approx(r.c1, abs=1e-6), m
    assert one(spark, P.devig_array(F.array(a), "shin")).c0 is None


def test_value_and_stake(spark):
    r = one(spark, P.expected_value(P.raw_prob(F.lit(-110.0)), F.lit(-110.0)), P.expected_value(F.lit(0.5), F.lit(100.0), 0.1), P.kelly(F.lit(0.4), F.lit(100.0)), P.kelly(F.lit(0.6), F.lit(100.0)), P.kelly(F.lit(0.6), F.lit(100.0), 0.02))
    assert r.c0 == pytest.approx(0) and r.c1 == pytest.approx(0.1) and r.c2 == 0 and r.c3 == pytest.approx(0.2) and r.c4 == 0.02


def test_null_stays_null(spark):
    n = F.lit(None).cast("double")
    assert list(one(spark, P.clip(n, 0, 1), P.logit(n), P.expit(n), P.devig_pair(n, F.lit(0.5)), P.finite(F.lit(math.inf)))) == [None] * 5


def test_confidence_and_settlement(spark):
    r = one(spark, P.confidence(F.lit(0.12), F.lit(10.0), F.lit(60.0)), P.confidence(F.lit(0.0), F.lit(2.0), F.lit(60.0)), P.settle_profit(F.lit("win"), F.lit(150.0)), P.settle_profit(F.lit("loss"), F.lit(150.0)), P.settle_profit(F.lit("void"), F.lit(150.0)))
    assert list(r) == [100.0, 13.0, 1.5, -1.0, 0.0]


@pytest.mark.parametrize("raw,key", [("José Ramírez Jr.", "jose ramirez"), ("Luis L. Ortiz", "luis l ortiz"), ("Max Muncy (2002)", "max muncy"), ("Cedric Mullins II", "cedric mullins"), ("D&apos;Arnaud", "d'arnaud"), ("", "")])
def test_person_key(spark, raw, key):
    assert one(spark, N.person_key(F.lit(raw))).c0 == key


def test_team_key(spark):
    r = one(spark, N.team_key(F.lit("Oakland  Athletics")), N.team_key(F.lit("St Louis Cardinals")), N.initial_last(F.lit("gunnar henderson")))
    assert list(r) == ["athletics", "st. louis cardinals", "g henderson"]
