"""Fits of many blocks at once: bounds on rows, minima, one fit per penalty, isotonic pooling over the borders of batches."""
import numpy as np
from pyspark.sql import functions as F

from quotelab.operators import model as MD
from quotelab.operators.isotonic import fit_isotonic


def rows(spark, n=1200, last_day=300):
    """The last ``last_day`` rows share one date."""
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000003)) / 1000003.0
    day = F.least((F.col("id") / 10).cast("int"), F.lit((n - last_day) // 10))
    d = spark.range(n).withColumns({"market": F.when(F.col("id") % 2 == 0, "a").otherwise("b"), "x": F.when(u(1) < 0.9, u(2)), "logit_cons": 2 * u(3) - 1, "game_date": F.date_add(F.lit("2023-01-01"), day)})
    return d.withColumn("won", F.when(u(4) < 1 / (1 + F.exp(-F.col("logit_cons") - F.coalesce("x", F.lit(0.0)))), 1.0).otherwise(0.0))


def test_bound_leaves_every_fold_its_rows(spark):
    """All rows within the bound of a market are of one day, so the fit that leaves this day's fold out takes earlier ones."""
    d = rows(spark)
    m = MD.fit_market_model(d, ["x"], "id", max_rows=50)
    assert m.oof.count() == 1200 and m.oof.filter("p_over_oof IS NULL OR p_over_oof <= 0 OR p_over_oof >= 1").count() == 0
    t = MD.with_targets(MD.date_fold(d, 3), "market", 3, 50, "id").select("market", "id", "oof_fold", F.explode("__targets").alias("t"))
    got = {(r.market, r.t): sorted(r.ids) for r in t.groupBy("market", "t").agg(F.collect_list("id").alias("ids")).collect()}
    held = [(r.market, r.id, r.oof_fold) for r in MD.date_fold(d, 3).collect()]
    for market in "ab":
        for fold in (0, 1, 2, MD.FULL):
            assert got[market, fold] == sorted(i for m, i, f in held if m == market and f != fold)[-50:]


def test_blocks_are_at_their_minima(spark):
    train = MD.date_fold(rows(spark), 3)
    fit = MD.fit_blocks(train, ["x", "logit_cons"], "won", l2=1e-3)
    worst = {r.block: r.worst for r in MD.block_gradients(fit, train, "won", 1e-3).collect()}
    assert len(worst) == 8 and max(worst.values()) < 1e-6
    bounded = MD.fit_blocks(train.withColumn("won", 1 - F.col("won")), ["x", "logit_cons"], "won", l2=1e-3, increasing="logit_cons")
    at = MD._inputs(["x", "logit_cons"]).index("__z_logit_cons")
    w = {r.block: r.w for r in bounded.coefficients.collect()}
    assert all(v[at] == 0 for v in w.values())
    flat = MD.fit_blocks(train.withColumn("won", 1 - F.col("won")), ["x"], "won", l2=1e-3)  # without the feature
    for r in flat.coefficients.collect():
        assert np.allclose(np.delete(w[r.block], [at, at + 2]), r.w, atol=1e-6)


def test_a_fit_without_rows_is_that_of_its_penalty(spark):
    d = rows(spark, 900, 900)  # one date: the fit that leaves it out has no rows
    m = MD.fit_market_model(d, ["x"], "id")
    assert m.oof.count() == 900 and m.oof.filter("p_over_oof IS NULL").count() == 0


def test_tune_fits_each_penalty_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(MD, "fit_stored", lambda held, l2, *rest, fit=MD.fit_stored: calls.append(l2) or fit(held, l2, *rest))
    configs = {"one": {"l2": 1.0}, "two": {"l2": 1.0}, "three": {"l2": 5.0}}
    d = MD.tune(rows(spark), ["x"], "id", configs=configs).collect()
    assert len(calls) == 2 and len(d) == 6
    loss = {(r.market, r.config): r.log_loss for r in d}
    m = MD.fit_market_model(rows(spark), ["x"], "id", config={"l2": 5.0})
    for r in m.report.collect():
        assert loss[r.market, "one"] == loss[r.market, "two"] and abs(loss[r.market, "three"] - r.ll_final) < 1e-12


def test_isotonic_pools_over_batches(spark):
    def whole(y):
        out = []
        for v in y:
            out.append([v, 1])
            while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
                s, n = out.pop()
                out[-1] = [out[-1][0] + s, out[-1][1] + n]
        return [s / n for s, n in out]

    data = [(g, float(i), float((i * 7919 * (g + 1)) % 101) + i / 10) for g in (0, 1, 2) for i in range(200 if g else 3)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = fit_isotonic(spark.createDataFrame(data, "g int, x double, y double"), ["g"], "x", "y").orderBy("g", "lo").collect()
    finally:
        spark.conf.set(key, before)
    for g in (0, 1, 2):
        assert np.allclose([r.y for r in got if r.g == g], whole([y for k, _, y in data if k == g]))
