"""Chunked computations equal the plain ones, on groups that hold most of the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.operators import evaluate as E
from quotelab.operators import form as FM
from quotelab.operators.isotonic import apply_isotonic, fit_isotonic
from quotelab.operators.skew import ordered_rank, quantile_bin, quantiles, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, and a third of those on one value."""
    d = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    v = F.when(F.col("id") % 9 == 0, 5.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(1009)) / 50.0)
    ts = F.timestamp_seconds(1.7e9 + F.pmod(F.col("id") * 613, F.lit(3001)) * 3600)
    return d.withColumns({"v": v, "ts": ts, "x": F.when(F.col("id") % 11 > 0, F.col("v"))}).cache()


def test_rank(spark, rows):
    w = Window.partitionBy("g").orderBy("v", "id")
    want = rows.select("id", F.row_number().over(w).alias("w"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    got = ordered_rank(rows, ["g"], F.col("v"), ["id"])
    assert got.join(want, "id").filter("rank <> w OR group_rows <> n").count() == 0 and got.count() == 3000


def test_quantiles(rows):
    probs = [i / 10 for i in range(11)]
    got = {(r.g, r.i): r.q for r in quantiles(rows, ["g"], "x", probs, 16).collect()}
    for r in rows.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("p")).collect():
        for i, p in enumerate(r.p):
            assert got[r.g, i] == pytest.approx(p)


def test_running_totals(rows):
    got = running_totals(rows.withColumn("n", F.lit(1)), ["g"], "v", F.floor(F.col("v") / 3), ["n"])
    w = Window.partitionBy("g").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    want = rows.select("g", "v", F.count("*").over(w).alias("upto")).distinct()
    assert got.join(want, ["g", "v"]).filter("n + n_below <> upto").count() == 0


def test_form_of_hot_entity(rows):
    args = ("g", "ts", "id", ["x", "v"], (10, 30), "f_", "prior", "rest")
    plain = FM.lagged_form(rows, *args)
    cut = FM.lagged_form(rows, *args, chunk_rows=40)
    cols = [c for c in plain.columns if c.startswith("f_")] + ["prior", "rest"]
    j = plain.alias("a").join(cut.alias("b"), "id")
    bad = F.lit(False)
    for c in cols:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        bad = bad | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 1e-9, F.lit(False))
    assert j.filter(bad).count() == 0 and cut.count() == 3000


def test_pending_equals_placeholder(spark, rows):
    as_of = "2023-12-20"
    past = rows.filter(F.col("ts") < as_of).select("id", "g", "ts", "x")
    stub = past.select("g").distinct().select((10**9 + F.xxhash64("g") % 1000).alias("id"), "g", F.lit(as_of).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("x"))
    want = FM.lagged_form(past.unionByName(stub), "g", "ts", "id", ["x"], (10, 30), "f_", "prior", "rest").filter(F.col("ts") == as_of)
    got = FM.pending_form(rows, "g", "ts", "id", ["x"], (10, 30), "f_", as_of, "prior", "rest")
    for a in want.collect():
        b = got.filter(F.col("g") == a.g).first()
        for c in ("f_x_r10", "f_x_r30", "f_x_exp", "prior", "rest"):
            assert a[c] == pytest.approx(b[c]), c


def test_threshold_grid_counts_by_brute_force(spark):
    d = spark.range(2000).select(F.lit("m").alias("market"), (F.col("id") % 300).alias("event_id"), (F.col("id") % 97 * 0.0025).alias("ev"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(-0.6).alias("profit")).toPandas()
    got = E.threshold_grid(spark.createDataFrame(d), ["market"]).toPandas()
    for r in got.itertuples():
        s = d[d.ev >= round(r.t / 0.0025) * 0.0025]
        assert (r.n, r.n_games) == (len(s), s.event_id.nunique()) and r.roi == pytest.approx(s.profit.mean()) and r.sd == pytest.approx(s.profit.std())


def pava(x, y):
    blocks = [[v, 1] for v in y[np.argsort(x, kind="stable")]]
    out = []
    for v, n in blocks:
        out.append([v, n])
        while len(out) > 1 and out[-2][0] / out[-2][1] > out[-1][0] / out[-1][1]:
            v, n = out.pop()
            out[-1][0] += v
            out[-1][1] += n
    return np.concatenate([[s / n] * n for s, n in out])


def test_isotonic_equals_plain_pooling(spark):
    rng = np.random.default_rng(3)
    x = rng.permutation(4000) / 4000.0
    y = (rng.random(4000) < x**2).astype(float)
    df = spark.createDataFrame([(("a", "b")[i % 2 == 0 and i % 6 == 0], float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, x double, y double")
    fit = fit_isotonic(df, ["g"], "x", "y").cache()
    out = apply_isotonic(df, fit, ["g"], "x", "p", 0.0, 1.0, 64).toPandas()
    assert len(out) == 4000 and out.p.notna().all()
    for g, part in out.groupby("g"):
        part = part.sort_values("x")
        np.testing.assert_allclose(part.p.to_numpy(), pava(part.x.to_numpy(), part.y.to_numpy()), atol=1e-9)


def test_windows_equal_plain_frames(rows):
    """Differences of prefix sums are the averages of the frames, nulls and short histories included."""
    got = FM.lagged_form(rows, "g", "ts", "id", ["x"], (10, 30), "f_", chunk_rows=40, current="c_")
    base = Window.partitionBy("g").orderBy("ts", "id")
    bad = F.lit(False)
    for prefix, shift in (("f_", 0), ("c_", 1)):
        for n in (10, 30):
            w = base.rowsBetween(shift - n, shift - 1)
            rows = rows.withColumn(f"w_{prefix}{n}", F.when(F.count("x").over(w) >= FM.min_observations(n), F.avg("x").over(w)))
            a, b = F.col(f"{prefix}x_r{n}"), F.col(f"w_{prefix}{n}")
            bad = bad | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 1e-9, F.lit(False))
    both = got.join(rows.drop("g", "ts", "v", "x"), "id")
    assert both.count() == 3000 and both.filter(bad).count() == 0


def test_ranges_of_a_heavy_tail_are_even(spark):
    """Bins of equal width would hold nearly every lognormal value in the first."""
    d = spark.range(20_000).select("id", F.lit("g").alias("g"), F.exp(4 * F.randn(7)).alias("x"))
    binned = quantile_bin(d, ["g"], "x", 64)
    cells = binned.groupBy("__w").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("__w").collect()
    assert len(cells) == 64 and max(c.n for c in cells) < 2 * 20_000 / 64
    assert all(a.high < b.low for a, b in zip(cells, cells[1:]))
    nulls = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, x double")
    assert {(r.g, r["__w"]) for r in quantile_bin(nulls, ["g"], "x").collect()} <= {("a", 0), ("b", 0), ("b", 1)}


def test_auc_of_a_heavy_tail(spark):
    rng = np.random.default_rng(4)
    x, won, m = np.exp(4 * rng.normal(size=2000)), rng.integers(0, 2, 2000), rng.random(2000)
    d = spark.createDataFrame([(k, "g", float(a), int(b), float(c)) for k, (a, b, c) in enumerate(zip(x, won, m))], "id long, g string, x double, won int, m double")
    got = E.stratified_auc(d, ["g"], "x", "won", "m", "id").first()
    u = pairs = 0.0
    for part in np.array_split(np.argsort(m, kind="stable"), E.STRATA):
        one, none = x[part][won[part] == 1], x[part][won[part] == 0]
        u += (one[:, None] > none).sum() + (one[:, None] == none).sum() / 2
        pairs += len(one) * len(none)
    assert got.n == 2000 and got.auc == pytest.approx(u / pairs)


def test_bootstrap_holds_one_group_at_a_time(spark, monkeypatch):
    """Many groups, one of them with a third of the rows and cut into tiles, a null one too: as all sums at once."""
    monkeypatch.setattr(E, "TILE", 64)
    d = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), (F.col("id") % 200).cast("string"))).alias("g"),
                                 (F.pmod(F.col("id") * 7919, F.lit(1009)) / 500.0 - 1).alias("profit"))
    got = {(r.g, r.rep): r.roi for r in E.bootstrap_replicates(d, ["g"], 20).collect()}
    sums: dict = {}
    weigh = np.searchsorted(np.array(E.POISSON_CDF), np.arange(1000003) / 1000003.0, side="right")
    rep = np.arange(20)
    for r in d.collect():
        c = r.event_id
        h = (c * 7919 + rep * 104729) % 1000003
        k = (h * h + c * 31 + rep * 17 + 11) % 1000003
        w = weigh[(k * k + h * 7 + rep) % 1000003]
        acc = sums.setdefault(r.g, np.zeros((2, 20)))
        acc += np.array([r.profit * w, w])
    assert len(got) == 20 * len(sums) and None in sums
    for g, (num, den) in sums.items():
        for k in range(20):
            assert got[g, k] is None if den[k] == 0 else got[g, k] == pytest.approx(num[k] / den[k])


def test_bootstrap_folds_clusters_of_one_remainder(spark, monkeypatch):
    """What the replicates are computed from is bounded by the hash's modulus, however many clusters a table has."""
    d = spark.range(400).select(F.lit("a").alias("g"), (F.col("id") % 80 + F.floor(F.col("id") / 80) * 1000003).alias("event_id"), (F.pmod(F.col("id") * 7919, F.lit(1009)) / 500.0 - 1).alias("profit"))
    same = d.withColumn("event_id", F.col("event_id") % 1000003)
    a, b = ({r.rep: r.roi for r in E.bootstrap_replicates(x, ["g"], 30).collect()} for x in (d, same))
    assert a == pytest.approx(b)
    assert E.bootstrap(d, ["g"], 30).first().n_clusters == 400
    seen = lambda by, n_boot: lambda batches: (p.assign(rep=p["c"], num=1.0, den=1.0)[[*by, "rep", "num", "den"]] for p in batches)
    monkeypatch.setattr(E, "_replicate_sums", seen)
    assert {r.rep for r in E.bootstrap_replicates(d, ["g"], 30).collect()} == set(range(80))
