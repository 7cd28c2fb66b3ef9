"""Evaluation of a bet ledger: summaries, calibration, bootstrap, thresholds, stability, decay."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quotelab.dims import BOOKS, Books
from quotelab.functions import pricing as P
from quotelab.operators.keys import first_per_key, null_safe_join
from quotelab.operators.skew import ordered_rank, quantile_bin, quantiles, running_totals
from quotelab.session import materialise

DECIDED = ("win", "loss")
# ---- fixed values: grids, bounds, Poisson(1) distribution function -------------------------------
MIN_PRICE, MAX_PRICE = -2000.0, 2000.0
GRID_STEP, GRID_SIZE = 0.0025, 64
MIN_GRID_BETS = 150
EMPTY_THRESHOLD, FALLBACK_THRESHOLD = 0.02, 0.03
MIN_SEGMENT_BETS = 250
MIN_CLUSTERS = 20
POISSON_CDF = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
RECENT_SHARE, MIN_RECENT = 1.0 / 3.0, 60
STRATA, MIN_STRATUM = 20, 50
# ---- end of fixed values -----------------------------------------------------------------------
#: A cluster's weights depend on its id modulo this number only.
PRIME = 1_000_003
#: Clusters (modulo ``PRIME``) that go to a task of the bootstrap together, and groups whose sums a task holds, on average.
TILE, BUNDLE = 4096, 64


def stakeable(price: Column) -> Column:
    return price.between(MIN_PRICE, MAX_PRICE)


def won_flag(result: Column) -> Column:
    return F.when(result == "win", 1.0).otherwise(0.0)


def bet_summary(bets: DataFrame, by: list[str], books: Books = BOOKS) -> DataFrame:
    """Counts, return and averages per group, with the same for the books most bettors can reach."""
    n = lambda r: F.count_if(F.col("result") == r)
    major = books.is_major(F.col("book"))
    return bets.groupBy(*by).agg(
        F.count("*").alias("n_bets"), F.avg("profit").alias("roi"), F.sum("profit").alias("profit"),
        F.try_divide(n("win").cast("double"), n("win") + n("loss")).alias("hit_rate"),
        F.avg("price").alias("avg_price"), F.avg("ev").alias("avg_ev"),
        n("win").alias("n_win"), n("loss").alias("n_loss"), n("push").alias("n_push"),
        F.count_distinct("event_id").alias("n_games"),
        F.count_if(major).alias("n_major"), F.avg(F.when(major, F.col("profit"))).alias("roi_major"))


def period_stability(bets: DataFrame, by: list[str], period: str = "fold") -> DataFrame:
    return bets.groupBy(*by, period).agg(F.count("*").alias("n"), F.avg("profit").alias("roi"), F.sum("profit").alias("profit"))


def stability(bets: DataFrame, by: list[str], period: str = "fold") -> DataFrame:
    """Number of folds, share of winning folds, and the largest fold's share of a positive total."""
    g = period_stability(bets, by, period).groupBy(*by).agg(
        F.count("*").alias("n_folds"), F.avg((F.col("roi") > 0).cast("double")).alias("fold_win_rate"),
        F.max("profit").alias("top"), F.sum("profit").alias("total"))
    return g.select(*by, "n_folds", "fold_win_rate", F.when(F.col("total") > 0, F.try_divide("top", "total")).alias("max_fold_share"))


def calibration_bins(bets: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Predicted against realised share in quantile bins: right-closed edges, equal edges merged, ties together."""
    d = bets.filter(F.col("result").isin(*DECIDED))
    q = quantiles(d, by, "p_model", [i / bins for i in range(bins + 1)])
    edges = q.groupBy(*by).agg(F.array_sort(F.collect_set("q")).alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    d = d.join(edges.select(*by, inner.alias("inner")), by)
    d = d.withColumn("bin", F.size(F.filter("inner", lambda e: F.col("p_model") > e)))
    return d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p_model").alias("pred"), F.avg(won_flag(F.col("result"))).alias("actual"))


def calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Weighted gap between predicted and realised, and the gap that sampling alone would leave."""
    p, n = F.col("pred"), F.col("n")
    noise = F.sqrt(2 * p * (1 - p) / (F.pi() * n))
    return bins.groupBy(*by).agg(
        (F.sum(n * F.abs(p - F.col("actual"))) / F.sum(n)).alias("cal_error"), (F.sum(n * noise) / F.sum(n)).alias("cal_noise_floor"))


def _replicate_sums(by: list[str], n_boot: int, cells: int = 1 << 19):
    """Partition function: weighted sums per group and replicate over the clusters of a task, in the order of bundle and cluster.

    Holds the sums of one bundle of groups. A cluster's Poisson(1) weight in a replicate comes from integer hashing of both, so it is
    the same wherever and however often it is computed; it is computed once for all groups of a bundle.
    """
    m, block = np.uint64(PRIME), max(1, cells // n_boot)

    def run(batches):
        weights = np.searchsorted(np.array(POISSON_CDF), np.arange(PRIME) / float(PRIME), side="right").astype(np.float64)
        rep = np.arange(n_boot, dtype=np.uint64)[None, :]
        mod = lambda x: x - x // m * m
        step, shift = mod(rep * np.uint64(104729)), rep * np.uint64(17) + np.uint64(11)
        bundle, sums = None, {}

        def done():
            for key, (num, den) in sums.items():
                yield pd.DataFrame({**{c: pd.Series([v] * n_boot, dtype=object) for c, v in zip(by, key, strict=True)}, "rep": rep[0].astype(np.int64), "num": num, "den": den})

        for pdf in batches:
            for at, part in pdf.groupby("__bundle"):
                if at != bundle:
                    yield from done()
                    bundle, sums = at, {}
                _, first, code = np.unique(part.groupby(by, sort=False, dropna=False).ngroup().to_numpy(), return_index=True, return_inverse=True)
                keys = [tuple(None if v != v else v for v in row) for row in part[by].iloc[first].itertuples(index=False, name=None)]
                found, where = np.unique(part["c"].to_numpy(np.uint64), return_inverse=True)
                ends = np.searchsorted(where, np.arange(len(found) + 1))
                values, total = part[["s", "n"]].to_numpy(np.float64).T, np.zeros((2 * len(keys), n_boot))
                for i in range(0, len(found), block):
                    c = found[i : i + block, None]
                    rows = slice(ends[i], ends[min(i + block, len(found))])
                    here = np.zeros((2, len(keys), len(c)))
                    here[:, code[rows], where[rows] - i] = values[:, rows]
                    h = mod(c * np.uint64(7919) + step)
                    g = mod(h * h + c * np.uint64(31) + shift)
                    total += here.reshape(-1, len(c)) @ weights[mod(g * g + h * np.uint64(7) + rep).view(np.int64)]
                for key, one in zip(keys, total.reshape(2, len(keys), n_boot).swapaxes(0, 1), strict=True):
                    sums[key] = sums[key] + one if key in sums else one
        yield from done()

    return run


def integer_key(df: DataFrame, column: str) -> Column:
    """An id as a small non-negative integer: integers as they are, ids of any other type by their hash."""
    whole = isinstance(df.schema[column].dataType, (T.IntegralType, T.DecimalType))
    return F.col(column).cast("bigint") if whole else F.pmod(F.xxhash64(column), F.lit(1 << 31))


def bootstrap_replicates(bets: DataFrame, by: list[str], n_boot: int, cluster: str = "event_id") -> DataFrame:
    """(by, rep, roi): return in each replicate of a bootstrap over whole clusters.

    Bets collapse to one sum and count per group and cluster modulo ``PRIME``: clusters with the same remainder have the same
    weights, so no table makes more than ``PRIME`` times replicates of these. They are dealt to tasks by remainder, all groups
    of a bundle together; a task's sums per group and replicate are all that is shuffled on. Vectorised in Python because the
    weight of every (cluster, replicate) is the whole cost.
    """
    spread = int(bets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = bets.withColumn("c", F.pmod(integer_key(bets, cluster), F.lit(PRIME)).cast("bigint")).groupBy(*by, "c").agg(F.sum("profit").alias("s"), F.count("*").alias("n"))
    bundles = bets.select(*by).distinct().agg(F.ceil(F.count("*") / BUNDLE).alias("__bundles"))
    c = c.crossJoin(F.broadcast(bundles)).withColumn("__bundle", F.pmod(F.xxhash64(*by), F.col("__bundles")))
    c = c.repartition(spread, "__bundle", F.pmod(F.xxhash64("c"), F.lit(-(-PRIME // TILE)))).sortWithinPartitions("__bundle", "c").select(*by, "__bundle", "c", "s", "n")
    schema = T.StructType([*[c.schema[k] for k in by], T.StructField("rep", T.LongType()), T.StructField("num", T.DoubleType()), T.StructField("den", T.DoubleType())])
    return c.mapInPandas(_replicate_sums(by, n_boot), schema).groupBy(*by, "rep").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("roi"))


def bootstrap(bets: DataFrame, by: list[str], n_boot: int = 4000, cluster: str = "event_id") -> DataFrame:
    """(by, roi, roi_lo, roi_hi, p_value, n_clusters) from one set of replicates.

    Interval: 2.5 and 97.5 percentiles. p-value: share of centred replicates at or above the return itself. Below
    twenty clusters there is no interval and the p-value is one.
    """
    point = bets.groupBy(*by, cluster).agg(F.sum("profit").alias("s"), F.count("*").alias("n")).groupBy(*by).agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("roi"), F.count("*").alias("n_clusters"))
    reps = bootstrap_replicates(bets, by, n_boot, cluster).withColumnRenamed("roi", "r").join(point, by)
    g = reps.groupBy(*by, "roi", "n_clusters").agg(
        F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg((F.col("r") - F.col("roi") >= F.col("roi")).cast("double")).alias("p"))
    enough = F.col("n_clusters") >= MIN_CLUSTERS
    return g.select(*by, "roi", F.when(enough, F.col("ci")[0]).alias("roi_lo"), F.when(enough, F.col("ci")[1]).alias("roi_hi"),
                    F.when(enough, F.col("p")).otherwise(1.0).alias("p_value"), "n_clusters")


def threshold_grid(bets: DataFrame, by: list[str], ev: str = "ev") -> DataFrame:
    """(by, t, n, roi, sd, n_games, score) for each cut of the grid that some bet clears.

    Each bet is placed once, in the highest cut it clears; what lies at or above a cut is then a sum over at most 64 entries. A game counts at every cut up to the best of its bets.
    """
    i = F.floor(F.col(ev) / GRID_STEP)
    i = F.when((i + 1) * GRID_STEP <= F.col(ev), i + 1).when(i * GRID_STEP > F.col(ev), i - 1).otherwise(i)
    d = bets.withColumn("i", F.least(i, F.lit(GRID_SIZE - 1)).cast("int")).filter("i >= 0")
    # One read of the bets: per game and cut, then per cut with the games that go no higher, at most 64 rows a group.
    per_game = d.groupBy(*by, "event_id", "i").agg(F.count("*").alias("n"), F.sum("profit").alias("s"), F.sum(F.col("profit") * F.col("profit")).alias("ss"))
    best = F.max("i").over(Window.partitionBy(*by, "event_id"))
    per_cut = per_game.withColumn("top", best == F.col("i")).groupBy(*by, "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.count_if("top").alias("games"))
    cuts = per_cut.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "n", "s", "ss", "games"))).alias("cuts"))
    above = lambda i, c, zero: F.aggregate(F.filter("cuts", lambda x: x["i"] >= i), zero, lambda acc, x: acc + x[c])
    none = F.lit(0).cast("long")
    d = cuts.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1)), lambda i: F.struct(
        (i * GRID_STEP).alias("t"), above(i, "n", none).alias("n"), above(i, "s", F.lit(0.0)).alias("s"), above(i, "ss", F.lit(0.0)).alias("ss"), above(i, "games", none).alias("games")))).alias("g"))
    d = d.select(*by, "g.*").filter("n > 0")
    roi = F.col("s") / F.col("n")
    var = F.try_divide(F.col("ss") - F.col("s") * roi, F.col("n") - 1)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    d = d.select(*by, "t", "n", roi.alias("roi"), sd.alias("sd"), F.col("games").alias("n_games"))
    spread = F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return d.withColumn("score", F.col("roi") * F.sqrt(F.greatest("n_games", F.lit(1))) / spread)


def choose_thresholds(grid: DataFrame, by: list[str], min_bets: int = MIN_GRID_BETS, bets: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(by, threshold): the cut with the best score among those with enough bets and a profit; the lowest of equals.

    ``bets`` are those behind the grid: a group whose bets reach no cut has a fallback like one in which no cut qualifies.
    ``groups`` lists all groups there are; one without any bet has the threshold of an empty ledger.
    """
    ok = (F.col("n") >= min_bets) & (F.col("roi") > 0)
    best = F.max(F.when(ok, F.struct("score", (-F.col("t")).alias("nt"))))
    chosen = grid.groupBy(*by).agg(best.alias("b")).select(*by, F.coalesce(-F.col("b.nt"), F.lit(FALLBACK_THRESHOLD)).alias("threshold"))
    for known, default in ((bets, FALLBACK_THRESHOLD), (groups, EMPTY_THRESHOLD)):
        if known is not None:
            chosen = known.select(*by).distinct().join(chosen, by, "left").na.fill(default, ["threshold"])
    return chosen


def judged_segments(bets: DataFrame, by: list[str], min_n: int = MIN_SEGMENT_BETS) -> DataFrame:
    """(by, segment, allowed) of every segment with bets: too thin to judge, or profitable. ``bets`` clear the threshold."""
    d = bets.withColumn("segment", P.segment(F.col("anchor_src"), F.col("price")))
    g = d.groupBy(*by, "segment").agg(F.count("*").alias("n"), F.avg("profit").alias("roi"))
    return g.select(*by, "segment", ((F.col("n") < min_n) | (F.col("roi") > 0)).alias("allowed"))


def profitable_segments(bets: DataFrame, by: list[str], min_n: int = MIN_SEGMENT_BETS) -> DataFrame:
    """(by, segment) allowed to bet: too thin to judge, or profitable. ``bets`` already clear the threshold."""
    return judged_segments(bets, by, min_n).filter("allowed").select(*by, "segment")


def one_bet(bets: DataFrame, key: list[str], ev: str, tie: list[str]) -> DataFrame:
    """The bet with the highest expected value per proposition; after ``tie`` the side, book and price decide, as both sides may be worth the same."""
    rest = [c for c in ("side", "book", "price") if c in bets.columns and c not in {*key, *tie}]
    return first_per_key(bets, key, [F.col(ev).desc(), *[F.col(c) for c in (*tie, *rest)]])


def recent(bets: DataFrame, by: list[str], share: float = RECENT_SHARE, z: float = 1.0, tie: str = "bet_id") -> DataFrame:
    """(by, recent_n, recent_roi, decayed) over the last part of the bets by date.

    Decay is called only where the recent mean lies below zero by more than ``z`` standard errors.
    """
    d = _latest(bets, by, lambda rows: F.greatest(F.floor(rows * share), F.lit(1)), tie, "game_date")
    g = d.groupBy(*by).agg(
        F.count("*").alias("recent_n"), F.avg("profit").alias("recent_roi"), F.stddev_samp("profit").alias("sd"))
    low = F.col("recent_roi") + z * F.col("sd") / F.sqrt("recent_n") < 0
    return g.select(*by, "recent_n", "recent_roi", (F.coalesce(low, F.lit(False)) & (F.col("recent_n") >= MIN_RECENT)).alias("decayed"))


def most_recent(df: DataFrame, by: list[str], n: int, tie: str, date: str = "game_date") -> DataFrame:
    """The ``n`` most recent rows of each group by (date, tie)."""
    return _latest(df, by, lambda rows: F.lit(n).cast("long"), tie, date)


def _latest(df: DataFrame, by: list[str], wanted, tie: str, date: str) -> DataFrame:
    """The last ``wanted(rows of the group)`` rows of each group by (date, tie); rows without a date come first.

    Counts per day tell which days stay whole and how many rows the day at the cut keeps; only rows of that day are ranked.
    """
    day = F.coalesce(F.to_date(date), F.lit("0001-01-01").cast("date"))
    days = df.groupBy(*by, day.alias("__day")).agg(F.count("*").alias("__n"))  # groups times days
    group = Window.partitionBy(*by)
    later = F.sum("__n").over(group.orderBy(F.col("__day").desc())) - F.col("__n")
    days = days.select(*by, "__day", "__n", (wanted(F.sum("__n").over(group)) - later).alias("__left")).filter("__left > 0")
    d = null_safe_join(df.withColumn("__day", day), days, [*by, "__day"], "inner", nullable=by)
    cut = d.filter("__left < __n").withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__day").orderBy(F.col(tie).desc())))
    return d.filter("__left >= __n").select(*df.columns).unionByName(cut.filter("__rank <= __left").select(*df.columns))


def breakdowns(bets: DataFrame, min_book_bets: int = 10) -> DataFrame:
    """Bets, return and profit per market by fold, by book and by anchor, in one pass of grouping sets."""
    sets = [["market", "fold"], ["market", "book"], ["market", "anchor_src"]]
    d = bets.withColumn("fold", F.col("fold").cast("string"))
    g = d.groupingSets([[F.col(c) for c in s] for s in sets], "market", "fold", "book", "anchor_src").agg(
        F.count("*").alias("n"), F.avg("profit").alias("roi"), F.sum("profit").alias("profit"))
    by = F.when(F.col("fold").isNotNull(), "fold").when(F.col("book").isNotNull(), "book").otherwise("anchor")
    g = g.select("market", by.alias("breakdown"), F.coalesce("fold", "book", "anchor_src").alias("value"), "n", "roi", "profit")
    return g.filter((F.col("breakdown") != "book") | (F.col("n") >= min_book_bets))


def stratified_auc(df: DataFrame, by: list[str], x: str, won: str, market: str, tie: str, strata: int = STRATA, min_stratum: int = MIN_STRATUM, n_bins: int = 64) -> DataFrame:
    """(by, n, auc): AUC of ``x`` within equal-count strata of the market value, pooled by pairs compared.

    Strata come from ordered ranks and the comparisons from running counts per distinct value, so neither step
    sorts a whole group in one task.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(won).isNotNull() & F.col(market).isNotNull())
    d = ordered_rank(d, by, F.col(market), [tie])
    q, extra, r0 = F.floor(F.col("group_rows") / strata), F.pmod(F.col("group_rows"), F.lit(strata)), F.col("rank") - 1
    head = extra * (q + 1)
    d = d.withColumn("stratum", F.when(r0 < head, F.floor(r0 / (q + 1))).otherwise(extra + F.floor(F.try_divide(r0 - head, q))))
    keys = [*by, "stratum"]
    # One row per distinct value from here on, stored: bins, running counts and offsets all read it.
    d = materialise(d.groupBy(*keys, F.col(x).alias("x")).agg(
        F.sum(F.col(won).cast("bigint")).alias("n1"), F.sum((1 - F.col(won)).cast("bigint")).alias("n0")), "strata")
    d = quantile_bin(d, keys, "x", n_bins)
    v = running_totals(d.withColumnRenamed("__w", "bin"), [*keys, "bin"], "x", F.lit(0), ["n1", "n0"]).select(*keys, "bin", "x", "n1", "n0", F.col("n0_below").alias("below_in_bin"))
    bins = v.groupBy(*keys, "bin").agg(F.sum("n0").alias("b0"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "bin", F.coalesce(F.sum("b0").over(before), F.lit(0)).alias("below_bins"))
    u = v.join(bins, [*keys, "bin"]).groupBy(*keys).agg(
        F.sum(F.col("n1") * (F.col("below_bins") + F.col("below_in_bin") + F.col("n0") / 2)).alias("u"), F.sum("n1").alias("p1"), F.sum("n0").alias("p0"))
    use = (F.col("p1") + F.col("p0") >= min_stratum) & (F.col("p1") > 0) & (F.col("p0") > 0)
    g = u.groupBy(*by).agg(F.sum(F.col("p1") + F.col("p0")).alias("n"), F.sum(F.when(use, F.col("u"))).alias("u"), F.sum(F.when(use, F.col("p1") * F.col("p0"))).alias("pairs"))
    return g.select(*by, "n", F.coalesce(F.try_divide("u", "pairs"), F.lit(0.5)).alias("auc"))


def benjamini_hochberg(pvalues: DataFrame, alpha: float = 0.05, key: str = "market", p: str = "p_value") -> DataFrame:
    """(key, p, survives): step-up procedure. One row per market, so the ordering window is as small as that."""
    d = pvalues.filter(F.col(p).isNotNull() & ~F.isnan(p)).select(key, p)
    w = Window.partitionBy(F.lit(0))
    d = d.withColumn("__r", F.row_number().over(w.orderBy(p, key))).withColumn("__m", F.count("*").over(w))
    top = F.max(F.when(F.col(p) <= alpha * F.col("__r") / F.col("__m"), F.col("__r"))).over(w)
    d = d.withColumn("survives", F.col("__r") <= F.coalesce(top, F.lit(0)))
    return pvalues.select(key, p).join(d.select(key, "survives"), key, "left").na.fill(False, ["survives"])
