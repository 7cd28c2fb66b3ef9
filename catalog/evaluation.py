"""Weights, thresholds, ledger evaluation, audits and the gate."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import ATTACH_CTE, BOOKS_CTE, CONSENSUS_CTE, LOGIT, LOGLOSS, RAW, TEST_BOOKS, ctes, r6, table, view
from catalog.frames import _J, judged_quotes
from catalog.quotes import BAND_SQL
from quotelab.functions import pricing as P
from quotelab.operators import audit as A
from quotelab.operators import calibrate as K
from quotelab.operators import consensus as C
from quotelab.operators import evaluate as E
from quotelab.operators import folds as FO
from quotelab.operators import form as FM
from quotelab.operators import frames as FR
from quotelab.operators import gate as G
from quotelab.operators import movement as MV
from quotelab.operators.keys import first_per_key
from quotelab.session import materialise

M = ["market"]
B = ctes("bets_v")


def _bets(spark, sf):
    return view(spark, sf, "bets_v")


def _steady(bets):
    """Probabilities without the noise of their last bits, which would decide on which side of an edge they fall."""
    return bets.withColumn("p_model", F.round("p_model", 9))


def _views_outcomes(spark, sf):
    q = view(spark, sf, "quotes_v").filter("tag = 'decision'")
    v = C.book_views(q, books=TEST_BOOKS, key=FR.PROPOSITION)
    return v, FR.proposition_outcome(judged_quotes(spark, sf))


def anchor_weights(spark, sf):
    v, o = _views_outcomes(spark, sf)
    return K.fit_anchor_weights(v, o, TEST_BOOKS).withColumn("w", r6("w"))


_AW = f"""{_J}, m AS (SELECT bv.*, po.won FROM bv JOIN po ON bv.event_id = po.event_id AND bv.market = po.market AND bv.line IS NOT DISTINCT FROM po.line),
br AS (SELECT market, avg(won) AS base FROM m GROUP BY market),
wk AS (SELECT m.market, m.book, max(w0) AS prior, count(*) AS n, avg({LOGLOSS.format('won', 'base', '1e-6')}) - avg({LOGLOSS.format('won', 'p_over', '1e-6')}) AS skill
  FROM m JOIN br USING (market) JOIN books ON m.book = books.book GROUP BY ALL HAVING count(*) >= 400),
wr AS (SELECT *, CASE WHEN skill <= 0 THEN 0 ELSE n / (n + 2000.0e0) * skill + (1 - n / (n + 2000.0e0)) * prior END AS raw FROM wk),
aw AS (SELECT market, book, CASE WHEN max(raw) OVER (PARTITION BY market) > 0 THEN round(least(1.0e0, raw / max(raw) OVER (PARTITION BY market)), 4) ELSE raw END AS w, n FROM wr)"""
ANCHOR_SQL = f"{_AW} SELECT market, book, round(w, 6) AS w, n FROM aw"


def _compared(spark, sf):
    v, o = _views_outcomes(spark, sf)
    fitted = K.fit_anchor_weights(v, o, TEST_BOOKS)
    return v, fitted, K.compare_schemes(v, o, TEST_BOOKS, fitted, lead_book="b1")


def consensus_schemes(spark, sf):
    return _compared(spark, sf)[2].select("scheme", "market", "n", r6("log_loss", "log_loss"))


_SCHEMES = {
    "prior": "w0", "sharp_heavy": "CASE tier WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.1e0 ELSE 0.02e0 END",
    "sharp_only": "CASE WHEN tier <= 1 THEN 1.0e0 ELSE 0.0e0 END", "exchange_first": "CASE WHEN tier = 0 OR books.book = 'b1' THEN 1.0e0 ELSE 0.05e0 END",
    "uniform": "1.0e0", "fitted": "coalesce(aw.w, w0)"}
_SC = f"""{_AW}, sc AS ({' UNION ALL '.join(f"SELECT '{s}' AS scheme, bv.event_id, bv.market, bv.line, p_over, CASE WHEN dfs OR hold > 0.35e0 THEN 0.0e0 ELSE {w} END AS sw FROM bv JOIN books ON bv.book = books.book LEFT JOIN aw ON aw.market = bv.market AND aw.book = bv.book" for s, w in _SCHEMES.items())}),
pc AS (SELECT scheme, event_id, market, line, CASE WHEN count(*) FILTER (WHERE sw > 0) >= 2 THEN 1 / (1 + exp(-sum(sw * {LOGIT.format('p_over')}) / sum(sw))) END AS p FROM sc GROUP BY ALL),
cmp AS (SELECT scheme, pc.market, count(*) AS n, avg({LOGLOSS.format('won', 'p', '1e-6')}) AS log_loss FROM pc JOIN po ON pc.event_id = po.event_id AND pc.market = po.market AND pc.line IS NOT DISTINCT FROM po.line
  WHERE p IS NOT NULL GROUP BY ALL),
cmp2 AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY scheme) AS t FROM cmp) WHERE t >= 1000 AND n >= 500)"""
SCHEMES_SQL = f"{_SC} SELECT scheme, market, n, round(log_loss, 6) AS log_loss FROM cmp2"


def scheme_weights(spark, sf):
    v, fitted, cmp = _compared(spark, sf)
    return K.weights_from_schemes(K.best_schemes(cmp), v, TEST_BOOKS, fitted, lead_book="b1").withColumn("w", r6("w"))


SCHEME_WEIGHTS_SQL = f"""{_SC}, bs AS (SELECT market, arg_min(scheme, log_loss) AS scheme FROM cmp2 GROUP BY market),
sw AS (SELECT DISTINCT bv.market, bv.book, CASE bs.scheme {' '.join(f"WHEN '{s}' THEN {w}" for s, w in _SCHEMES.items())} END AS w
  FROM bv JOIN bs ON bv.market = bs.market JOIN books ON bv.book = books.book LEFT JOIN aw ON aw.market = bv.market AND aw.book = bv.book)
SELECT market, book, round(w, 6) AS w FROM sw"""


def shrink_grid(spark, sf):
    b = _bets(spark, sf).withColumns({"lc": P.logit(F.col("p_raw")), "lm": P.logit(F.col("p_model")), "won": E.won_flag(F.col("result"))})
    g = K.shrink_grid(b, M, "won", "lc", "lm")
    best = K.best_shrink(g, M).withColumnRenamed("log_loss", "best_loss")
    return g.join(best, M).select("market", r6("s", "s"), r6("log_loss", "log_loss"), r6("shrink", "shrink"))


SHRINK_SQL = f"""{B}, d AS (SELECT market, {LOGIT.format('p_raw')} AS lc, {LOGIT.format('p_model')} AS lm, CASE result WHEN 'win' THEN 1.0e0 ELSE 0.0e0 END AS won FROM bets_v),
g AS (SELECT market, i / 40.0e0 AS s, avg({LOGLOSS.format('won', '(1 / (1 + exp(-(lc + i / 40.0e0 * (lm - lc)))))', '1e-7')}) AS log_loss FROM d, range(41) t(i) GROUP BY ALL)
SELECT market, round(s, 6) AS s, round(log_loss, 6) AS log_loss, round(arg_min(s, log_loss) OVER (PARTITION BY market), 6) AS shrink FROM g"""


def walk_folds(spark, sf):
    f = FO.make_folds(_bets(spark, sf))
    return f.select(F.col("fold").cast("bigint").alias("fold"), *[F.col(c).cast("string").alias(c) for c in ("train_end", "test_start", "test_end")])


_FOLDS = f"""{B}, e AS (SELECT CAST(min(game_date) AS DATE) + 400 AS lo, CAST(max(game_date) AS DATE) AS hi FROM bets_v),
f AS (SELECT CAST(i AS BIGINT) AS fold, lo + CAST(45 * i AS INT) - 1 AS train_end, lo + CAST(45 * i AS INT) AS test_start, least(lo + CAST(45 * i AS INT) + 44, hi) AS test_end FROM e, range(1000) t(i) WHERE lo + CAST(45 * i AS INT) <= hi)"""
FOLDS_SQL = f"{_FOLDS} SELECT fold, CAST(train_end AS VARCHAR) AS train_end, CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end FROM f"


def fold_slices(spark, sf):
    b = _bets(spark, sf)
    d = FO.fold_sizes(b, FO.make_folds(b))
    return d.select(F.col("fold").cast("bigint").alias("fold"), "train_rows", "test_rows")


SLICES_SQL = f"""{_FOLDS} SELECT f.fold, count(*) FILTER (WHERE CAST(game_date AS DATE) <= train_end) AS train_rows,
  count(*) FILTER (WHERE CAST(game_date AS DATE) BETWEEN test_start AND test_end) AS test_rows FROM f, bets_v GROUP BY f.fold"""


def threshold_grid(spark, sf):
    g = E.threshold_grid(_bets(spark, sf), M)
    return g.select("market", r6("t", "t"), "n", r6("roi", "roi"), r6("sd", "sd"), "n_games", r6("score", "score"))


_GRID = f"""{B}, g0 AS (SELECT market, i * 0.0025e0 AS t, count(*) AS n, avg(profit) AS roi, stddev_samp(profit) AS sd, count(DISTINCT event_id) AS n_games
  FROM bets_v JOIN range(64) x(i) ON ev >= i * 0.0025e0 GROUP BY ALL),
g AS (SELECT *, roi * sqrt(greatest(n_games, 1)) / CASE WHEN coalesce(sd, 0) > 1e-12 THEN sd ELSE 1 END AS score FROM g0),
th AS (SELECT market, coalesce(arg_max(t, score) FILTER (WHERE n >= 150 AND roi > 0), 0.03e0) AS threshold FROM g GROUP BY market)"""
GRID_SQL = f"{_GRID} SELECT market, round(t, 6) AS t, n, round(roi, 6) AS roi, round(sd, 6) AS sd, n_games, round(score, 6) AS score FROM g"


def threshold_defaults(spark, sf):
    """A market whose bets reach no cut, one in which no cut has a profit, and one without any bet."""
    b = _bets(spark, sf).withColumns({
        "ev": F.when(F.col("market") == "m1", F.col("ev") - 9).otherwise(F.col("ev")),
        "profit": F.when(F.col("market") == "m2", F.lit(-1.0)).otherwise(F.col("profit"))})
    groups = b.select("market").distinct().union(spark.createDataFrame([("none",)], "market string"))
    thr = E.choose_thresholds(E.threshold_grid(b, M), M, bets=b, groups=groups)
    return thr.select("market", r6("threshold", "threshold"))


DEFAULTS_SQL = _GRID.replace("bets_v AS (", "bets0 AS (", 1).replace(", g0 AS (", """, bets_v AS (SELECT * REPLACE (CASE market WHEN 'm1' THEN ev - 9 ELSE ev END AS ev,
  CASE market WHEN 'm2' THEN -1.0e0 ELSE profit END AS profit) FROM bets0), g0 AS (""", 1) + """
SELECT market, round(coalesce(threshold, 0.03e0), 6) AS threshold FROM (SELECT DISTINCT market FROM bets_v) LEFT JOIN th USING (market) UNION ALL SELECT 'none', 0.02e0"""


def segment_filter(spark, sf):
    """Segments that may bet at the chosen threshold of their market."""
    b = _bets(spark, sf)
    thr = E.choose_thresholds(E.threshold_grid(b, M), M)
    sel = b.join(thr, M).filter("ev >= threshold")
    return E.profitable_segments(sel, M).join(thr.withColumn("threshold", r6("threshold")), M)


_SEG = f"""{_GRID}, sel AS (SELECT b.*, threshold, concat(anchor_src, '|', {BAND_SQL}) AS segment FROM bets_v b JOIN th USING (market) WHERE ev >= threshold),
sg AS (SELECT market, segment FROM sel GROUP BY ALL HAVING count(*) < 250 OR avg(profit) > 0)"""
SEGMENT_SQL = f"{_SEG} SELECT DISTINCT market, segment, round(threshold, 6) AS threshold FROM sg JOIN th USING (market)"


def one_bet(spark, sf):
    """Stakeable bets that clear their threshold in an allowed segment, one per proposition."""
    b = _bets(spark, sf).filter(E.stakeable(F.col("price")) & F.col("result").isin("win", "loss", "push"))
    thr = E.choose_thresholds(E.threshold_grid(b, M), M)
    sel = b.join(thr, M).filter("ev >= threshold")
    sel = sel.withColumn("segment", P.segment(F.col("anchor_src"), F.col("price")))
    sel = sel.join(E.profitable_segments(sel, M), ["market", "segment"], "left_semi")
    d = E.one_bet(sel, ["event_id", "market", "subject_id"], "ev", ["bet_id"])
    return d.select("bet_id", "event_id", "market", "subject_id", "segment", r6("ev", "ev"), r6("profit", "profit"))


ONE_BET_SQL = f"""{_SEG}, ok AS (SELECT sel.*, row_number() OVER (PARTITION BY event_id, sel.market, subject_id ORDER BY ev DESC, bet_id) AS rn FROM sel SEMI JOIN sg ON sel.market = sg.market AND sel.segment = sg.segment WHERE price BETWEEN -2000 AND 2000)
SELECT bet_id, event_id, market, subject_id, segment, round(ev, 6) AS ev, round(profit, 6) AS profit FROM ok WHERE rn = 1"""


def _six(df, keys=("market",)):
    return df.select(*keys, *[r6(c, c) if t == "double" else c for c, t in df.dtypes if c not in keys])


def bet_summary(spark, sf):
    return _six(E.bet_summary(_bets(spark, sf), M, TEST_BOOKS))


_SUMMARY = """SELECT market, count(*) AS n_bets, avg(profit) AS roi, sum(profit) AS profit, count(*) FILTER (WHERE result = 'win') / nullif(count(*) FILTER (WHERE result IN ('win', 'loss')), 0) AS hit_rate,
  avg(price) AS avg_price, avg(ev) AS avg_ev, count(*) FILTER (WHERE result = 'win') AS n_win, count(*) FILTER (WHERE result = 'loss') AS n_loss, count(*) FILTER (WHERE result = 'push') AS n_push,
  count(DISTINCT event_id) AS n_games, count(*) FILTER (WHERE major) AS n_major, avg(CASE WHEN major THEN profit END) AS roi_major FROM bets_v JOIN books USING (book) GROUP BY market"""
SUMMARY_SQL = f"""{B}, {BOOKS_CTE}, s AS ({_SUMMARY}) SELECT market, n_bets, round(roi, 6) AS roi, round(profit, 6) AS profit, round(hit_rate, 6) AS hit_rate, round(avg_price, 6) AS avg_price, round(avg_ev, 6) AS avg_ev,
  n_win, n_loss, n_push, n_games, n_major, round(roi_major, 6) AS roi_major FROM s"""


def fold_stability(spark, sf):
    return _six(E.stability(_bets(spark, sf), M))


_STAB = """SELECT market, count(*) AS n_folds, avg(CASE WHEN roi > 0 THEN 1.0e0 ELSE 0.0e0 END) AS fold_win_rate, CASE WHEN sum(p) > 0 THEN max(p) / sum(p) END AS max_fold_share
  FROM (SELECT market, fold, avg(profit) AS roi, sum(profit) AS p FROM bets_v GROUP BY ALL) GROUP BY market"""
STABILITY_SQL = f"{B}, s AS ({_STAB}) SELECT market, n_folds, round(fold_win_rate, 6) AS fold_win_rate, round(max_fold_share, 6) AS max_fold_share FROM s"


def calibration_bins(spark, sf):
    return _six(E.calibration_bins(_steady(_bets(spark, sf)), M).withColumn("bin", F.col("bin").cast("bigint")), ("market", "bin"))


_BINS = """b9 AS (SELECT * REPLACE (round(p_model, 9) AS p_model) FROM bets_v),
ed AS (SELECT market, list_sort(list_distinct(quantile_cont(p_model, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM b9 WHERE result IN ('win', 'loss') GROUP BY market),
cb AS (SELECT market, bin, count(*) AS n, avg(p_model) AS pred, avg(CASE result WHEN 'win' THEN 1.0e0 ELSE 0.0e0 END) AS actual FROM
  (SELECT b.*, len(list_filter(e[2:len(e) - 1], lambda x: p_model > x)) AS bin FROM b9 b JOIN ed USING (market) WHERE result IN ('win', 'loss')) GROUP BY ALL)"""
_CAL = "SELECT market, sum(n * abs(pred - actual)) / sum(n) AS cal_error, sum(n * sqrt(2 * pred * (1 - pred) / (pi() * n))) / sum(n) AS cal_noise_floor FROM cb GROUP BY market"
BINS_SQL = f"{B}, {_BINS} SELECT market, CAST(bin AS BIGINT) AS bin, n, round(pred, 6) AS pred, round(actual, 6) AS actual FROM cb"


def cal_error(spark, sf):
    return _six(E.calibration_error(E.calibration_bins(_steady(_bets(spark, sf)), M), M))


CAL_SQL = f"{B}, {_BINS}, c AS ({_CAL}) SELECT market, round(cal_error, 6) AS cal_error, round(cal_noise_floor, 6) AS cal_noise_floor FROM c"


def recent_decay(spark, sf):
    return _six(E.recent(_bets(spark, sf), M))


_RECENT = """rk AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY CAST(game_date AS DATE), bet_id) AS rk, count(*) OVER (PARTITION BY market) AS gn FROM bets_v),
rc AS (SELECT market, count(*) AS recent_n, avg(profit) AS recent_roi, count(*) >= 60 AND avg(profit) + stddev_samp(profit) / sqrt(count(*)) < 0 AS decayed
  FROM rk WHERE rk > gn - greatest(floor(gn * (1.0e0 / 3.0e0)), 1) GROUP BY market)"""
RECENT_SQL = f"{B}, {_RECENT} SELECT market, recent_n, round(recent_roi, 6) AS recent_roi, decayed FROM rc"


def latest_rows(spark, sf):
    """Training-window cap: the most recent rows of each market."""
    return E.most_recent(_bets(spark, sf), M, 3000, "bet_id").select("bet_id", "market")


LATEST_ROWS_SQL = f"{B}, {_RECENT} SELECT bet_id, market FROM rk WHERE rk > gn - 3000"


def breakdowns(spark, sf):
    return _six(E.breakdowns(_bets(spark, sf)), ("market", "breakdown", "value"))


BREAKDOWN_SQL = f"""{B}, d AS (SELECT market, 'fold' AS breakdown, CAST(fold AS VARCHAR) AS value, profit FROM bets_v UNION ALL SELECT market, 'book', book, profit FROM bets_v
  UNION ALL SELECT market, 'anchor', anchor_src, profit FROM bets_v),
g AS (SELECT market, breakdown, value, count(*) AS n, avg(profit) AS roi, sum(profit) AS profit FROM d GROUP BY ALL)
SELECT market, breakdown, value, n, round(roi, 6) AS roi, round(profit, 6) AS profit FROM g WHERE breakdown <> 'book' OR n >= 10"""


def cluster_bootstrap(spark, sf):
    return _six(E.bootstrap(_bets(spark, sf), M, 4000).drop("p_value"))


def boot_pvalue(spark, sf):
    return _six(E.bootstrap(_bets(spark, sf), M, 8000).select("market", "roi", "p_value"))


def _boot(n):
    cuts = " ".join(f"WHEN u < {c}e0 THEN {k}" for k, c in enumerate(E.POISSON_CDF))
    return f"""cl AS (SELECT market, event_id AS c, sum(profit) AS s, count(*) AS n FROM bets_v GROUP BY ALL),
hh AS (SELECT cl.*, rep, (c * 7919 + rep * 104729) % 1000003 AS h FROM cl, range({n}) t(rep)), hg AS (SELECT *, (h * h + c * 31 + rep * 17 + 11) % 1000003 AS g FROM hh),
hw AS (SELECT market, rep, s, n, ((g * g + h * 7 + rep) % 1000003) / 1000003.0e0 AS u FROM hg),
rp AS (SELECT market, rep, sum(w * s) / sum(w * n) AS r FROM (SELECT *, CASE {cuts} ELSE 6 END AS w FROM hw) GROUP BY ALL),
pt AS (SELECT market, sum(s) / sum(n) AS roi, count(*) AS n_clusters FROM cl GROUP BY market),
bt AS (SELECT market, roi, n_clusters, CASE WHEN n_clusters >= 20 THEN quantile_cont(r, 0.025) END AS roi_lo, CASE WHEN n_clusters >= 20 THEN quantile_cont(r, 0.975) END AS roi_hi,
   CASE WHEN n_clusters >= 20 THEN avg(CASE WHEN r - roi >= roi THEN 1.0e0 ELSE 0.0e0 END) ELSE 1 END AS p_value FROM rp JOIN pt USING (market) GROUP BY market, roi, n_clusters)"""


BOOT_SQL = f"{B}, {_boot(4000)} SELECT market, round(roi, 6) AS roi, round(roi_lo, 6) AS roi_lo, round(roi_hi, 6) AS roi_hi, n_clusters FROM bt"
PVALUE_SQL = f"{B}, {_boot(8000)} SELECT market, round(roi, 6) AS roi, round(p_value, 6) AS p_value FROM bt"


def _signals(spark, sf):
    b = _bets(spark, sf).filter("result <> 'push'").select(
        "market", "bet_id", E.won_flag(F.col("result")).alias("won"), P.logit(F.col("p_raw")).alias("lc"), F.col("n_books_cons").alias("n_books_prop"), F.col("ev").alias("tm_edge"),
        (F.col("profit") + F.pmod("bet_id", F.lit(7)) * 0.3).alias("bat_leak"), F.when(F.col("lead_min") > 30, F.col("lead_min")).alias("lead_min"))
    return A.signal_table(b, ["n_books_prop", "tm_edge", "bat_leak", "lead_min"], M, "won", "lc", "bet_id")


def stratified_auc(spark, sf):
    return _six(_signals(spark, sf), ("market", "feature"))


_SIG = f"""{B}, b0 AS (SELECT market, bet_id, CASE result WHEN 'win' THEN 1 ELSE 0 END AS won, {LOGIT.format('p_raw')} AS lc, n_books_cons AS n_books_prop, ev AS tm_edge,
  profit + (bet_id % 7) * 0.3e0 AS bat_leak, CASE WHEN lead_min > 30 THEN lead_min END AS lead_min FROM bets_v WHERE result <> 'push'),
lg AS (SELECT * FROM (UNPIVOT b0 ON n_books_prop, tm_edge, bat_leak, lead_min INTO NAME feature VALUE x) WHERE x IS NOT NULL),
nt AS (SELECT *, ntile(20) OVER (PARTITION BY market, feature ORDER BY lc, bet_id) AS st FROM lg),
rk AS (SELECT *, rank() OVER (PARTITION BY market, feature, st ORDER BY x) + (count(*) OVER (PARTITION BY market, feature, st, x) - 1) / 2.0e0 AS r FROM nt),
su AS (SELECT market, feature, st, count(*) AS n, sum(won) AS n1, count(*) - sum(won) AS n0, sum(CASE won WHEN 1 THEN r END) AS sr FROM rk GROUP BY ALL),
sa AS (SELECT market, feature, sum(n) AS n, sum(CASE WHEN n >= 50 AND n1 > 0 AND n0 > 0 THEN sr - n1 * (n1 + 1) / 2.0e0 END) / sum(CASE WHEN n >= 50 AND n1 > 0 AND n0 > 0 THEN n1 * n0 END) AS a FROM su GROUP BY ALL),
sg AS (SELECT market, feature, CAST(n AS BIGINT) AS n, greatest(coalesce(a, 0.5e0), 1 - coalesce(a, 0.5e0)) AS auc FROM sa WHERE n >= 500)"""
AUC_SQL = f"{_SIG} SELECT market, feature, n, round(auc, 6) AS auc FROM sg"


def conditional_signal(spark, sf):
    return _six(A.conditional_signal(_signals(spark, sf), M), ("market", "check_name", "severity", "detail"))


SIGNAL_SQL = f"""{_SIG}, v AS (SELECT *, feature LIKE 'bat\\_%' ESCAPE '\\' OR feature LIKE 'tm\\_%' ESCAPE '\\' AS vetoable FROM sg),
w AS (SELECT market, max(CASE WHEN auc > 0.5e0 THEN auc END) AS auc, arg_max(feature, auc) FILTER (WHERE auc > 0.5e0) AS detail, arg_max(vetoable, auc) FILTER (WHERE auc > 0.5e0) AS vt, count(*) FILTER (WHERE auc >= 0.6e0 AND NOT vetoable) AS n FROM v GROUP BY market)
SELECT market, 'conditional_signal' AS check_name, CASE WHEN auc IS NULL THEN 'ok' WHEN auc >= 0.7e0 AND vt THEN 'veto' WHEN auc >= 0.6e0 THEN 'warn' ELSE 'ok' END AS severity, detail, round(auc, 6) AS auc, n FROM w"""


def audit_timing(spark, sf):
    q = view(spark, sf, "quotes_v")
    late = q.withColumn("lead_min", F.col("lead_min") - 25)
    return A.quote_timing(q).unionByName(A.quote_timing(late))


TIMING_SQL = f"""{ctes('quotes_v')} SELECT 'quote_timing' AS check_name, 'ok' AS severity, concat('minimum lead ', CAST(round(min(lead_min), 1) AS VARCHAR), ' min') AS detail, count(*) AS n FROM quotes_v
UNION ALL SELECT 'quote_timing', 'veto', concat(CAST(count(*) AS VARCHAR), ' quotes at or after the start'), count(*) FROM quotes_v WHERE lead_min - 25 <= 0"""


def audit_fold(spark, sf):
    b = _bets(spark, sf)
    clean = A.fold_boundary(b.filter("game_date < '1998-01-01'"), b.filter("game_date >= '1998-01-01'"))
    return clean.unionByName(A.fold_boundary(b.filter("game_date < '1998-01-03'"), b.filter("game_date >= '1998-01-01'")))


AUDIT_FOLD_SQL = f"""{B}, c AS (SELECT count(*) FILTER (WHERE game_date < TIMESTAMP '1998-01-03') AS n FROM bets_v WHERE game_date >= TIMESTAMP '1998-01-01')
SELECT 'fold_boundary' AS check_name, 'ok' AS severity, '0 training rows from the first test date on' AS detail, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'fold_boundary', 'veto', concat(CAST(n AS VARCHAR), ' training rows from the first test date on'), n FROM c"""


def audit_asof(spark, sf, whole=False):
    """As-of audit of an honest rolling mean and of one whose window includes the current row, as one bundle."""
    from pyspark.sql.window import Window

    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    good = FM.lagged_form(e, "user_id", "ts", "event_id", ["value"], (10,), "f_").withColumnRenamed("f_value_r10", "bat_value_r10")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    leaky = e.withColumn("bat_leaky_r10", F.when(F.count("value").over(w) >= 2, F.avg("value").over(w)))
    order = [F.pmod(F.col("event_id") * 48271, F.lit(1000003)), F.col("event_id")]
    how = {} if whole else {"order": order, "n_sample": 300}
    found = [A.feature_asof(d, e, "user_id", "ts", "event_id", "value", f, 10, **how) for d, f in ((good, "bat_value_r10"), (leaky, "bat_leaky_r10"))]
    return A.audit(*found)


def audit_asof_all(spark, sf):
    """The same audit over every row."""
    return audit_asof(spark, sf, whole=True)


def _asof_sql(i, feature, frame):
    return f"""s{i} AS (SELECT user_id, ts, event_id, f AS got FROM (SELECT *, CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {frame}))
   WHERE f IS NOT NULL ORDER BY (event_id * 48271) % 1000003, event_id LIMIT 300),
r{i} AS (SELECT s.*, (SELECT CASE WHEN count(value) >= 2 THEN avg(value) END FROM (SELECT value FROM events e WHERE e.user_id = s.user_id AND (e.ts, e.event_id) < (s.ts, s.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 10)) AS prior,
   (SELECT avg(value) FROM (SELECT value FROM events e WHERE e.user_id = s.user_id AND (e.ts, e.event_id) <= (s.ts, s.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 10)) AS incl FROM s{i} s),
c{i} AS (SELECT 'asof::{feature}' AS check_name, count(*) AS checked, count(*) FILTER (WHERE abs(prior - got) > 1e-6 + 1e-4 * abs(got)) AS bad,
   count(*) FILTER (WHERE abs(prior - got) > 1e-6 + 1e-4 * abs(got) AND abs(incl - got) <= 1e-6 + 1e-4 * abs(got)) AS future FROM r{i} WHERE prior IS NOT NULL)"""


ASOF_SQL = f"""WITH {_asof_sql(1, 'bat_value_r10', '10 PRECEDING AND 1 PRECEDING')}, {_asof_sql(2, 'bat_leaky_r10', '9 PRECEDING AND CURRENT ROW')},
u AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
f AS (SELECT check_name, CASE WHEN checked > 0 AND future >= greatest(5, 0.02 * checked) THEN 'veto' WHEN checked = 0 OR future > 0 OR bad > 0 THEN 'warn' ELSE 'ok' END AS severity,
  concat(checked, ' checked, ', bad, ' differ, ', future, ' match a window with the current row') AS detail, CASE WHEN future > 0 THEN future WHEN bad > 0 THEN bad ELSE checked END AS n FROM u)
SELECT *, max(CASE WHEN severity = 'veto' THEN 1 ELSE 0 END) OVER () = 1 AS vetoed FROM f"""


ASOF_ALL_SQL = """WITH w AS (SELECT *, count(value) OVER p AS np, avg(value) OVER p AS ap, count(value) OVER c AS nc, avg(value) OVER c AS ac FROM events
  WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
k AS (SELECT CASE WHEN np >= 2 THEN ap END AS prior, CASE WHEN nc >= 2 THEN ac END AS incl FROM w),
g AS (SELECT 'asof::bat_value_r10' AS check_name, prior, incl, prior AS got FROM k UNION ALL SELECT 'asof::bat_leaky_r10', prior, incl, incl FROM k),
u AS (SELECT check_name, count(*) AS checked, count(*) FILTER (WHERE abs(prior - got) > 1e-6 + 1e-4 * abs(got)) AS bad,
  count(*) FILTER (WHERE abs(prior - got) > 1e-6 + 1e-4 * abs(got) AND abs(incl - got) <= 1e-6 + 1e-4 * abs(got)) AS future FROM g WHERE prior IS NOT NULL AND got IS NOT NULL GROUP BY 1),
f AS (""" + ASOF_SQL.split("f AS (", 1)[1]


def bh_family(spark, sf):
    """False-discovery correction over the books as a family of tests."""
    p = E.bootstrap(_bets(spark, sf).filter("ev >= 0.02"), ["book"], 8000)
    d = E.benjamini_hochberg(p.select("book", "p_value"), 0.6, "book")
    return d.select("book", r6("p_value", "p_value"), "survives")


BH_SQL = f"""{B.replace("bets_v AS (", "bets0 AS (")}, bets_v AS (SELECT * EXCLUDE (market), book AS market FROM bets0 WHERE ev >= 0.02e0), {_boot(8000)},
r AS (SELECT market AS book, p_value, row_number() OVER (ORDER BY p_value, market) AS i, count(*) OVER () AS m FROM bt),
k AS (SELECT *, max(CASE WHEN p_value <= 0.6e0 * i / m THEN i END) OVER () AS top FROM r)
SELECT book, round(p_value, 6) AS p_value, i <= coalesce(top, 0) AS survives FROM k"""


def _gate(spark, sf, n_boot=8000):
    b = materialise(_steady(_bets(spark, sf)).withColumns({
        "subject": F.col("subject_id").cast("string"), "line": F.lit(None).cast("double"), "side": F.lit("over")}), "bets")
    close = b.filter("bet_id % 3 = 0").withColumn("p", F.col("p_raw") + 0.004 * (F.pmod("bet_id", F.lit(7)) - 2))
    close = close.withColumn("price", P.american_from_prob(F.col("p"))).withColumn("tag", F.lit("closing"))
    clv = MV.closing_value(b, close, M)
    m = G.metrics(b, clv, TEST_BOOKS, n_boot)
    return G.judge(m, b.filter("market = 'm10'").select("market"))


def gate_verdicts(spark, sf):
    v = G.apply_family_correction(_gate(spark, sf))
    return v.select("market", "verdict", "cause", "deployment", "n_bets", "n_games", r6("roi", "roi"), r6("roi_lo", "roi_lo"), r6("p_value", "p_value"), "clv_n", r6("clv_mean", "clv_mean"),
                    r6("fold_win_rate", "fold_win_rate"), r6("recent_roi", "recent_roi"), r6("cal_error", "cal_error"), r6("cal_bar", "cal_bar"),
                    F.array_join(F.array_sort(F.map_keys(F.map_filter("checks", lambda k, ok: ~ok))), ",").alias("failed"))


_GATE = f"""{B}, {BOOKS_CTE}, {_BINS}, {_RECENT}, {_boot(8000)}, sm AS ({_SUMMARY}), sb AS ({_STAB}), ce AS ({_CAL}),
cp AS (SELECT event_id, subject_id, market, book, max(CASE WHEN 1 / p >= 2 THEN (1 / p - 1) * 100 ELSE -100 / (1 / p - 1) END) AS cp FROM
  (SELECT *, p_raw + 0.004e0 * ((bet_id % 7) - 2) AS p FROM bets_v WHERE bet_id % 3 = 0) GROUP BY ALL),
cv AS (SELECT market, count(*) AS clv_n, avg({RAW.format('cp')} - {RAW.format('price')}) AS clv_mean FROM bets_v JOIN cp USING (event_id, subject_id, market, book) GROUP BY market),
mt AS (SELECT sm.* EXCLUDE (roi), bt.roi, roi_lo, p_value, n_folds, fold_win_rate, max_fold_share, cal_error, cal_noise_floor, greatest(0.035e0, 2 * cal_noise_floor) AS cal_bar, recent_roi, decayed, coalesce(clv_n, 0) AS clv_n, clv_mean
  FROM sm JOIN bt USING (market) JOIN sb USING (market) JOIN ce USING (market) JOIN rc USING (market) LEFT JOIN cv USING (market)),
ck AS (SELECT *, market <> 'm10' AS k1, n_bets >= 300 AND n_games >= 150 AS k2, roi > 0 AS k3, coalesce(roi_lo > 0, false) AS k4, clv_n < 100 OR clv_mean > 0 AS k5,
  n_folds >= 3 AND fold_win_rate >= 0.45 AND (max_fold_share IS NULL OR max_fold_share <= 0.6) AS k6, NOT decayed AS k7, cal_error <= cal_bar AS k8 FROM mt),
cs AS (SELECT *, CASE WHEN NOT k1 THEN 'leakage' WHEN NOT k2 THEN 'insufficient_sample' WHEN NOT k3 THEN 'negative_edge' WHEN NOT k4 THEN 'no_edge' WHEN NOT k5 THEN 'no_clv' WHEN NOT k6 THEN 'unstable'
  WHEN NOT k7 THEN 'edge_decayed' WHEN NOT k8 THEN 'miscalibrated' ELSE '' END AS c0 FROM ck),
pf AS (SELECT market, p_value, row_number() OVER (ORDER BY p_value, market) AS i, count(*) OVER () AS m FROM cs WHERE c0 = ''),
pk AS (SELECT market, i <= coalesce(max(CASE WHEN p_value <= 0.05e0 * i / m THEN i END) OVER (), 0) AS survives FROM pf),
fv AS (SELECT cs.*, CASE WHEN survives = false THEN 'family_wise' ELSE c0 END AS cause, survives FROM cs LEFT JOIN pk USING (market))"""
GATE_SQL = f"""{_GATE} SELECT market, CASE cause WHEN '' THEN 'PASS' WHEN 'leakage' THEN 'VETO' ELSE 'FAIL' END AS verdict, cause,
  CASE WHEN cause = '' THEN 'live' WHEN cause IN ('leakage', 'insufficient_sample', 'negative_edge') THEN 'killed' ELSE 'veto_filtered' END AS deployment,
  n_bets, n_games, round(roi, 6) AS roi, round(roi_lo, 6) AS roi_lo, round(p_value, 6) AS p_value, clv_n, round(clv_mean, 6) AS clv_mean, round(fold_win_rate, 6) AS fold_win_rate, round(recent_roi, 6) AS recent_roi,
  round(cal_error, 6) AS cal_error, round(cal_bar, 6) AS cal_bar,
  array_to_string(list_sort(list_filter([CASE WHEN NOT k1 THEN 'leakage' END, CASE WHEN NOT k2 THEN 'sample' END, CASE WHEN NOT k3 THEN 'roi_positive' END, CASE WHEN NOT k4 THEN 'roi_ci' END, CASE WHEN NOT k5 THEN 'clv' END,
    CASE WHEN NOT k6 THEN 'stability' END, CASE WHEN NOT k7 THEN 'no_decay' END, CASE WHEN NOT k8 THEN 'calibration' END, CASE WHEN survives = false THEN 'family_wise' END], lambda x: x IS NOT NULL)), ',') AS failed FROM fv"""


def feature_profile(spark, sf):
    b = _bets(spark, sf).select(
        F.when(F.col("market") == "m1", "batter_hits").when(F.col("market") == "m2", "pitcher_outs").when(F.col("market") == "m3", "totals").otherwise("other").alias("market"),
        F.col("p_raw").alias("p_primary"), F.lit(1.0).alias("hold_med"), F.when(F.col("fold") < 0, 1.0).alias("book_std"), F.col("ev").alias("bat_hits"), F.col("lead_min").alias("pit_outs"),
        F.when(F.col("anchor_src") == "ladder", F.col("price")).alias("park_runs"))
    return FR.select_features(FR.feature_profile(b, ["p_primary", "hold_med", "book_std", "bat_hits", "pit_outs", "park_runs"])).select("market", "feature", "n")


PROFILE_SQL = f"""{B}, b AS (SELECT CASE market WHEN 'm1' THEN 'batter_hits' WHEN 'm2' THEN 'pitcher_outs' WHEN 'm3' THEN 'totals' ELSE 'other' END AS market, CAST(p_raw AS DOUBLE) AS p_primary, 1.0e0 AS hold_med, CAST(NULL AS DOUBLE) AS book_std,
  CAST(ev AS DOUBLE) AS bat_hits, CAST(lead_min AS DOUBLE) AS pit_outs, CAST(CASE WHEN anchor_src = 'ladder' THEN price END AS DOUBLE) AS park_runs FROM bets_v),
l AS (UNPIVOT b ON p_primary, hold_med, book_std, bat_hits, pit_outs, park_runs INTO NAME feature VALUE x),
g AS (SELECT market, feature, count(x) AS n FROM l GROUP BY ALL HAVING count(DISTINCT x) > 1)
SELECT * FROM g WHERE feature = 'p_primary' OR (market = 'batter_hits' AND feature IN ('bat_hits', 'park_runs')) OR (market = 'pitcher_outs' AND feature IN ('pit_outs', 'park_runs')) OR (market = 'totals' AND feature = 'park_runs')"""

QUERIES = {
    "anchor_weights": anchor_weights, "consensus_schemes": consensus_schemes, "scheme_weights": scheme_weights, "shrink_grid": shrink_grid, "walk_folds": walk_folds, "fold_slices": fold_slices,
    "threshold_grid": threshold_grid, "threshold_defaults": threshold_defaults, "segment_filter": segment_filter, "one_bet": one_bet, "bet_summary": bet_summary, "fold_stability": fold_stability, "calibration_bins": calibration_bins,
    "cal_error": cal_error, "recent_decay": recent_decay, "latest_rows": latest_rows, "breakdowns": breakdowns, "cluster_bootstrap": cluster_bootstrap, "boot_pvalue": boot_pvalue,
    "stratified_auc": stratified_auc, "conditional_signal": conditional_signal, "audit_timing": audit_timing, "audit_fold": audit_fold, "audit_asof": audit_asof, "audit_asof_all": audit_asof_all, "bh_family": bh_family,
    "gate_verdicts": gate_verdicts, "feature_profile": feature_profile,
}
ORACLES = {
    "anchor_weights": ANCHOR_SQL, "consensus_schemes": SCHEMES_SQL, "scheme_weights": SCHEME_WEIGHTS_SQL, "shrink_grid": SHRINK_SQL, "walk_folds": FOLDS_SQL, "fold_slices": SLICES_SQL,
    "threshold_grid": GRID_SQL, "threshold_defaults": DEFAULTS_SQL, "segment_filter": SEGMENT_SQL, "one_bet": ONE_BET_SQL, "bet_summary": SUMMARY_SQL, "fold_stability": STABILITY_SQL, "calibration_bins": BINS_SQL,
    "cal_error": CAL_SQL, "recent_decay": RECENT_SQL, "latest_rows": LATEST_ROWS_SQL, "breakdowns": BREAKDOWN_SQL, "cluster_bootstrap": BOOT_SQL, "boot_pvalue": PVALUE_SQL,
    "stratified_auc": AUC_SQL, "conditional_signal": SIGNAL_SQL, "audit_timing": TIMING_SQL, "audit_fold": AUDIT_FOLD_SQL, "audit_asof": ASOF_SQL, "audit_asof_all": ASOF_ALL_SQL, "bh_family": BH_SQL,
    "gate_verdicts": GATE_SQL, "feature_profile": PROFILE_SQL,
}
