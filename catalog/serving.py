"""Pick ledger, stored tables and JSON feeds."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import PAYOUT, TEST_BOOKS, ctes, r6, view
from catalog.evaluation import _GRID, M, _bets
from quotelab.operators import evaluate as E
from quotelab.operators.keys import first_per_key
from quotelab.plans import ledger as LG
from quotelab.session import materialise, scratch_dir
from quotelab.sources import tables as TB


def picks_v(spark, sf):
    b = _bets(spark, sf).filter("ev >= 0.02").withColumns({
        "game_date": F.to_date("game_date"), "subject": F.col("subject_id").cast("string"), "line": F.when(F.col("subject_id") % 3 > 0, F.col("subject_id") % 2 + 0.5),
        "side": F.when(F.col("event_id") % 2 == 0, "over").otherwise("under"), "p_cal": F.col("p_model"), "generated_at": F.col("bet_id")})
    return LG.stake(b)


PICKS = ctes("bets_v") + f""", pk0 AS (SELECT * REPLACE (CAST(game_date AS DATE) AS game_date), CAST(subject_id AS VARCHAR) AS subject, CASE WHEN subject_id % 3 > 0 THEN subject_id % 2 + 0.5e0 END AS line,
  CASE WHEN event_id % 2 = 0 THEN 'over' ELSE 'under' END AS side, bet_id AS generated_at,
  least(least(greatest(({PAYOUT.format('price')} * p_model - (1 - p_model)) / {PAYOUT.format('price')}, 0), 1), 0.02e0) AS kelly,
  round(100 * least(greatest(0.55e0 * least(greatest(ev / 0.12e0, 0), 1) + 0.32e0 * least(greatest((n_books_cons - 2) / 8, 0), 1) + 0.13e0 * least(greatest(1.2e0 - abs(lead_min - 60) / 240, 0.3e0), 1), 0), 1), 1) AS confidence
  FROM bets_v WHERE ev >= 0.02e0)"""


def pick_query(spark, sf):
    d = LG.pick_query(picks_v(spark, sf), min_confidence=30.0, tie=("bet_id",))
    e = LG.pick_query(picks_v(spark, sf), date="1998-03-03", market="m3", limit=20, tie=("bet_id",))
    return d.unionByName(e).select("bet_id", F.col("game_date").cast("string").alias("game_date"), "market", r6("ev", "ev"), r6("kelly", "kelly"))


PICK_SQL = f"""{PICKS}, a AS (SELECT * FROM pk0 WHERE game_date = (SELECT max(game_date) FROM pk0) AND confidence >= 30 ORDER BY ev DESC, bet_id LIMIT 500),
b AS (SELECT * FROM pk0 WHERE game_date = DATE '1998-03-03' AND market = 'm3' ORDER BY ev DESC, bet_id LIMIT 20), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT bet_id, CAST(game_date AS VARCHAR) AS game_date, market, round(ev, 6) AS ev, round(kelly, 6) AS kelly FROM u"""


def performance(spark, sf):
    d = LG.performance(picks_v(spark, sf))
    return d.select("market", "picks", r6("roi", "roi"), r6("profit", "profit"), r6("hit", "hit"))


PERFORMANCE_SQL = f"""{PICKS}, p AS (SELECT market, count(*) AS picks, avg(profit) AS roi, sum(profit) AS profit, avg(CASE result WHEN 'win' THEN 1.0e0 ELSE 0.0e0 END) AS hit FROM pk0 GROUP BY ROLLUP (market))
SELECT market, picks, round(roi, 6) AS roi, round(profit, 6) AS profit, round(hit, 6) AS hit FROM p"""

_RENAME = {"m0": "h2h", "m1": "spreads", "m2": "totals", "m3": "batter_hits", "m4": "batter_rbis", "m5": "batter_total_bases", "m6": "batter_home_runs"}


def market_status(spark, sf):
    """Manifest of a quick gate over seven markets, then the status of all eleven."""
    b = materialise(_bets(spark, sf).replace(_RENAME, subset=["market"]).filter(F.col("market").isin(*_RENAME.values())), "bets")
    s = E.bet_summary(b, M, TEST_BOOKS)
    v = s.withColumn("cause", F.when(F.col("roi") <= 0, "negative_edge").otherwise("no_edge"))
    v = v.withColumns({"verdict": F.lit("FAIL"), "deployment": F.when(F.col("cause") == "no_edge", "veto_filtered").otherwise("killed")})
    man = TB.manifest(v, E.choose_thresholds(E.threshold_grid(b, M), M))
    path = scratch_dir(spark, "manifest")
    man.write.parquet(path)
    return LG.market_status(spark, spark.read.parquet(path)).withColumn("threshold", r6("threshold"))


STATUS_SQL = f"""{_GRID.replace('bets_v AS (', 'bets0 AS (')}""".replace(", g0 AS (", f""", bets_v AS (SELECT * REPLACE (CASE market {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _RENAME.items())} END AS market) FROM bets0 WHERE market IN ({', '.join(f"'{k}'" for k in _RENAME)})), g0 AS (""", 1) + """,
s AS (SELECT market, avg(profit) AS roi FROM bets_v GROUP BY market),
m AS (SELECT market, CASE WHEN roi <= 0 THEN 'negative_edge' ELSE 'no_edge' END AS cause, CASE WHEN roi <= 0 THEN 'killed' ELSE 'veto_filtered' END AS deployment,
  round(CASE WHEN roi <= 0 THEN threshold ELSE greatest(threshold, 0.08e0) END, 4) AS threshold FROM s JOIN th USING (market)),
d(market, label, kind) AS (VALUES ('h2h', 'Moneyline', 'featured'), ('spreads', 'Run line', 'featured'), ('totals', 'Game total', 'featured'), ('batter_hits', 'Batter hits', 'prop'), ('batter_rbis', 'Batter RBIs', 'prop'),
  ('batter_total_bases', 'Batter total bases', 'prop'), ('batter_home_runs', 'Batter home runs', 'prop'), ('runs_scored', 'Batter runs scored', 'prop'), ('batter_strikeouts', 'Batter strikeouts', 'prop'),
  ('pitcher_strikeouts', 'Pitcher strikeouts', 'prop'), ('pitcher_outs', 'Pitcher outs', 'prop'))
SELECT d.market, label, kind, CASE WHEN m.market IS NULL THEN 'UNTESTED' ELSE 'FAIL' END AS verdict, coalesce(deployment, 'killed') AS deployment, round(threshold, 6) AS threshold, coalesce(cause, '') AS cause
FROM d LEFT JOIN m USING (market)"""


def ledger_health(spark, sf):
    d = LG.ledger_health(picks_v(spark, sf))
    return d.select("picks_total", "last_generated_at", "markets", r6("avg_ev", "avg_ev"), F.round("avg_confidence", 1).alias("avg_confidence"), r6("stake", "stake"), "dates_covered")


HEALTH_SQL = f"""{PICKS}, h AS (SELECT count(*) AS picks_total, max(generated_at) AS last_generated_at, count(DISTINCT market) AS markets, avg(ev) AS avg_ev, avg(confidence) AS avg_confidence, sum(kelly) AS stake,
  (SELECT string_agg(CAST(game_date AS VARCHAR), ',' ORDER BY game_date) FROM (SELECT DISTINCT game_date FROM pk0 ORDER BY game_date DESC LIMIT 7)) AS dates_covered FROM pk0)
SELECT picks_total, last_generated_at, markets, round(avg_ev, 6) AS avg_ev, round(avg_confidence, 1) AS avg_confidence, round(stake, 6) AS stake, dates_covered FROM h"""


def ledger_upsert(spark, sf):
    """Three sweeps into one ledger, the second repeated: later versions of a key win, other picks stay."""
    p = picks_v(spark, sf).withColumn("game_date", F.trunc("game_date", "month")).select(*LG.KEY, "bet_id", "generated_at", "ev")
    path = scratch_dir(spark, "ledger")
    for sweep in (0, 1, 1, 2):
        LG.upsert_picks(p.filter(F.col("bet_id") % 3 == sweep), path)
    d = LG.read_picks(spark, path)
    return d.select("bet_id", F.col("game_date").cast("string").alias("game_date"), "market", "subject", "line", "side", "book", r6("ev", "ev"))


UPSERT_SQL = f"""{PICKS}, k AS (SELECT *, date_trunc('month', game_date) AS mth, row_number() OVER (PARTITION BY date_trunc('month', game_date), market, subject, line, side, book ORDER BY generated_at DESC) AS rn FROM pk0)
SELECT bet_id, CAST(CAST(mth AS DATE) AS VARCHAR) AS game_date, market, subject, line, side, book, round(ev, 6) AS ev FROM k WHERE rn = 1"""


def pick_regrade(spark, sf):
    """New results over old ones; dates that were replaced are found by an anti-join."""
    p = first_per_key(picks_v(spark, sf), LG.KEY, [F.col("generated_at").desc()]).withColumn("stat_value", F.lit(None).cast("double"))
    old = p.withColumns({"result": F.when(F.col("bet_id") % 2 == 0, F.col("result")), "profit": F.when(F.col("bet_id") % 2 == 0, F.col("profit"))})
    new = p.filter("bet_id % 5 <> 0").withColumns({"result": F.lit("loss"), "profit": F.lit(-1.0), "stat_value": F.lit(2.0)})
    d = LG.regrade(old, new)
    ungraded = old.filter("result IS NULL").join(new.select("game_date").distinct(), "game_date", "left_anti").select("game_date").distinct()
    return d.join(ungraded.withColumn("stale", F.lit(True)), "game_date", "left").select("bet_id", "result", r6("profit", "profit"), "stat_value", F.coalesce("stale", F.lit(False)).alias("stale"))


REGRADE_SQL = f"""{PICKS}, k AS (SELECT *, row_number() OVER (PARTITION BY game_date, market, subject, line, side, book ORDER BY generated_at DESC) AS rn FROM pk0), p AS (SELECT * FROM k WHERE rn = 1),
st AS (SELECT DISTINCT game_date FROM p WHERE bet_id % 2 <> 0 AND game_date NOT IN (SELECT game_date FROM p WHERE bet_id % 5 <> 0))
SELECT bet_id, CASE WHEN bet_id % 5 <> 0 THEN 'loss' WHEN bet_id % 2 = 0 THEN result END AS result, round(CASE WHEN bet_id % 5 <> 0 THEN -1.0e0 WHEN bet_id % 2 = 0 THEN profit END, 6) AS profit,
  CASE WHEN bet_id % 5 <> 0 THEN 2.0e0 END AS stat_value, p.game_date IN (SELECT game_date FROM st) AS stale FROM p"""


def io_roundtrip(spark, sf):
    """Stage by season with a partition replaced, derived table by configuration, fitted table, CSV report."""
    base = scratch_dir(spark, "io")
    q = view(spark, sf, "quotes_v").withColumn("season", F.lit(2023) + F.col("day_no") % 4)
    TB.write_stage(q, f"{base}/quotes")
    TB.write_stage(q.filter("season = 2024 AND tag = 'decision'"), f"{base}/quotes")
    d = TB.read_seasons(spark, f"{base}/quotes", [2023, 2024, 2026])
    build = lambda: d.groupBy("season", "market", "tag").agg(F.count("*").alias("n"), F.sum("price").alias("price_sum"))
    TB.derived(spark, base, "counts", {"method": "shin"}, build)
    counts = TB.derived(spark, base, "counts", {"method": "shin"}, lambda: 1 / 0)
    TB.write_report(counts, f"{base}/report")
    back = TB.read_report(spark, f"{base}/report", "season int, market string, tag string, n bigint, price_sum double")
    empty = TB.read_fitted(spark, f"{base}/none", "market string, w double")
    return back.join(empty, "market", "left").select(F.col("season").cast("bigint").alias("season"), "market", "tag", "n", r6("price_sum", "price_sum"), "w")


IO_SQL = f"""{ctes('quotes_v')} SELECT CAST(2023 + day_no % 4 AS BIGINT) AS season, market, tag, count(*) AS n, round(sum(price), 6) AS price_sum, CAST(NULL AS DOUBLE) AS w FROM quotes_v
WHERE day_no % 4 <> 2 AND (day_no % 4 <> 1 OR tag = 'decision') GROUP BY ALL"""

QUERIES = {
    "pick_query": pick_query, "performance": performance, "market_status": market_status, "ledger_health": ledger_health,
    "ledger_upsert": ledger_upsert, "pick_regrade": pick_regrade, "io_roundtrip": io_roundtrip,
}
ORACLES = {
    "pick_query": PICK_SQL, "performance": PERFORMANCE_SQL, "market_status": STATUS_SQL, "ledger_health": HEALTH_SQL,
    "ledger_upsert": UPSERT_SQL, "pick_regrade": REGRADE_SQL, "io_roundtrip": IO_SQL,
}
