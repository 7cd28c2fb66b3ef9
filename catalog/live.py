"""Live features of unplayed games and grading of picks, over the adapters' games and players."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import PAYOUT, ctes, r6, view
from catalog.form import AS_OF
from catalog.matching import MATCH_SQL
from quotelab.plans import live as LV


def _games(spark, sf):
    return view(spark, sf, "games_v").withColumn("start_ts", F.col("start_ts").cast("timestamp"))


def _live_quotes(spark, sf):
    """Quotes on players of the games from the cut on: hits of batters, outs of the pitchers whose id is even."""
    g = _games(spark, sf).filter(F.col("start_ts") >= F.to_timestamp(F.lit(AS_OF))).select(F.col("game_id").alias("event_id"))
    p = view(spark, sf, "players_v").join(g, "event_id").filter("grp = 'batting' OR athlete_id % 2 = 0")
    n = F.explode(F.sequence(F.lit(1), 2 + F.col("athlete_id").cast("int") % 3)).alias("book_no")
    q = p.select("event_id", F.when(F.col("grp") == "batting", "batter_hits").otherwise("pitcher_outs").alias("market"),
                 F.concat(F.lit("P"), F.col("athlete_id").cast("string")).alias("subject"), F.lit(0.5).alias("line"), "athlete_id", n)
    return q.withColumns({"p_cons": 0.4 + F.col("book_no") * 0.01, "p_book_fair": 0.41 + F.col("book_no") * 0.01, "hold_book": F.lit(0.05),
                          "n_books_prop": F.lit(3.0), "lead_min": F.lit(40.0)})


def live_frame(spark, sf):
    games = _games(spark, sf)
    events = games.filter(F.col("start_ts") >= F.to_timestamp(F.lit(AS_OF))).select(F.col("game_id").alias("event_id"), "home_team", "away_team", "venue")
    d = LV.live_features(_live_quotes(spark, sf), events, view(spark, sf, "players_v"), games.withColumnRenamed("game_id", "event_id"), AS_OF)
    return d.select("event_id", "market", "subject", "athlete_id", "opp_athlete_id", "n_quotes", "is_home_player", "has_opp_starter", *[
        r6(c, c) for c in ("p_cons_med", "bat_hits_ppa_exp", "pit_outs_exp", "tm_hits_ppa_exp", "park_total_runs_exp", "home_tg_runs_for_exp", "away_tg_won_exp", "opp_pit_outs_exp")])


_PA = "greatest(coalesce(at_bats, 0) + coalesce(walks, 0), 0)"
LIVE_SQL = f"""{ctes('games_v', 'players_v')}, past AS (SELECT * FROM games_v WHERE start_ts < TIMESTAMP '{AS_OF}'), due AS (SELECT * FROM games_v WHERE start_ts >= TIMESTAMP '{AS_OF}'),
pp AS (SELECT p.*, past.start_ts, {_PA} AS pa FROM players_v p JOIN past ON p.event_id = past.game_id),
bt AS (SELECT athlete_id, arg_max(team, (start_ts, event_id)) AS team, CASE WHEN count(CASE WHEN pa > 0 THEN coalesce(hits, 0) / pa END) >= 3 THEN avg(CASE WHEN pa > 0 THEN coalesce(hits, 0) / pa END) END AS hits FROM pp WHERE grp = 'batting' GROUP BY 1),
pt AS (SELECT athlete_id, arg_max(team, (start_ts, event_id)) AS team, CASE WHEN count(outs) >= 3 THEN avg(outs) END AS outs FROM pp WHERE grp = 'pitching' GROUP BY 1),
tg AS (SELECT team, event_id, sum(hits) AS h, coalesce(sum(at_bats), 0) + coalesce(sum(walks), 0) AS pa FROM pp WHERE grp = 'batting' GROUP BY ALL),
tm AS (SELECT team, CASE WHEN count(CASE WHEN pa > 0 THEN coalesce(h, 0) / pa END) >= 3 THEN avg(CASE WHEN pa > 0 THEN coalesce(h, 0) / pa END) END AS hits FROM tg GROUP BY 1),
pk AS (SELECT venue, CASE WHEN count(*) >= 3 THEN avg(home_score + away_score) END AS runs FROM past GROUP BY 1),
sd AS (SELECT home_team AS team, home_score AS rf, CASE WHEN home_score > away_score THEN 1.0e0 ELSE 0.0e0 END AS won FROM past UNION ALL SELECT away_team, away_score, CASE WHEN away_score > home_score THEN 1.0e0 ELSE 0.0e0 END FROM past),
cx AS (SELECT team, CASE WHEN count(*) >= 3 THEN avg(rf) END AS rf, CASE WHEN count(*) >= 3 THEN avg(won) END AS won FROM sd GROUP BY 1),
lq AS (SELECT p.event_id, p.athlete_id, CASE grp WHEN 'batting' THEN 'batter_hits' ELSE 'pitcher_outs' END AS market, 2 + p.athlete_id % 3 AS n FROM players_v p JOIN due ON p.event_id = due.game_id WHERE grp = 'batting' OR p.athlete_id % 2 = 0),
st AS (SELECT lq.event_id, pt.team, min(lq.athlete_id) AS a FROM lq JOIN pt USING (athlete_id) WHERE market = 'pitcher_outs' AND pt.team IS NOT NULL GROUP BY ALL),
r AS (SELECT lq.*, due.*, bt.team AS pteam, bt.hits AS bhits FROM lq JOIN due ON lq.event_id = due.game_id LEFT JOIN bt USING (athlete_id)),
o AS (SELECT r.event_id, r.market, r.athlete_id, min(st.a) AS opp FROM r JOIN st ON r.event_id = st.event_id AND st.team <> r.pteam GROUP BY ALL)
SELECT r.event_id, r.market, concat('P', CAST(r.athlete_id AS VARCHAR)) AS subject, r.athlete_id, o.opp AS opp_athlete_id, r.n AS n_quotes,
  CASE WHEN pteam = home_team THEN 1.0e0 ELSE 0.0e0 END AS is_home_player, CASE WHEN o.opp IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END AS has_opp_starter,
  round(0.4e0 + 0.01e0 * (r.n + 1) / 2, 6) AS p_cons_med, round(CASE r.market WHEN 'batter_hits' THEN bhits END, 6) AS bat_hits_ppa_exp, round(CASE r.market WHEN 'pitcher_outs' THEN pt.outs END, 6) AS pit_outs_exp,
  round(tm.hits, 6) AS tm_hits_ppa_exp, round(pk.runs, 6) AS park_total_runs_exp, round(ch.rf, 6) AS home_tg_runs_for_exp, round(ca.won, 6) AS away_tg_won_exp, round(po.outs, 6) AS opp_pit_outs_exp
FROM r LEFT JOIN o USING (event_id, market, athlete_id) LEFT JOIN pt ON r.athlete_id = pt.athlete_id LEFT JOIN tm ON tm.team = r.pteam LEFT JOIN pk ON pk.venue = r.venue
  LEFT JOIN cx ch ON ch.team = r.home_team LEFT JOIN cx ca ON ca.team = r.away_team LEFT JOIN pt po ON po.athlete_id = o.opp"""


def pick_grade(spark, sf):
    """Picks on players of matched and unmatched events, graded from the boxscores."""
    games = _games(spark, sf)
    shift = F.make_interval(mins=(F.col("game_id") % 7 * 10).cast("int"))
    events = games.select(F.col("game_id").alias("event_id"), "home_team", "away_team", (F.col("start_ts") + shift).alias("start_ts"))
    played = games.filter("game_id % 10 <> 0")
    p = view(spark, sf, "players_v")
    picks = p.select(
        "event_id", "athlete_id", F.to_date(F.lit("2024-01-01")).alias("game_date"), F.when(F.col("grp") == "batting", "batter_hits").otherwise("pitcher_outs").alias("market"),
        F.concat_ws("-", "event_id", "athlete_id").alias("subject"), (F.col("athlete_id") % 4).cast("double").alias("line"), F.when(F.col("athlete_id") % 2 == 0, "over").otherwise("under").alias("side"),
        F.lit("b1").alias("book"), F.when(F.col("event_id") % 2 == 0, 120.0).otherwise(-150.0).alias("price"), F.when(F.col("event_id") % 3 == 0, "win").alias("result"))
    d = LV.grade_picks(picks, events, played, p)
    return d.select("event_id", "athlete_id", "market", "result", r6("profit", "profit"), "stat_value")


GRADE_SQL = f"""{MATCH_SQL.replace('SELECT event_id, CASE WHEN claim', ', m AS (SELECT event_id, CASE WHEN claim', 1)}),
pl AS (SELECT *, coalesce(pitches_seen, 0) <= 0 AND coalesce(at_bats, 0) <= 0 AND coalesce(walks, 0) <= 0 AS idle FROM ({ctes('players_v')} SELECT * FROM players_v)),
mg AS (SELECT m.event_id, m.game_id FROM m WHERE game_id IS NOT NULL),
gk AS (SELECT p.*, mg.game_id, CASE WHEN b.grp = 'batting' AND NOT b.idle THEN b.hits WHEN b.grp = 'pitching' THEN b.outs END AS v, CAST(p.athlete_id % 4 AS DOUBLE) AS line, p.athlete_id % 2 = 0 AS over,
  CASE WHEN p.event_id % 2 = 0 THEN 120.0e0 ELSE -150.0e0 END AS price FROM pl p LEFT JOIN mg ON p.event_id = mg.event_id LEFT JOIN pl b ON b.event_id = mg.game_id AND b.athlete_id = p.athlete_id AND b.grp = p.grp),
gg AS (SELECT *, CASE WHEN game_id IS NULL THEN NULL WHEN v IS NULL THEN 'void' WHEN v = line THEN 'push' WHEN (v > line) = over THEN 'win' ELSE 'loss' END AS res FROM gk)
SELECT event_id, athlete_id, CASE grp WHEN 'batting' THEN 'batter_hits' ELSE 'pitcher_outs' END AS market, coalesce(res, CASE WHEN event_id % 3 = 0 THEN 'win' END) AS result,
  round(CASE res WHEN 'win' THEN {PAYOUT.format('price')} WHEN 'loss' THEN -1.0e0 WHEN 'push' THEN 0.0e0 WHEN 'void' THEN 0.0e0 END, 6) AS profit, CASE WHEN game_id IS NOT NULL THEN v END AS stat_value FROM gg"""

QUERIES = {"live_frame": live_frame, "pick_grade": pick_grade}
ORACLES = {"live_frame": LIVE_SQL, "pick_grade": GRADE_SQL}
