"""Proposition and candidate frames, the ladder and line movement."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import ATTACH_CTE, BOOKS_CTE, CONSENSUS_CTE, LOGIT, PAYOUT, RAW, TEST_BOOKS, ctes, r6, table, view
from catalog.form import _BAT, _PIT, _TEAM, _T, _A, _games, _roll_sql
from catalog.matching import MARKET_QUOTES
from quotelab.operators import consensus as C
from quotelab.operators import form as FM
from quotelab.operators import frames as FR
from quotelab.operators import ladder as L
from quotelab.operators import movement as MV
from quotelab.operators import settle as S
from quotelab.session import materialise

MIN_CELL, MIN_ROWS = 20, 100


def judged_quotes(spark, sf, tag=True):
    q = view(spark, sf, "quotes_v")
    if tag:
        q = q.filter("tag = 'decision'")
    j = C.attach_consensus(q, books=TEST_BOOKS)
    return S.settle_by_value(j, view(spark, sf, "stats_v").filter("event_id % 50 <> 0"))


def settled_props(spark, sf, j=None):
    j = judged_quotes(spark, sf) if j is None else j
    return FR.null_safe_join(FR.proposition_structure(j), FR.proposition_outcome(j), FR.PROPOSITION, "inner")


_J = f"""{ctes('quotes_v', 'stats_v')}, {BOOKS_CTE}, q AS (SELECT * FROM quotes_v WHERE tag = 'decision'), {CONSENSUS_CTE}, {ATTACH_CTE},
sv AS (SELECT * FROM stats_v WHERE event_id % 50 <> 0),
jd AS (SELECT j.*, stat_value, CASE WHEN stat_value IS NULL THEN 'void' WHEN stat_value = coalesce(line, 0.5e0) THEN 'push'
   WHEN (side = 'over') = (stat_value > coalesce(line, 0.5e0)) THEN 'win' ELSE 'loss' END AS result FROM judged j LEFT JOIN sv USING (event_id, market)),
ps AS (SELECT event_id, market, subject, line, median(p_cons) AS p_cons_med, max(n_books_prop) AS n_books_prop, median(hold_book) AS hold_med, max(lead_min) AS lead_min,
   count(*) AS n_quotes, stddev_samp(p_book_fair) AS book_std, min(p_book_fair) AS book_min, max(p_book_fair) AS book_max, count(p_book_fair) AS n_two_sided,
   max(p_book_fair) - min(p_book_fair) AS book_spread FROM jd GROUP BY ALL),
po AS (SELECT event_id, market, subject, line, CASE result WHEN 'win' THEN 1.0e0 ELSE 0.0e0 END AS won, stat_value FROM
   (SELECT event_id, market, subject, line, max(result) AS result, max(stat_value) AS stat_value FROM jd WHERE side = 'over' GROUP BY ALL) WHERE result IN ('win', 'loss')),
pp AS (SELECT ps.*, won, stat_value FROM ps JOIN po ON ps.event_id = po.event_id AND ps.market = po.market AND ps.line IS NOT DISTINCT FROM po.line),
prim AS (SELECT event_id, market, subject, line AS primary_line, p_cons_med AS p_primary, n_books_prop AS n_books_primary FROM
   (SELECT *, row_number() OVER (PARTITION BY event_id, market, subject ORDER BY coalesce(n_books_prop, 0) DESC, n_quotes DESC, line NULLS FIRST) AS rn
    FROM pp WHERE p_cons_med IS NOT NULL) WHERE rn = 1)"""


def prop_structure(spark, sf):
    d = FR.proposition_structure(judged_quotes(spark, sf))
    return d.select("event_id", "market", "line", r6("p_cons_med", "p_cons_med"), F.col("n_books_prop").cast("bigint").alias("n_books_prop"),
                    r6("hold_med", "hold_med"), "lead_min", "n_quotes", r6("book_std", "book_std"), r6("book_min", "book_min"), r6("book_max", "book_max"),
                    "n_two_sided", r6("book_spread", "book_spread"))


STRUCTURE_SQL = f"""{_J} SELECT event_id, market, line, round(p_cons_med, 6) AS p_cons_med, CAST(n_books_prop AS BIGINT) AS n_books_prop, round(hold_med, 6) AS hold_med,
  lead_min, n_quotes, round(book_std, 6) AS book_std, round(book_min, 6) AS book_min, round(book_max, 6) AS book_max, n_two_sided, round(book_spread, 6) AS book_spread FROM ps"""


def prop_outcome(spark, sf):
    return FR.proposition_outcome(judged_quotes(spark, sf)).drop("subject")


OUTCOME_SQL = f"{_J} SELECT event_id, market, line, won, stat_value FROM po"


def primary_line(spark, sf):
    return L.primary_lines(settled_props(spark, sf)).select(
        "event_id", "market", "primary_line", r6("p_primary", "p_primary"), F.col("n_books_primary").cast("bigint").alias("n_books_primary"))


PRIMARY_SQL = f"{_J} SELECT event_id, market, primary_line, round(p_primary, 6) AS p_primary, CAST(n_books_primary AS BIGINT) AS n_books_primary FROM prim"

_S = "greatest(least({0}, 5.0e0), -5.0e0)"
_L = f"""{_J},
gr AS (SELECT p.market, primary_line, p.stat_value, CAST(least(greatest(floor(({_S.format(LOGIT.format('p_primary'))} + 5) / 10 * 20), 0), 19) AS INT) AS bucket
  FROM (SELECT event_id, market, subject, max(stat_value) AS stat_value FROM pp GROUP BY ALL) p JOIN prim USING (event_id, market, subject) WHERE primary_line IS NOT NULL),
big AS (SELECT market, primary_line FROM gr GROUP BY ALL HAVING count(*) >= {2 * MIN_CELL}),
tg AS (SELECT market, line FROM pp WHERE line IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_ROWS}),
lad AS (SELECT gr.market, gr.primary_line, tg.line, bucket, avg(CASE WHEN stat_value > tg.line THEN 1.0e0 ELSE 0.0e0 END) AS p, count(*) AS n
  FROM gr JOIN big USING (market, primary_line) JOIN tg ON gr.market = tg.market GROUP BY ALL HAVING count(*) >= {MIN_CELL}),
rr AS (SELECT a.market, a.primary_line, a.line, a.bucket AS a, b.bucket AS b, (SELECT avg(c.p) FROM lad c WHERE c.market = a.market AND c.primary_line = a.primary_line
   AND c.line = a.line AND c.bucket BETWEEN a.bucket AND b.bucket) AS m
  FROM lad a JOIN lad b ON a.market = b.market AND a.primary_line = b.primary_line AND a.line = b.line AND a.bucket <= b.bucket),
iso AS (SELECT market, primary_line, line, i AS bucket, max(m) AS p FROM (
   SELECT l.market, l.primary_line, l.line, l.bucket AS i, rr.a, min(rr.m) AS m FROM lad l JOIN rr ON l.market = rr.market AND l.primary_line = rr.primary_line
     AND l.line = rr.line AND rr.a <= l.bucket AND rr.b >= l.bucket GROUP BY ALL) GROUP BY ALL),
sm AS (SELECT market, primary_line, line, bucket, min(p) OVER (PARTITION BY market, primary_line, bucket ORDER BY line ROWS UNBOUNDED PRECEDING) AS p FROM iso)"""


def ladder_fit(spark, sf):
    return L.fit(settled_props(spark, sf), MIN_CELL, MIN_ROWS).select("market", "primary_line", "line", F.col("bucket").cast("bigint").alias("bucket"), r6("p", "p"), "n")


LADDER_FIT_SQL = f"{_L} SELECT market, primary_line, line, CAST(bucket AS BIGINT) AS bucket, round(p, 6) AS p, n FROM lad"


def staged(spark, sf):
    """Judged quotes and the smoothed ladder, each written once because several branches read them."""
    j = materialise(judged_quotes(spark, sf), "judged")
    raw = materialise(L.fit(settled_props(spark, sf, j), MIN_CELL, MIN_ROWS), "ladder")
    return j, materialise(L.smooth(raw), "ladder-smooth")


def ladder_smooth(spark, sf):
    t = L.smooth(materialise(L.fit(settled_props(spark, sf), MIN_CELL, MIN_ROWS), "ladder"))
    return t.select("market", "primary_line", "line", F.col("bucket").cast("bigint").alias("bucket"), r6("p", "p"))


LADDER_SMOOTH_SQL = f"{_L} SELECT market, primary_line, line, CAST(bucket AS BIGINT) AS bucket, round(p, 6) AS p FROM sm"


def ladder_apply(spark, sf):
    """Model frame with ladder, anchor and log-odds of every decided proposition."""
    j, t = staged(spark, sf)
    d = FR.proposition_frame(j, t)
    return d.select("event_id", "market", "line", "primary_line", r6("p_ladder", "p_ladder"), r6("ladder_minus_cons", "ladder_minus_cons"),
                    "is_primary_line", "anchor_src", r6("p_anchor", "p_anchor"), r6("logit_cons", "logit_cons"), "won")


#: Interpolation written as a search for the neighbouring points, independent of the segment layout.
_APPLY = """{name} AS (SELECT r.*, CASE WHEN lo.x IS NULL THEN hi.p WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.p ELSE lo.p + (r.s - lo.x) / (hi.x - lo.x) * (hi.p - lo.p) END AS p_raw_ladder
  FROM {rows} r
  LEFT JOIN LATERAL (SELECT -5 + (bucket + 0.5e0) / 2 AS x, p FROM sm WHERE sm.market = r.market AND sm.primary_line = r.primary_line AND sm.line = r.line
     AND -5 + (bucket + 0.5e0) / 2 <= r.s ORDER BY bucket DESC LIMIT 1) lo ON true
  LEFT JOIN LATERAL (SELECT -5 + (bucket + 0.5e0) / 2 AS x, p FROM sm WHERE sm.market = r.market AND sm.primary_line = r.primary_line AND sm.line = r.line
     AND -5 + (bucket + 0.5e0) / 2 > r.s ORDER BY bucket LIMIT 1) hi ON true)"""
_FRAME = f"""{_L}, fr0 AS (SELECT pp.*, primary_line, p_primary, n_books_primary, {_S.format(LOGIT.format('p_primary'))} AS s FROM pp LEFT JOIN prim USING (event_id, market, subject)),
{_APPLY.format(name='fr1', rows='(SELECT * FROM fr0)')},
fr AS (SELECT *, CASE WHEN p_raw_ladder IS NOT NULL THEN least(greatest(p_raw_ladder, 1e-4), 1 - 1e-4) END AS p_ladder FROM fr1)"""
LADDER_APPLY_SQL = f"""{_FRAME}
SELECT event_id, market, line, primary_line, round(p_ladder, 6) AS p_ladder, round(CASE WHEN p_ladder IS NOT NULL AND p_cons_med IS NOT NULL THEN {LOGIT.format('p_ladder')} - {LOGIT.format('p_cons_med')} END, 6) AS ladder_minus_cons,
  CASE WHEN line = primary_line THEN 1.0e0 ELSE 0.0e0 END AS is_primary_line, CASE WHEN p_cons_med IS NULL THEN 'ladder' ELSE 'direct' END AS anchor_src,
  round(coalesce(p_cons_med, p_ladder), 6) AS p_anchor, round({LOGIT.format('coalesce(p_cons_med, p_ladder)')}, 6) AS logit_cons, won FROM fr WHERE coalesce(p_cons_med, p_ladder) IS NOT NULL"""


def candidate_frame(spark, sf):
    """Betting frame with ladder-filled anchors, joined to the features of its proposition."""
    j, t = staged(spark, sf)
    props = materialise(FR.proposition_frame(j, t), "props")
    c = FR.candidates(j, props, t, books=TEST_BOOKS)
    d = FR.candidate_features(c, props, ["hold_med", "n_quotes", "book_spread", "won"])
    return d.select("event_id", "market", "line", "side", "book", "price", "anchor_src", r6("p_cons", "p_cons"), F.col("n_books_cons").cast("bigint").alias("n_books_cons"),
                    r6("hold_med", "hold_med"), "n_quotes", r6("logit_cons", "logit_cons"), "won")


CANDIDATE_SQL = f"""{_FRAME},
keep AS (SELECT * FROM fr WHERE coalesce(p_cons_med, p_ladder) IS NOT NULL),
pg AS (SELECT event_id, market, subject, max(primary_line) AS primary_line, max(p_primary) AS p_primary, max(n_books_primary) AS n_books_primary FROM keep GROUP BY ALL),
pl AS (SELECT jd.event_id, jd.market, jd.subject, jd.book, median(p_cons) AS p_loo FROM jd JOIN pg USING (event_id, market, subject) WHERE jd.line = pg.primary_line GROUP BY ALL),
c0 AS (SELECT jd.*, primary_line, n_books_primary, coalesce(p_loo, p_primary) AS eff, {_S.format(LOGIT.format('coalesce(p_loo, p_primary)'))} AS s
  FROM jd JOIN books USING (book) LEFT JOIN pg USING (event_id, market, subject) LEFT JOIN pl USING (event_id, market, subject, book) WHERE can_bet),
{_APPLY.format(name='c1', rows='(SELECT * FROM c0 WHERE p_cons IS NULL AND eff IS NOT NULL)')},
c2 AS (SELECT event_id, market, subject, line, side, book, price, 'direct' AS anchor_src, p_cons AS pc, n_books_cons AS nb FROM c0 WHERE p_cons IS NOT NULL
  UNION ALL SELECT event_id, market, subject, line, side, book, price, 'ladder', least(greatest(p_raw_ladder, 1e-4), 1 - 1e-4), n_books_primary FROM c1 WHERE p_raw_ladder IS NOT NULL),
c3 AS (SELECT *, row_number() OVER (PARTITION BY event_id, market, line, side ORDER BY {PAYOUT.format('price')} DESC, book) AS rn FROM c2)
SELECT c.event_id, c.market, c.line, c.side, c.book, c.price, c.anchor_src, round(pc, 6) AS p_cons, CAST(nb AS BIGINT) AS n_books_cons, round(hold_med, 6) AS hold_med,
  n_quotes, round({LOGIT.format('pc')}, 6) AS logit_cons, won FROM c3 c JOIN keep k ON c.event_id = k.event_id AND c.market = k.market AND c.line IS NOT DISTINCT FROM k.line WHERE rn = 1"""


def feature_frame(spark, sf):
    """Star join of every form table onto player and game propositions, with projections and opposing starters."""
    p, g = view(spark, sf, "players_v"), _games(spark, sf)
    rows = spark.sql(MARKET_QUOTES, lineitem=table(spark, sf, "lineitem")).groupBy("game_id", "athlete_id", "market", "line").agg(F.count("*").alias("n_quotes"))
    d = FR.attach_features(rows, view(spark, sf, "games_v"), FM.batter_form(p, g), FM.pitcher_form(p, g), FM.team_form(p, g), FM.park_form(g), FM.game_context(g))
    num = ["bat_hits_ppa_r10", "pit_outs_r8", "tm_hits_ppa_r10", "park_total_runs_r30", "home_tg_runs_for_r10", "away_tg_won_r30",
           "opp_pit_outs_r8", "proj_mean", "line_minus_proj", "line_over_proj"]
    return d.select("game_id", "athlete_id", "market", "line", "n_quotes", "is_home_player", "has_opp_starter", "opp_athlete_id", *[r6(c, c) for c in num])


def _mix(stem, windows):
    cols = [f"{stem}_{w}" for w in windows]
    top = " + ".join(f"coalesce({c} * {w}e0, 0)" for c, w in zip(cols, (0.3, 0.5, 0.2)))
    mass = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}e0 END" for c, w in zip(cols, (0.3, 0.5, 0.2)))
    return f"(({top}) / nullif({mass}, 0))"


_EXACT = lambda s: s.replace("round(", "(").replace(", 6) AS", ") AS")
_PA = _mix("bat_pa", ("r10", "r30", "exp"))
_PROJ = "CASE market " + " ".join(f"WHEN '{m}' THEN {_mix(c, ('r10', 'r30', 'exp'))} * {_PA}" for m, c in FR.BATTER_RATE.items()) + " " + " ".join(
    f"WHEN '{m}' THEN {_mix(c, ('r3', 'r8', 'exp'))}" for m, c in FR.PITCHER_COUNT.items()) + " END"
FEATURE_SQL = (
    _TEAM.replace("b AS (SELECT *", "bb AS (SELECT *") + ", " + _PIT.split(",\nb AS ", 1)[1].join(["pb AS ", ""]) + f""",
g AS (SELECT game_id AS event_id, start_ts, venue, home_score + away_score AS total_runs FROM games_v),
gl AS (SELECT game_id AS event_id, start_ts, home_team AS team, 1 AS is_home, home_score AS runs_for, away_score AS runs_against FROM games_v
  UNION ALL SELECT game_id, start_ts, away_team, 0, away_score, home_score FROM games_v),
gc0 AS (SELECT *, CASE WHEN runs_for > runs_against THEN 1.0e0 ELSE 0.0e0 END AS won FROM gl),
gc AS (SELECT event_id, is_home, {_EXACT(_roll_sql(['runs_for', 'won'], (10, 30), 'tg_', _T, False))} FROM gc0),
ba AS (SELECT event_id, athlete_id, team, {_EXACT(_roll_sql(FM.BATTER_COLS, (10, 30), 'bat_', _A))} FROM bb),
pi AS (SELECT event_id, athlete_id, team, {_EXACT(_roll_sql(['outs', 'strike_outs'], (3, 8), 'pit_', _A))} FROM pb),
tf AS (SELECT event_id, team, {_EXACT(_roll_sql(['tm_hits_ppa'], (10,), '', _T, False))} FROM t),
pk AS (SELECT event_id, {_EXACT(_roll_sql(['total_runs'], (30,), 'park_', 'venue ORDER BY start_ts, event_id', False))} FROM g),
mq AS (SELECT game_id, athlete_id, market, line, count(*) AS n_quotes FROM ({MARKET_QUOTES.replace('{lineitem}', 'lineitem')}) GROUP BY ALL),
st AS (SELECT DISTINCT mq.game_id, mq.athlete_id, pi.team FROM mq JOIN pi ON mq.game_id = pi.event_id AND mq.athlete_id = pi.athlete_id WHERE market IN ('pitcher_strikeouts', 'pitcher_outs')),
j AS (SELECT mq.*, ba.team AS player_team, home_team, (SELECT min(st.athlete_id) FROM st WHERE st.game_id = mq.game_id AND st.team <> ba.team) AS opp_athlete_id,
   COLUMNS(ba.* EXCLUDE (event_id, athlete_id, team)), COLUMNS(pi.* EXCLUDE (event_id, athlete_id, team)), tm_hits_ppa_r10, park_total_runs_r30, h.tg_runs_for_r10 AS home_tg_runs_for_r10, a.tg_won_r30 AS away_tg_won_r30
  FROM mq LEFT JOIN games_v gv ON mq.game_id = gv.game_id LEFT JOIN ba ON mq.game_id = ba.event_id AND mq.athlete_id = ba.athlete_id
  LEFT JOIN pi ON mq.game_id = pi.event_id AND mq.athlete_id = pi.athlete_id LEFT JOIN tf ON mq.game_id = tf.event_id AND ba.team = tf.team
  LEFT JOIN pk ON mq.game_id = pk.event_id LEFT JOIN gc h ON mq.game_id = h.event_id AND h.is_home = 1 LEFT JOIN gc a ON mq.game_id = a.event_id AND a.is_home = 0),
pr AS (SELECT *, {_PROJ} AS proj_mean FROM j)
SELECT pr.game_id, pr.athlete_id, market, line, n_quotes, CASE WHEN player_team = home_team THEN 1.0e0 ELSE 0.0e0 END AS is_home_player,
  CASE WHEN opp_athlete_id IS NULL THEN 0.0e0 ELSE 1.0e0 END AS has_opp_starter, opp_athlete_id,
  round(CASE WHEN market LIKE 'batter%' OR market = 'runs_scored' THEN bat_hits_ppa_r10 END, 6) AS bat_hits_ppa_r10, round(CASE WHEN market LIKE 'pitcher%' THEN pr.pit_outs_r8 END, 6) AS pit_outs_r8,
  round(tm_hits_ppa_r10, 6) AS tm_hits_ppa_r10, round(park_total_runs_r30, 6) AS park_total_runs_r30, round(home_tg_runs_for_r10, 6) AS home_tg_runs_for_r10, round(away_tg_won_r30, 6) AS away_tg_won_r30,
  round(op.pit_outs_r8, 6) AS opp_pit_outs_r8, round(proj_mean, 6) AS proj_mean, round(line - proj_mean, 6) AS line_minus_proj, round(CASE WHEN proj_mean > 0 THEN line / proj_mean END, 6) AS line_over_proj
FROM pr LEFT JOIN pi op ON pr.game_id = op.event_id AND pr.opp_athlete_id = op.athlete_id""")


def opposing_entity(spark, sf):
    """Batting rows with the opposing starter of their game, starters taken from the quotes."""
    p = view(spark, sf, "players_v")
    q = spark.sql(MARKET_QUOTES, lineitem=table(spark, sf, "lineitem"))
    s = FR.starters_from_quotes(q).join(p.filter("grp = 'pitching'").select(F.col("event_id").alias("game_id"), "athlete_id", F.col("team").alias("pitcher_team")), ["game_id", "athlete_id"])
    rows = p.filter("grp = 'batting'").select(F.col("event_id").alias("game_id"), "athlete_id", "team")
    return FR.opposing(rows, s, "game_id", "team").withColumn("has_opp", F.col("opp_athlete_id").isNotNull())


OPPOSING_SQL = f"""{ctes('players_v')}, st AS (SELECT q.game_id, q.athlete_id, p.team, count(*) AS n_quotes FROM ({MARKET_QUOTES.replace('{lineitem}', 'lineitem')}) q
  JOIN players_v p ON q.game_id = p.event_id AND q.athlete_id = p.athlete_id AND grp = 'pitching' WHERE market IN ('pitcher_strikeouts', 'pitcher_outs') GROUP BY ALL),
r AS (SELECT b.event_id AS game_id, b.athlete_id, b.team, min(st.athlete_id) AS opp_athlete_id FROM players_v b LEFT JOIN st ON b.event_id = st.game_id AND st.team <> b.team WHERE grp = 'batting' GROUP BY ALL)
SELECT *, opp_athlete_id IS NOT NULL AS has_opp FROM r"""


def starter_counts(spark, sf):
    return FR.starters_from_quotes(spark.sql(MARKET_QUOTES, lineitem=table(spark, sf, "lineitem")))


STARTERS_SQL = f"""SELECT game_id, athlete_id, count(*) AS n_quotes FROM ({MARKET_QUOTES.replace('{lineitem}', 'lineitem')}) WHERE market IN ('pitcher_strikeouts', 'pitcher_outs') AND athlete_id IS NOT NULL GROUP BY ALL"""


def movement_asof(spark, sf):
    """Log-odds at checkpoints of each (user, type) series, each event a snapshot some minutes before the day's end."""
    e = table(spark, sf, "events")
    h = e.select(F.col("user_id").alias("event_id"), F.col("event_type").alias("market"), F.lit("game").alias("subject"), F.lit(None).cast("double").alias("line"),
                 ((F.pmod(F.col("event_id") * 7919, F.lit(800)) + 1) + F.col("event_id") / 1e7).alias("lead_min"), (0.05 + 0.9 * F.pmod(F.col("event_id") * 31, F.lit(997)) / 997).alias("p_cons_all"))
    d = MV.movement_features(h)
    return d.select(F.col("event_id").alias("user_id"), F.col("market").alias("event_type"), r6("l_decision", "l_decision"), r6("lead_decision", "lead_decision"),
                    *[r6(f"move_{c}m", f"move_{c}m") for c in MV.CHECKPOINTS], "n_snapshots")


MOVEMENT_SQL = f"""WITH h0 AS (SELECT user_id, event_type, ((event_id * 7919) % 800 + 1) + event_id / 1e7 AS lead_min, 0.05e0 + 0.9e0 * ((event_id * 31) % 997) / 997 AS p FROM events),
h AS (SELECT *, {LOGIT.format('p')} AS l FROM h0 WHERE lead_min <= 720),
f AS (SELECT user_id, event_type, arg_min(l, lead_min) AS l_decision, min(lead_min) AS lead_decision, {', '.join(f'arg_min(l, lead_min) FILTER (WHERE lead_min >= {c}) AS l_{c}' for c in MV.CHECKPOINTS)}, count(*) AS n_snapshots FROM h GROUP BY ALL)
SELECT user_id, event_type, round(l_decision, 6) AS l_decision, round(lead_decision, 6) AS lead_decision, {', '.join(f'round(l_decision - l_{c}, 6) AS move_{c}m' for c in MV.CHECKPOINTS)}, n_snapshots FROM f"""


def movement_frame(spark, sf):
    """Snapshot consensus of the quotes, its movement, joined to the proposition structure."""
    q = view(spark, sf, "quotes_v").filter("tag = 'decision'")
    k = F.col("src_order") % 4
    h = q.withColumns({"snapshot_ts": k.cast("string"), "lead_min": F.when(k == 0, 400.0).when(k == 1, 200.0).when(k == 2, 100.0).otherwise(30.0)})
    m = MV.movement_features(MV.consensus_history(h, books=TEST_BOOKS))
    props = q.select(*FR.PROPOSITION).distinct()
    d = FR.attach_movement(props, m)
    return d.select("event_id", "market", "line", *[r6(f"move_{c}m", f"move_{c}m") for c in MV.CHECKPOINTS], "n_snapshots")


_HIST = CONSENSUS_CTE.replace("event_id, market, subject, line, tag", "event_id, market, subject, line, snap")
MOVEMENT_FRAME_SQL = f"""{ctes('quotes_v')}, {BOOKS_CTE}, q AS (SELECT *, src_order % 4 AS snap FROM quotes_v WHERE tag = 'decision'), {_HIST},
h AS (SELECT DISTINCT event_id, market, line, CASE snap WHEN 0 THEN 400 WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE 30 END AS lead_min, {LOGIT.format('p_cons_all')} AS l FROM
  (SELECT event_id, market, line, snap, max(p_cons_all) AS p_cons_all FROM loo GROUP BY ALL) WHERE p_cons_all IS NOT NULL),
f AS (SELECT event_id, market, line, arg_min(l, lead_min) AS l0, {', '.join(f'arg_min(l, lead_min) FILTER (WHERE lead_min >= {c}) AS l_{c}' for c in MV.CHECKPOINTS)}, count(*) AS n_snapshots FROM h GROUP BY ALL),
p AS (SELECT DISTINCT event_id, market, line FROM q)
SELECT p.event_id, p.market, p.line, {', '.join(f'round(l0 - l_{c}, 6) AS move_{c}m' for c in MV.CHECKPOINTS)}, n_snapshots
FROM p LEFT JOIN f ON p.event_id = f.event_id AND p.market = f.market AND p.line IS NOT DISTINCT FROM f.line"""


def closing_value(spark, sf):
    q = view(spark, sf, "quotes_v")
    d = MV.closing_value(q.filter("tag = 'decision'"), q, ["market"])
    return d.select("market", "clv_n", r6("clv_mean", "clv_mean"), r6("beat_close", "beat_close"))


CLOSING_SQL = f"""{ctes('quotes_v')}, c AS (SELECT event_id, market, subject, line, side, book, max(price) AS cp FROM quotes_v WHERE tag = 'closing' GROUP BY ALL),
m AS (SELECT b.market, {RAW.format('cp')} - {RAW.format('b.price')} AS clv FROM quotes_v b JOIN c ON b.event_id = c.event_id AND b.market = c.market AND b.line IS NOT DISTINCT FROM c.line
  AND b.side = c.side AND b.book = c.book WHERE b.tag = 'decision')
SELECT market, count(*) AS clv_n, round(avg(clv), 6) AS clv_mean, round(avg(CASE WHEN clv > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS beat_close FROM m GROUP BY market"""

QUERIES = {
    "prop_structure": prop_structure, "prop_outcome": prop_outcome, "primary_line": primary_line, "ladder_fit": ladder_fit, "ladder_smooth": ladder_smooth,
    "ladder_apply": ladder_apply, "candidate_frame": candidate_frame, "prop_frame": feature_frame, "opposing_entity": opposing_entity, "starter_counts": starter_counts,
    "movement_asof": movement_asof, "movement_frame": movement_frame, "closing_value": closing_value,
}
ORACLES = {
    "prop_structure": STRUCTURE_SQL, "prop_outcome": OUTCOME_SQL, "primary_line": PRIMARY_SQL, "ladder_fit": LADDER_FIT_SQL, "ladder_smooth": LADDER_SMOOTH_SQL,
    "ladder_apply": LADDER_APPLY_SQL, "candidate_frame": CANDIDATE_SQL, "prop_frame": FEATURE_SQL, "opposing_entity": OPPOSING_SQL, "starter_counts": STARTERS_SQL,
    "movement_asof": MOVEMENT_SQL, "movement_frame": MOVEMENT_FRAME_SQL, "closing_value": CLOSING_SQL,
}
