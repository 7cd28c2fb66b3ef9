"""Nested JSON feeds, written from the tables by Spark and read back through the scans."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import TEST_BOOKS, ctes, table, view
from quotelab.session import scratch_dir
from quotelab.sources import results as RS
from quotelab.sources import snapshots as SN

START = "2024-06-01 18:00:00"
#: Packed files cannot be split, so tasks write several of them. Packing with gzip took more time than making the documents.
PACKED = {"compression": "lz4", "maxRecordsPerFile": 100_000}


def _line_docs(spark, sf, main_totals=None):
    """One bookmaker with one market per lineitem row, as feed structs."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_suppkey") % 4
    key = F.when(k == 0, "h2h").when((k == 1) & (F.lit(False) if main_totals is None else main_totals), "totals").when(k == 1, "alternate_totals").when(k == 2, "batter_hits").otherwise("spreads")
    point = F.when(k == 0, None).when(k == 3, (F.col("l_partkey") % 5 - 2.5).cast("string")).otherwise((F.col("l_partkey") % 3 + 0.5).cast("string"))
    away_point = F.when(k == 3, (2.5 - F.col("l_partkey") % 5).cast("string")).otherwise(point)
    first = F.when(k % 3 == 0, "Home").otherwise("Over")
    second = F.when(k % 3 == 0, "Away").otherwise(F.when(F.col("l_linenumber") == 7, "exactly").otherwise(" no "))
    price = lambda m: F.when(F.col("l_orderkey") % 41 == 0, "-").otherwise((100 + F.col("l_partkey") * m % 150).cast("string"))
    desc = F.when(F.col("l_linenumber") == 6, " ").otherwise(F.concat(F.lit(" P"), F.col("l_partkey").cast("string")))
    oc = lambda n, p, pr: F.struct(n.alias("name"), desc.alias("description"), p.alias("point"), pr.alias("price"))
    snap = F.lit(START).cast("timestamp") - F.make_interval(mins=(F.col("l_orderkey") % 800 - 5).cast("int"))
    stamp = F.date_format(snap, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.date_format(F.lit(START).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    book = F.struct(F.concat(F.lit("b"), (F.col("l_suppkey") % 20).cast("string")).alias("key"), stamp.alias("last_update"), F.array(
        F.struct(key.alias("key"), F.array(oc(first, point, price(7)), oc(second, away_point, price(11))).alias("outcomes")),
        F.struct(F.lit("unknown_market").alias("key"), F.array(oc(first, point, price(7))).alias("outcomes"))).alias("markets"))
    event = F.struct(F.col("l_orderkey").cast("string").alias("id"), start.alias("commence_time"), F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"), F.array(book).alias("bookmakers"))
    region = F.when(F.col("l_partkey") % 3 == 0, "us").when(F.col("l_partkey") % 3 == 1, "eu").otherwise("us2")
    return li.select(stamp.alias("timestamp"), event.alias("event"), F.lit("decision").alias("tag"), region.alias("region"))


def _write(df, path):
    df.write.partitionBy("tag", "region").option("compression", "gzip").json(path)
    return path


def _out(q):
    return q.select("event_id", "market", "subject", "side", "line", "price", "book", "region", "lead_min", "tag", F.col("tier").cast("bigint").alias("tier"))


def snapshot_json(spark, sf):
    """Player and alternate-line quotes from per-event snapshots, duplicates across regions removed."""
    path = _write(_line_docs(spark, sf).withColumnRenamed("event", "data"), scratch_dir(spark, "event-snapshots"))
    return _out(SN.event_quotes(spark, path, books=TEST_BOOKS))


_LINES = f"""l AS (SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_suppkey % 4 AS k, l_linenumber AS ln, l_partkey AS pk, concat('b', CAST(l_suppkey % 20 AS VARCHAR)) AS book, l_suppkey % 20 % 4 AS tier,
  CASE l_partkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'eu' ELSE 'us2' END AS region, l_partkey % 3 AS ro, CAST(l_orderkey % 800 - 5 AS DOUBLE) AS lead_min, l_orderkey FROM lineitem WHERE l_orderkey % 41 <> 0),
s AS (SELECT *, true AS fst, 100 + pk * 7 % 150 + 0.0e0 AS price FROM l UNION ALL SELECT *, false, 100 + pk * 11 % 150 + 0.0e0 FROM l),
o AS (SELECT event_id, CASE k WHEN 0 THEN 'h2h' WHEN 1 THEN 'totals' WHEN 2 THEN 'batter_hits' ELSE 'spreads' END AS market, CASE k WHEN 2 THEN concat('P', CAST(pk AS VARCHAR)) ELSE 'game' END AS subject,
  CASE WHEN k % 3 = 0 THEN CASE WHEN fst THEN 'home' ELSE 'away' END ELSE CASE WHEN fst THEN 'over' ELSE 'under' END END AS side,
  CASE k WHEN 0 THEN NULL WHEN 3 THEN pk % 5 - 2.5e0 ELSE pk % 3 + 0.5e0 END AS line, price, book, region, ro, lead_min, tier, k, ln, fst, pk FROM s
  WHERE lead_min > 0 AND (k % 3 = 0 OR fst OR ln <> 7) AND (k <> 2 OR ln <> 6))"""
_DEDUP = "row_number() OVER (PARTITION BY event_id, market, subject, side, line, book{0} ORDER BY CASE region WHEN 'us' THEN 1 WHEN 'eu' THEN 2 ELSE 4 END, price DESC) AS rn"
SNAPSHOT_SQL = f"""WITH {_LINES}, d AS (SELECT *, {_DEDUP.format('')} FROM o WHERE k IN (1, 2))
SELECT event_id, market, subject, side, line, price, book, region, lead_min, 'decision' AS tag, CAST(tier AS BIGINT) AS tier FROM d WHERE rn = 1"""


def _slates(spark, sf):
    d = _line_docs(spark, sf, main_totals=F.col("l_partkey") % 2 == 0)
    return _write(d.withColumn("data", F.array("event")).drop("event"), scratch_dir(spark, "slates"))


def featured_json(spark, sf):
    """Game quotes from whole-slate snapshots for the wanted (snapshot, event) pairs only."""
    path = _slates(spark, sf)
    li = table(spark, sf, "lineitem").filter("l_orderkey % 3 <> 0")
    snap = F.lit(START).cast("timestamp") - F.make_interval(mins=(F.col("l_orderkey") % 800 - 5).cast("int"))
    wanted = li.select(F.col("l_orderkey").cast("string").alias("event_id"), snap.alias("snapshot_ts")).distinct()
    return _out(SN.featured_quotes(spark, path, wanted, books=TEST_BOOKS))


FEATURED_SQL = f"""WITH {_LINES}, d AS (SELECT *, {_DEDUP.format('')} FROM o WHERE (k IN (0, 3) OR k = 1 AND pk % 2 = 0) AND CAST(event_id AS BIGINT) % 3 <> 0)
SELECT event_id, market, subject, side, line, price, book, region, lead_min, 'decision' AS tag, CAST(tier AS BIGINT) AS tier FROM d WHERE rn = 1"""


def history_json(spark, sf):
    """Price history of the last twelve hours, and the same slates read as a live payload."""
    path = _slates(spark, sf)
    hist = _out(SN.featured_history(spark, path, books=TEST_BOOKS))
    live = SN.live_quotes(spark.read.schema(SN.LIVE_SLATE).json(path))
    live = live.filter("market = 'h2h'").groupBy("event_id", "market", "subject", "side", "line", "book", "region", "lead_min", "tag").agg(F.max("price").alias("price"))
    return hist.unionByName(live.withColumn("tier", F.lit(None).cast("bigint")))


HISTORY_SQL = f"""WITH {_LINES}, d AS (SELECT *, {_DEDUP.format(', lead_min')} FROM o WHERE (k IN (0, 3) OR k = 1 AND pk % 2 = 0) AND lead_min <= 720)
SELECT event_id, market, subject, side, line, price, book, region, lead_min, 'hist' AS tag, CAST(tier AS BIGINT) AS tier FROM d WHERE rn = 1
UNION ALL SELECT event_id, market, subject, side, line, max(price), book, region, lead_min, 'live', NULL FROM o WHERE k = 0 GROUP BY event_id, market, subject, side, line, book, region, lead_min"""


def event_listing(spark, sf):
    """Events listed on several days, first listing kept, market date and season window applied."""
    o = table(spark, sf, "orders")
    start = F.to_timestamp(F.lit("2023-01-01")) + F.make_interval(hours=(F.col("o_orderkey") % 35000).cast("int"))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = lambda name: F.struct(F.when(F.col("o_orderkey") % 29 > 0, F.col("o_orderkey").cast("string")).alias("id"), F.lit("sport").alias("sport_key"), iso(start).alias("commence_time"), F.lit(name).alias("home_team"), F.lit("B").alias("away_team"))
    path = scratch_dir(spark, "listings")
    day = F.lit("2023-01-01").cast("timestamp")
    first = o.select(iso(day + F.make_interval(days=(F.col("o_orderkey") % 20).cast("int"))).alias("timestamp"), F.array(e("first")).alias("data"))
    again = o.filter("o_orderkey % 2 = 0").select(iso(day + F.make_interval(days=(F.col("o_orderkey") % 20 + 3).cast("int"))).alias("timestamp"), F.array(e("later")).alias("data"))
    first.unionByName(again).write.json(path)
    d = SN.listed_events(spark, path)
    return d.select("event_id", "commence_time", "home_team", F.col("game_date").cast("string").alias("game_date"), F.col("season").cast("bigint").alias("season"))


LISTING_SQL = """WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, TIMESTAMP '2023-01-01' + to_hours(o_orderkey % 35000) AS t FROM orders WHERE o_orderkey % 29 > 0),
d AS (SELECT *, CAST(((t AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS gd FROM e),
s AS (SELECT *, CASE WHEN gd BETWEEN DATE '2023-03-30' AND DATE '2023-10-01' THEN 2023 WHEN gd BETWEEN DATE '2024-03-28' AND DATE '2024-09-30' THEN 2024
  WHEN gd BETWEEN DATE '2025-03-27' AND DATE '2025-09-28' THEN 2025 WHEN gd BETWEEN DATE '2026-03-26' AND least(DATE '2026-09-27', current_date - 1) THEN 2026 END AS season FROM d)
SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS commence_time, 'first' AS home_team, CAST(gd AS VARCHAR) AS game_date, CAST(season AS BIGINT) AS season FROM s WHERE season IS NOT NULL"""


def _summaries(spark, sf):
    """One boxscore document per lineitem row: one listed player, and a few plays by that player."""
    d = table(spark, sf, "lineitem").join(view(spark, sf, "games_v").withColumnRenamed("game_id", "l_orderkey"), "l_orderkey")
    txt = lambda c: c.cast("string")
    team = lambda c: F.struct(txt(c).alias("id"), F.concat(F.lit("Team "), txt(c)).alias("displayName"), F.concat(F.lit("T"), txt(c)).alias("abbreviation"))
    score = lambda c: F.when(F.col("l_orderkey") % 37 == 0, "x").otherwise(txt(c.cast("int")))
    side = lambda n, t, s: F.struct(F.lit(n).alias("homeAway"), score(F.col(s)).alias("score"), team(F.col(t)).alias("team"))
    comp = F.struct(
        F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.struct(F.struct(F.when(F.col("l_orderkey") % 11 == 0, "STATUS_POSTPONED").otherwise("STATUS_FINAL").alias("name")).alias("type")).alias("status"),
        F.array(side("away", "away_team", "away_score"), side("home", "home_team", "home_score")).alias("competitors"))
    pit = F.col("l_returnflag") == "R"
    keys = F.when(pit, F.array(*map(F.lit, ("fullInnings.partInnings", "hits", "earnedRuns", "walks", "strikeouts", "homeRuns", "pitches")))).when(
        F.col("l_linenumber") == 7, F.array(F.lit("other"))).otherwise(F.array(*map(F.lit, ("atBats", "runs", "hits", "RBIs", "homeRuns", "walks", "strikeouts", "pitches"))))
    n = lambda c, m: txt(F.col(c) % m)
    stats = F.when(pit, F.array(F.concat(n("l_suppkey", 9), F.lit("."), n("l_partkey", 3)), n("l_orderkey", 9), n("l_orderkey", 6), n("l_partkey", 5), n("l_suppkey", 10), n("l_partkey", 2), F.lit("--"))).otherwise(
        F.array(n("l_linenumber", 5), n("l_orderkey", 4), n("l_suppkey", 4), n("l_orderkey", 5), n("l_partkey", 2), n("l_suppkey", 3), n("l_partkey", 4), n("l_suppkey", 30)))
    athlete = F.struct(F.struct(txt(F.col("l_partkey")).alias("id"), F.concat(F.lit("P "), txt(F.col("l_partkey"))).alias("displayName")).alias("athlete"), stats.alias("stats"), (F.col("l_suppkey") % 2 == 0).alias("starter"))
    block = F.struct(team(F.col("home_team")).alias("team"), F.array(F.struct(keys.alias("keys"), F.array(athlete).alias("athletes"))).alias("statistics"))
    who = F.array(F.struct(F.lit("pitcher").alias("type"), F.struct(F.lit("0").alias("id")).alias("athlete")), F.struct(F.lit("batter").alias("type"), F.struct(txt(F.col("l_partkey")).alias("id")).alias("athlete")))
    play = lambda c: F.struct(F.struct(c.alias("text")).alias("type"), who.alias("participants"))
    k = F.col("l_suppkey") % 5
    plays = F.array(play(F.when(k == 0, "Single").when(k == 1, "Double").when(k == 2, "Triple").when(k == 3, "Home Run").otherwise("Walk")), play(F.lit("Single")), play(F.lit("Strikeout")))
    return d.select(F.struct(txt(F.col("l_orderkey")).alias("id"), F.array(comp).alias("competitions")).alias("header"), F.struct(F.struct(F.col("venue").alias("fullName")).alias("venue")).alias("gameInfo"),
                    F.struct(F.array(block).alias("players")).alias("boxscore"), plays.alias("plays"))


def _read_summaries(spark, sf, schema=RS.SUMMARY):
    path = scratch_dir(spark, "boxscores")
    _summaries(spark, sf).write.options(**PACKED).json(path)
    return RS.read_summaries(spark, path, schema)


def boxscore_json(spark, sf):
    p = RS.player_rows(_read_summaries(spark, sf, RS.PLAYER_SUMMARY))
    num = ["at_bats", "hits", "rbi", "strike_outs", "walks", "outs", "earned_runs", "pitch_count", "total_bases", "doubles", "triples", "played"]
    return p.groupBy("event_id", "athlete_id", "grp").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in num])


_BOX = f"""{ctes('games_v')}, l AS (SELECT lineitem.*, games_v.* FROM lineitem JOIN games_v ON l_orderkey = game_id),
h AS (SELECT l_orderkey, l_partkey, sum(1 + CASE l_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END) AS total_bases, count(*) FILTER (WHERE l_suppkey % 5 = 1) AS doubles, count(*) FILTER (WHERE l_suppkey % 5 = 2) AS triples FROM l GROUP BY ALL)"""
BOX_SQL = f"""{_BOX}, r AS (SELECT l.*, CASE WHEN l_returnflag = 'R' THEN 'pitching' WHEN l_linenumber <> 7 THEN 'batting' END AS grp, h.* EXCLUDE (l_orderkey, l_partkey) FROM l JOIN h ON l.l_orderkey = h.l_orderkey AND l.l_partkey = h.l_partkey)
SELECT CAST(l_orderkey AS VARCHAR) AS event_id, CAST(l_partkey AS VARCHAR) AS athlete_id, grp, count(*) AS rows, CAST(sum(CASE grp WHEN 'batting' THEN l_linenumber % 5 END) AS DOUBLE) AS at_bats, CAST(sum(CASE grp WHEN 'batting' THEN l_suppkey % 4 END) AS DOUBLE) AS hits,
  CAST(sum(CASE grp WHEN 'batting' THEN l_orderkey % 5 END) AS DOUBLE) AS rbi, CAST(sum(CASE grp WHEN 'batting' THEN l_partkey % 4 ELSE l_suppkey % 10 END) AS DOUBLE) AS strike_outs, CAST(sum(CASE grp WHEN 'batting' THEN l_suppkey % 3 ELSE l_partkey % 5 END) AS DOUBLE) AS walks,
  CAST(sum(CASE grp WHEN 'pitching' THEN (l_suppkey % 9) * 3 + l_partkey % 3 END) AS DOUBLE) AS outs, CAST(sum(CASE grp WHEN 'pitching' THEN l_orderkey % 6 END) AS DOUBLE) AS earned_runs, CAST(sum(CASE grp WHEN 'pitching' THEN 0 END) AS DOUBLE) AS pitch_count,
  CAST(sum(CASE grp WHEN 'batting' THEN total_bases END) AS DOUBLE) AS total_bases, CAST(sum(CASE grp WHEN 'batting' THEN doubles END) AS DOUBLE) AS doubles, CAST(sum(CASE grp WHEN 'batting' THEN triples END) AS DOUBLE) AS triples,
  CAST(sum(CASE WHEN grp = 'pitching' OR l_linenumber % 5 > 0 OR l_suppkey % 3 > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS played FROM r WHERE grp IS NOT NULL GROUP BY ALL"""


def completed_games(spark, sf):
    g = RS.completed_games(_read_summaries(spark, sf))
    c = lambda x: F.col(x).cast("bigint").alias(x)
    return g.select("game_id", "venue", "home_team", "away_abbr", c("home_score"), c("total_runs"), c("home_margin"), F.col("game_date").cast("string").alias("game_date"))


GAMES_SQL = f"""{_BOX} SELECT DISTINCT CAST(game_id AS VARCHAR) AS game_id, venue, concat('Team ', CAST(home_team AS VARCHAR)) AS home_team, concat('T', CAST(away_team AS VARCHAR)) AS away_abbr, CAST(home_score AS BIGINT) AS home_score,
  CAST(home_score + away_score AS BIGINT) AS total_runs, CAST(home_score - away_score AS BIGINT) AS home_margin, CAST(CAST(((start_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS VARCHAR) AS game_date
FROM l WHERE game_id % 37 <> 0 AND game_id % 11 <> 0"""


def scoreboard_json(spark, sf):
    path = scratch_dir(spark, "scoreboard")
    s = _summaries(spark, sf)
    event = F.struct(F.col("header.id").alias("id"), F.col("header.competitions")[0]["date"].alias("date"), F.col("header.competitions").alias("competitions"))
    s.select(F.array(event).alias("events")).write.options(**PACKED).json(path)
    d = RS.scoreboard(spark, path)
    return d.select("event_id", "status", "home_team", "away_abbr", "home_score")


SCOREBOARD_SQL = f"""{_BOX} SELECT DISTINCT CAST(game_id AS VARCHAR) AS event_id, CASE WHEN game_id % 11 = 0 THEN 'STATUS_POSTPONED' ELSE 'STATUS_FINAL' END AS status, concat('Team ', CAST(home_team AS VARCHAR)) AS home_team,
  concat('T', CAST(away_team AS VARCHAR)) AS away_abbr, CASE WHEN game_id % 37 = 0 THEN 'x' ELSE CAST(CAST(home_score AS INT) AS VARCHAR) END AS home_score FROM l"""

QUERIES = {
    "snapshot_json": snapshot_json, "featured_json": featured_json, "history_json": history_json, "event_listing": event_listing,
    "boxscore_json": boxscore_json, "completed_games": completed_games, "scoreboard_json": scoreboard_json,
}
ORACLES = {
    "snapshot_json": SNAPSHOT_SQL, "featured_json": FEATURED_SQL, "history_json": HISTORY_SQL, "event_listing": LISTING_SQL,
    "boxscore_json": BOX_SQL, "completed_games": GAMES_SQL, "scoreboard_json": SCOREBOARD_SQL,
}
