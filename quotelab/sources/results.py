"""Result feeds: scoreboards, boxscores and play-by-play to game and player tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.functions.times import market_date, parse_iso
from quotelab.operators.keys import first_per_key

_TEAM = "struct<id:string,displayName:string,abbreviation:string>"
_COMP = f"struct<date:string,status:struct<type:struct<name:string>>,venue:struct<fullName:string>,doubleheader:string,competitors:array<struct<homeAway:string,score:string,team:{_TEAM}>>>"
SCOREBOARD = f"events array<struct<id:string,date:string,status:struct<type:struct<name:string>>,competitions:array<{_COMP}>>>"
SUMMARY = (
    f"header struct<id:string,competitions:array<{_COMP}>>, gameInfo struct<venue:struct<fullName:string>,attendance:bigint>, "
    f"boxscore struct<players:array<struct<team:{_TEAM},statistics:array<struct<keys:array<string>,"
    "athletes:array<struct<athlete:struct<id:string,displayName:string,shortName:string>,stats:array<string>,starter:boolean>>>>>>>, "
    "plays array<struct<type:struct<text:string>,atBatId:string,participants:array<struct<type:string,athlete:struct<id:string>>>>>"
)
#: What player rows are made of: a scan with this schema skips the competitions, whose nested objects cost most of the parsing.
PLAYER_SUMMARY = f"header struct<id:string>, {SUMMARY[SUMMARY.index('boxscore struct'):]}"
# ---- fixed values: final status, bases per hit, boxscore keys ---------------------------------------
FINAL = "STATUS_FINAL"
BASES = {"Single": 1, "Double": 2, "Triple": 3, "Home Run": 4}
INNINGS = "fullInnings.partInnings"
BATTING_KEYS = {"at_bats": "atBats", "runs": "runs", "hits": "hits", "rbi": "RBIs", "home_runs": "homeRuns", "walks": "walks", "strike_outs": "strikeouts", "pitches_seen": "pitches"}
PITCHING_KEYS = {"strike_outs": "strikeouts", "hits_allowed": "hits", "earned_runs": "earnedRuns", "walks": "walks", "home_runs_allowed": "homeRuns", "pitch_count": "pitches"}
# ---- end of fixed values -----------------------------------------------------------------------


def _side(competitors: Column, which: str) -> Column:
    return F.get(F.filter(competitors, lambda c: c["homeAway"] == which), F.lit(0))


def outs_pitched(innings: Column) -> Column:
    """Innings such as 5.2 (five and two thirds) to outs; anything else counts nothing."""
    whole = F.regexp_extract(innings, r"^(\d+)(?:\.(\d))?", 1).try_cast("int")
    part = F.regexp_extract(innings, r"^\d+\.(\d)", 1).try_cast("int")
    return F.coalesce(whole * 3 + F.coalesce(part, F.lit(0)), F.lit(0)).cast("double")


def scoreboard(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed game: status, start, venue and both sides."""
    d = spark.read.schema(SCOREBOARD).json(path).select(F.inline("events")).withColumn("c", F.get("competitions", F.lit(0)))
    d = d.withColumns({s: _side(F.col("c.competitors"), s) for s in ("home", "away")})
    home, away = F.col("home"), F.col("away")
    d = d.select(
        F.col("id").alias("event_id"), "date", F.coalesce("c.status.type.name", "status.type.name").alias("status"), F.col("c.venue.fullName").alias("venue"),
        home["team"]["displayName"].alias("home_team"), away["team"]["displayName"].alias("away_team"),
        home["team"]["abbreviation"].alias("home_abbr"), away["team"]["abbreviation"].alias("away_abbr"),
        home["score"].alias("home_score"), away["score"].alias("away_score"),
        F.col("c.doubleheader").alias("doubleheader"))
    return first_per_key(d, ["event_id"], [F.col("date").asc(), F.col("status").asc_nulls_last()])


def completed_games(summaries: DataFrame) -> DataFrame:
    """Finished games with numeric scores: totals, margins and market date."""
    d = summaries.withColumn("c", F.get("header.competitions", F.lit(0)))
    d = d.filter(F.col("c.status.type.name") == FINAL).withColumns({s: _side(F.col("c.competitors"), s) for s in ("home", "away")})
    home, away = F.col("home"), F.col("away")
    d = d.select(
        F.col("header.id").alias("game_id"), parse_iso(F.col("c.date")).alias("start_ts"), F.col("gameInfo.venue.fullName").alias("venue"),
        home["team"]["displayName"].alias("home_team"), away["team"]["displayName"].alias("away_team"),
        home["team"]["abbreviation"].alias("home_abbr"), away["team"]["abbreviation"].alias("away_abbr"),
        home["score"].try_cast("int").alias("home_score"), away["score"].try_cast("int").alias("away_score"))
    d = d.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    d = first_per_key(d, ["game_id"], [F.col("start_ts").asc(), F.col("home_score").asc(), F.col("away_score").asc()])
    return d.withColumns({
        "total_runs": F.col("home_score") + F.col("away_score"), "home_margin": F.col("home_score") - F.col("away_score"), "game_date": market_date(F.col("start_ts"))})


def read_summaries(spark: SparkSession, path: str, schema: str = SUMMARY) -> DataFrame:
    return spark.read.schema(schema).json(path)


def hits_by_batter(summaries: DataFrame) -> DataFrame:
    """Total bases and hit types per (game, batter) from play-by-play."""
    p = summaries.select(F.col("header.id").alias("event_id"), F.inline("plays"))
    batters = F.filter("participants", lambda x: x["type"] == "batter")
    p = p.withColumn("batter", F.get(F.reverse(batters), F.lit(0))["athlete"]["id"])
    kind = F.col("type.text")
    bases = None
    for k, v in BASES.items():
        bases = F.when(kind == k, v) if bases is None else bases.when(kind == k, v)
    p = p.filter(kind.isin(*BASES) & F.col("batter").isNotNull())
    return p.groupBy("event_id", F.col("batter").alias("athlete_id")).agg(
        F.sum(bases).cast("double").alias("total_bases"), F.count_if(kind == "Double").cast("double").alias("doubles"), F.count_if(kind == "Triple").cast("double").alias("triples"))


def player_rows(summaries: DataFrame) -> DataFrame:
    """One row per listed player and role with every statistic the markets settle on."""
    d = summaries.select(F.col("header.id").alias("event_id"), F.inline("boxscore.players"))
    d = d.select("event_id", F.col("team.abbreviation").alias("team"), F.inline("statistics"))
    grp = F.when(F.array_contains("keys", "atBats"), "batting").when(F.array_contains("keys", INNINGS), "pitching")
    d = d.withColumn("grp", grp).filter(F.col("grp").isNotNull()).select("event_id", "team", "grp", "keys", F.inline("athletes")).filter(F.size("stats") > 0)
    # The shorter one is filled with nulls. Entries go backwards: the last one under a key counts, as a file may repeat a key or leave one empty.
    kv = F.reverse(F.filter(F.arrays_zip("keys", "stats"), lambda x: x["stats"].isNotNull()))
    d = d.select("event_id", "team", "grp", F.col("athlete.id").alias("athlete_id"), F.col("athlete.displayName").alias("name"), "starter", kv.alias("kv"))
    d = d.select("*", F.col("kv.keys").alias("named"), F.col("kv.stats").alias("values"))
    last = lambda k: F.get("values", F.array_position("named", F.lit(k)).cast("int") - 1)
    num = lambda k: F.coalesce(last(k).try_cast("double"), F.lit(0.0))
    bat, pit = F.col("grp") == "batting", F.col("grp") == "pitching"
    cols: dict[str, Column] = {}
    for name, key in BATTING_KEYS.items():
        cols[name] = F.when(bat, num(key))
    for name, key in PITCHING_KEYS.items():
        cols[name] = F.when(pit, num(key)).otherwise(cols[name]) if name in cols else F.when(pit, num(key))
    cols["outs"] = F.when(pit, outs_pitched(last(INNINGS)))
    cols["played"] = F.when(pit | (num("atBats") > 0) | (num("walks") > 0), 1.0).otherwise(0.0)
    d = d.select("event_id", "team", "grp", "athlete_id", "name", "starter", *[v.alias(k) for k, v in cols.items()])
    h = hits_by_batter(summaries)
    d = d.join(h, ["event_id", "athlete_id"], "left")
    return d.withColumns({c: F.when(F.col("grp") == "batting", F.coalesce(c, F.lit(0.0))) for c in ("total_bases", "doubles", "triples")})
