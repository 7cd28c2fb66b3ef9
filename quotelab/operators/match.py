"""Matching across feeds: games by nearest start, people by scoped name rules."""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quotelab.functions import names as N
from quotelab.functions.times import market_date

# ---- fixed values: similarity bound and lookback -----------------------------------------------
SIMILARITY = 0.88
LOOKBACK_DAYS = 45
# ---- end of fixed values -----------------------------------------------------------------------


def match_games(events: DataFrame, games: DataFrame) -> DataFrame:
    """(event_id, game_id): nearest start within the same teams and market date, each game claimed once.

    An event takes the game with the smallest gap, then the smallest id; of several events on one game the
    nearest keeps it and the others stay unmatched. Starts are reduced to distinct instants first and only the
    neighbours on either side are looked at, so a crowded (teams, date) never forms pairs.
    """
    key = ["home", "away", "date"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(
            "*", N.team_key(F.col("home_team").cast("string")).alias("home"),
            N.team_key(F.col("away_team").cast("string")).alias("away"), market_date(F.col("start_ts")).alias("date"))

    ev = keyed(events).select("event_id", *key, "start_ts")
    at = keyed(games).groupBy(*key, "start_ts").agg(F.min("game_id").alias("game_id"))
    instants = ev.select(*key, "start_ts").distinct()
    line = at.select(*key, "start_ts", "game_id", F.lit(0).alias("kind")).unionByName(
        instants.withColumns({"game_id": F.lit(None).cast(at.schema["game_id"].dataType), "kind": F.lit(1)}))
    w = Window.partitionBy(*key).orderBy("start_ts", "kind")
    game = F.when(F.col("kind") == 0, F.struct("start_ts", "game_id"))
    line = line.withColumns({
        "prev": F.last(game, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "next": F.first(game, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).filter("kind = 1")

    def gap(side: str) -> Column:
        return F.abs(F.unix_micros(F.col(f"{side}.start_ts")) - F.unix_micros(F.col("start_ts")))

    options = F.array(*[F.struct(gap(s).alias("gap"), F.col(f"{s}.game_id").alias("game_id")) for s in ("prev", "next")])
    best = F.array_min(F.filter(options, lambda x: x["game_id"].isNotNull()))
    nearest = ev.join(line.select(*key, "start_ts", best.alias("best")), [*key, "start_ts"], "left")
    claims = nearest.filter(F.col("best").isNotNull()).groupBy(F.col("best.game_id").alias("game_id")).agg(
        F.min(F.struct(F.col("best.gap").alias("gap"), "event_id")).alias("first"))
    won = claims.select(F.col("first.event_id").alias("event_id"), "game_id", (F.col("first.gap") / 1e6).alias("gap_s"))
    return events.select("event_id").join(won, "event_id", "left")


RULES = ("exact", "initial_last", "last_name")


def _rule_keys(key: Column) -> Column:
    forms = (key, N.initial_last(key), N.last_word(key))
    return F.array(*[F.struct(F.lit(i).alias("rule"), f.alias("form")) for i, f in enumerate(forms)])


def resolve_names(pairs: DataFrame, roster: DataFrame, similarity: str = "edit") -> DataFrame:
    """(scope_id, book_name, entity_id, match_how) for each distinct pair of scope and name.

    Rules in order: the whole key; first initial and last name; last name where only one entity has it; a close
    key. All exact rules are one equi-join on (scope, rule, key). Close keys are found through shared segments
    and only for the names left over. ``similarity`` is ``edit`` (distance at most 12% of the longer key) or
    ``ratio`` (matching-block ratio of at least 0.88).
    """
    who = roster.select("scope_id", "entity_id", N.person_key(F.col("canon_name")).alias("key")).filter("key <> ''")
    forms = who.select("scope_id", "entity_id", F.inline(_rule_keys(F.col("key"))))
    table = forms.groupBy("scope_id", "rule", "form").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("__other"))
    table = table.filter((F.col("rule") < 2) | (F.col("entity_id") == F.col("__other"))).drop("__other")
    asked = pairs.select("scope_id", "book_name").distinct().withColumn("key", N.person_key(F.col("book_name")))
    tried = asked.select("scope_id", "book_name", "key", F.inline(_rule_keys(F.col("key"))))
    hit = F.when(F.col("entity_id").isNotNull(), F.struct("rule", "entity_id"))
    found = tried.join(table, ["scope_id", "rule", "form"], "left").groupBy("scope_id", "book_name", "key").agg(F.min(hit).alias("hit"))
    known = who.select("scope_id").distinct().withColumn("has_roster", F.lit(True))
    found = found.join(known, "scope_id", "left")
    left_over = found.filter(F.col("hit").isNull() & F.col("has_roster") & (F.col("key") != "")).select("scope_id", "book_name", "key")
    names = who.groupBy("scope_id", "key").agg(F.min("entity_id").alias("entity_id"))
    close = close_keys(left_over, names, similarity)
    out = found.join(close, ["scope_id", "book_name"], "left")
    return out.select(
        "scope_id", "book_name", F.coalesce("hit.entity_id", "close_id").alias("entity_id"),
        F.when(F.col("has_roster").isNull(), "no_game")
        .when(F.col("hit").isNotNull(), F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("hit.rule") + 1))
        .when(F.col("close_id").isNotNull(), "fuzzy").otherwise("unmatched").alias("match_how"))


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two short names."""
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])


def close_keys(asked: DataFrame, names: DataFrame, similarity: str = "edit") -> DataFrame:
    """Best close key per (scope, name) as ``close_id``.

    If two strings differ by at most t edits, one of t + 1 segments of the first stands unchanged in the second,
    moved by at most t. Joining on (scope, length, segment number, segment) therefore finds every close pair
    without comparing all names of a scope.
    """
    share = 1 - SIMILARITY
    if similarity == "edit":
        longest = lambda n: F.floor(n / SIMILARITY)
        edits = lambda n: F.floor(share * longest(n))
    elif similarity == "ratio":
        longest = lambda n: F.floor(n * (1 + share) / (1 - share))
        edits = lambda n: F.floor(share * (n + longest(n)))
    else:
        raise ValueError(f"unknown similarity {similarity!r}")

    def segments(df: DataFrame) -> DataFrame:
        """Start and width of each segment of a key of length ``len``."""
        d = df.withColumn("t", edits(F.col("len")).cast("int"))
        d = d.withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("t"))))
        lo = F.floor(F.col("seg") * F.col("len") / (F.col("t") + 1)).cast("int")
        hi = F.floor((F.col("seg") + 1) * F.col("len") / (F.col("t") + 1)).cast("int")
        return d.withColumn("lo", lo).withColumn("width", hi - lo)

    index = segments(names.select("scope_id", F.col("key").alias("name_key"), "entity_id", F.length("key").alias("len")))
    index = index.select("scope_id", "name_key", "entity_id", "len", "seg", F.expr("substring(name_key, lo + 1, width)").alias("text"))
    n = F.length("key")
    shortest = F.greatest(F.ceil(n * SIMILARITY if similarity == "edit" else n * (1 - share) / (1 + share)), F.lit(1))
    probe = asked.withColumn("len", F.explode(F.sequence(shortest.cast("int"), longest(n).cast("int"))))
    probe = segments(probe).withColumn("move", F.explode(F.sequence(-F.col("t"), F.col("t"))))
    at = F.col("lo") + F.col("move")
    probe = probe.filter((at >= 0) & (at + F.col("width") <= n))
    probe = probe.select("scope_id", "book_name", "key", "len", "seg", F.expr("substring(key, lo + move + 1, width)").alias("text")).distinct()
    pairs = probe.join(index, ["scope_id", "len", "seg", "text"]).select("scope_id", "book_name", "key", "name_key", "entity_id").distinct()
    if similarity == "edit":
        d = pairs.withColumn("far", F.levenshtein("key", "name_key").cast("double"))
        d = d.filter(F.col("far") <= share * F.greatest(F.length("key"), F.length("name_key")))
    else:
        d = pairs.withColumn("far", 1 - block_ratio("key", "name_key")).filter(F.col("far") <= share + 1e-12)
    best = d.groupBy("scope_id", "book_name").agg(F.min(F.struct("far", "name_key", "entity_id")).alias("b"))
    return best.select("scope_id", "book_name", F.col("b.entity_id").alias("close_id"))


def resolve_recent(names: DataFrame, appearances: DataFrame, as_of: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(book_name, entity_id, team): the latest appearance under a name, from the last ``lookback_days`` days.

    Only when nobody appeared in that time does the whole history count.
    """
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), lookback_days)
    last_day = appearances.agg(F.max("game_date").alias("d")).scalar()
    recent = appearances.filter((F.col("game_date") >= cutoff) | (last_day < cutoff))
    latest = recent.withColumn("key", N.person_key(F.col("canon_name"))).filter("key <> ''").groupBy("key").agg(
        F.max(F.struct("game_date", "entity_id", "team")).alias("m"))
    asked = names.select("book_name").distinct().withColumn("key", N.person_key(F.col("book_name")))
    return asked.join(latest, "key", "left").select("book_name", F.col("m.entity_id").alias("entity_id"), F.col("m.team").alias("team"))


def match_report(matched: DataFrame) -> DataFrame:
    """Rows, distinct subjects and share within the market per matching rule."""
    g = matched.groupBy("market", "match_how").agg(F.count("*").alias("rows"), F.count_distinct("subject").alias("players"))
    total = F.sum("rows").over(Window.partitionBy("market"))
    return g.withColumn("pct", F.round(F.col("rows") / total * 100, 2))
