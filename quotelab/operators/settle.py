"""Settlement of quotes against results, and the reports on it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.dims import market_attr
from quotelab.functions import pricing as P

GRADED = ("win", "loss", "push")


def outcome(value: Column, line: Column, side: Column) -> Column:
    """Result of an over/under bet on a value; void without value or line."""
    over = P.is_over(side)
    return (
        F.when(value.isNull() | line.isNull(), "void")
        .when(value == line, "push")
        .when(over == (value > line), "win")
        .otherwise("loss")
    )


def grade(quotes: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Adds ``stat_value, result, graded`` to every quote.

    Moneylines settle on the sign of the home margin, handicaps on margin plus line, totals and player markets on
    value against line; equality is a push. No game, no boxscore row, no plate appearance, no line: void.
    Two left joins on the quote side, none of which widens it to one row per statistic.
    """
    market, side, line = F.col("market"), F.col("side"), F.col("line")
    kind, role, stat = (market_attr(a, market) for a in ("kind", "side", "stat"))
    g = games.select(
        F.col("game_id").alias("__g"), (F.col("home_score") - F.col("away_score")).alias("__margin"),
        (F.col("home_score") + F.col("away_score")).alias("__total"))
    stats = ("hits", "total_bases", "home_runs", "rbi", "runs", "strike_outs", "outs", "at_bats", "walks", "pitches_seen")
    p = players.select(F.col("event_id").alias("__pg"), F.col("athlete_id").alias("__a"), F.col("grp").alias("__r"),
                       *[F.col(c).alias(f"__{c}") for c in stats])
    q = quotes.withColumn("__role", F.when(kind == "prop", role))
    d = q.join(g, q["game_id"] == g["__g"], "left")
    d = d.join(p, (d["game_id"] == p["__pg"]) & (d["athlete_id"] == p["__a"]) & (d["__role"] == p["__r"]), "left")
    idle = F.lit(True)
    for c in ("pitches_seen", "at_bats", "walks"):
        idle = idle & (F.coalesce(F.col(f"__{c}"), F.lit(0.0)) <= 0)
    player_value = F.when(F.col("__g").isNotNull() & ~((F.col("__role") == "batting") & idle), _pick(stat))
    margin = F.col("__margin")
    value = (
        F.when(market == "h2h", margin).when((market == "spreads") & line.isNotNull(), margin)
        .when((market == "totals") & line.isNotNull(), F.col("__total")).when(kind == "prop", player_value)
    )
    result = (
        F.when(market == "h2h", outcome(margin, F.lit(0.0), side))
        .when(market == "spreads", outcome(margin + line, F.when(line.isNotNull(), 0.0), side))
        .when(market == "totals", outcome(F.col("__total"), line, side))
        .when(kind == "prop", outcome(player_value, line, side))
        .otherwise("void")
    )
    d = d.withColumns({"stat_value": value, "result": result}).withColumn("graded", F.col("result").isin(*GRADED))
    return d.select(*quotes.columns, "stat_value", "result", "graded")


def _pick(stat: Column) -> Column:
    out = None
    for c in ("hits", "rbi", "total_bases", "home_runs", "runs", "strike_outs", "outs"):
        out = F.when(stat == c, F.col(f"__{c}")) if out is None else out.when(stat == c, F.col(f"__{c}"))
    return out


def settle_by_value(quotes: DataFrame, values: DataFrame, default_line: float = 0.5) -> DataFrame:
    """Settles quotes whose statistic is given per (event, market); a null line settles at ``default_line``."""
    d = quotes.join(values.select("event_id", "market", "stat_value"), ["event_id", "market"], "left")
    d = d.withColumn("result", outcome(F.col("stat_value"), F.coalesce("line", F.lit(default_line)), F.col("side")))
    return d.withColumn("graded", F.col("result").isin(*GRADED))


def grading_report(graded: DataFrame) -> DataFrame:
    """How much of each market settled, and how."""
    n = lambda r: F.count_if(F.col("result") == r).alias(r)
    g = graded.groupBy("market").agg(F.count("*").alias("quotes"), *[n(r) for r in (*GRADED, "void")])
    pct = lambda c, name: F.round(c / F.col("quotes") * 100, 2).alias(name)
    done = F.col("win") + F.col("loss") + F.col("push")
    return g.select("market", "quotes", done.alias("graded"), pct(done, "graded_pct"), "win", "loss", "push", "void",
                    pct(F.col("void"), "void_pct"), pct(F.col("push"), "push_pct"))
