"""Model frame (one row per proposition) and betting frame (best price per proposition side)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.dims import BOOKS, STARTER_MARKETS, Books, market_attr
from quotelab.functions import pricing as P
from quotelab.operators import ladder as L
from quotelab.operators.keys import PROPOSITION, first_per_key, null_safe_join

# ---- fixed values: the rolling rate that carries each market's statistic, proposition-level inputs --
BATTER_RATE = {
    "batter_hits": "bat_hits_ppa", "batter_rbis": "bat_rbi_ppa", "batter_total_bases": "bat_total_bases_ppa",
    "batter_home_runs": "bat_home_runs_ppa", "runs_scored": "bat_runs_ppa", "batter_strikeouts": "bat_strike_outs_ppa",
}
PITCHER_COUNT = {"pitcher_strikeouts": "pit_strike_outs", "pitcher_outs": "pit_outs"}
STRUCTURE = ("n_books_prop", "hold_med", "lead_min", "line", "book_spread", "n_quotes", "book_std", "proj_mean",
             "line_minus_proj", "line_over_proj", "primary_line", "p_primary", "n_books_primary", "ladder_minus_cons",
             "is_primary_line", "is_home_player", "logit_cons")
SIDE_PREFIXES = {
    "batting": ("bat_", "tm_", "park_", "opp_", "has_opp_starter"),
    "pitching": ("pit_", "park_", "home_tg_", "away_tg_"),
    "team": ("home_tg_", "away_tg_", "park_", "move_", "n_snapshots"),
}
# ---- end of fixed values -----------------------------------------------------------------------


def proposition_structure(judged: DataFrame, key=PROPOSITION, carry: tuple[str, ...] = ()) -> DataFrame:
    """Market structure per proposition from its judged quotes.

    ``p_cons_med`` is the median over quotes of the consensus each was judged against. A proposition has as many
    distinct values as it has books, which is all the median's buffer holds. ``carry`` are columns that are
    constant within a proposition.
    """
    fair = F.col("p_book_fair")
    return judged.groupBy(*key).agg(
        F.median("p_cons").alias("p_cons_med"),
        F.max("n_books_prop").alias("n_books_prop"),
        F.median("hold_book").alias("hold_med"),
        F.max("lead_min").alias("lead_min"),
        F.count("*").alias("n_quotes"),
        F.stddev_samp(fair).alias("book_std"),
        F.min(fair).alias("book_min"),
        F.max(fair).alias("book_max"),
        F.count(fair).alias("n_two_sided"),
        (F.max(fair) - F.min(fair)).alias("book_spread"),
        *[F.max(c).alias(c) for c in carry],
    )


def proposition_outcome(graded: DataFrame, key=PROPOSITION) -> DataFrame:
    """``won`` and ``stat_value`` per proposition from the over or home side; pushes and voids drop out."""
    d = graded.filter(P.is_over(F.col("side"))).groupBy(*key).agg(
        F.max("result").alias("result"), F.max("stat_value").alias("stat_value"))
    d = d.filter(F.col("result").isin("win", "loss"))
    return d.select(*key, F.when(F.col("result") == "win", 1.0).otherwise(0.0).alias("won"), "stat_value")


def proposition_frame(judged: DataFrame, table: DataFrame, key=PROPOSITION, carry: tuple[str, ...] = (), movement: DataFrame | None = None) -> DataFrame:
    """Structure, outcome, ladder and anchor of every proposition that has an anchor and a decided outcome."""
    d = null_safe_join(proposition_structure(judged, key, carry), proposition_outcome(judged, key), key, "inner")
    d = L.attach(d, table)
    d = d.withColumns({
        "anchor_src": F.when(F.col("p_cons_med").isNotNull(), "direct").otherwise("ladder"),
        "p_anchor": F.coalesce("p_cons_med", "p_ladder"),
    }).filter(F.col("p_anchor").isNotNull())
    d = d.withColumn("logit_cons", P.logit(F.col("p_anchor")))
    return attach_movement(d, movement, key)


def attach_movement(props: DataFrame, movement: DataFrame | None, key=PROPOSITION) -> DataFrame:
    from quotelab.operators.movement import MOVE_COLS

    if movement is None:
        return props.withColumns({c: F.lit(None).cast("double") for c in MOVE_COLS})
    return null_safe_join(props, movement.select(*key, *MOVE_COLS), key, "left")


def _prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def attach_features(props: DataFrame, games: DataFrame, batters: DataFrame, pitchers: DataFrame, teams: DataFrame, parks: DataFrame, context: DataFrame) -> DataFrame:
    """Star join of the form tables onto rows with ``game_id, athlete_id, market``.

    Each side is reduced to its key first, so no join can widen the frame. Form that does not apply to the side
    of a market is null.
    """
    bat, pit, tm, park, tg = (_prefixed(d, p) for d, p in (
        (batters, "bat_"), (pitchers, "pit_"), (teams, "tm_"), (parks, "park_"), (context, "tg_")))
    pair = ["game_id", "athlete_id"]
    out = props.join(games.select("game_id", "home_team", "away_team").dropDuplicates(["game_id"]), "game_id", "left")
    out = out.join(batters.select(F.col("event_id").alias("game_id"), "athlete_id", F.col("team").alias("player_team"), *bat).dropDuplicates(pair), pair, "left")
    out = out.join(pitchers.select(F.col("event_id").alias("game_id"), "athlete_id", *pit).dropDuplicates(pair), pair, "left")
    side = market_attr("side", F.col("market"))
    out = out.withColumns({c: F.when(side == "batting", F.col(c)) for c in bat} | {c: F.when(side == "pitching", F.col(c)) for c in pit})
    out = out.join(teams.select(F.col("event_id").alias("game_id"), F.col("team").alias("player_team"), *tm).dropDuplicates(["game_id", "player_team"]), ["game_id", "player_team"], "left")
    out = out.join(parks.select(F.col("event_id").alias("game_id"), *park).dropDuplicates(["game_id"]), "game_id", "left")
    both = context.groupBy(F.col("event_id").alias("game_id")).agg(*[
        F.max(F.when(F.col("is_home") == flag, F.col(c))).alias(f"{name}_{c}") for name, flag in (("home", 1), ("away", 0)) for c in tg])
    out = out.join(both, "game_id", "left")
    out = out.withColumn("is_home_player", F.when(F.col("player_team") == F.col("home_team"), 1.0).otherwise(0.0))
    return add_projection(attach_opposing_starter(out, pitchers, pit))


def starters_from_quotes(quotes: DataFrame, game: str = "game_id") -> DataFrame:
    """Announced starters with their number of quotes: books quote pitcher markets only for those."""
    d = quotes.filter(F.col("market").isin(*STARTER_MARKETS) & F.col("athlete_id").isNotNull() & F.col(game).isNotNull())
    return d.groupBy(game, "athlete_id").agg(F.count("*").alias("n_quotes"))


def opposing(rows: DataFrame, starters: DataFrame, game: str, team: str) -> DataFrame:
    """Adds ``opp_athlete_id``: the lowest id among starters of the same game and another team.

    The first two teams of a game answer the question for every row, so each game contributes one row to the join.
    """
    per_team = starters.filter(F.col("pitcher_team").isNotNull()).groupBy(game, "pitcher_team").agg(F.min("athlete_id").alias("a"))
    two = per_team.groupBy(game).agg(F.array_sort(F.collect_set(F.struct("a", "pitcher_team"))).alias("s")).select(
        game, F.get("s", F.lit(0)).alias("s1"), F.get("s", F.lit(1)).alias("s2"))
    d = rows.join(two, game, "left")
    other = F.when(F.col(team).isNotNull(), F.when(F.col("s1.pitcher_team") != F.col(team), F.col("s1.a")).otherwise(F.col("s2.a")))
    return d.withColumn("opp_athlete_id", other).drop("s1", "s2")


def attach_opposing_starter(rows: DataFrame, pitchers: DataFrame, cols: list[str], game: str = "game_id") -> DataFrame:
    """Form of the opposing starter, and whether one was found: a known starter may have no history yet."""
    form = pitchers.select(F.col("event_id").alias(game), F.col("athlete_id").alias("opp_athlete_id"), F.col("team").alias("pitcher_team"), *[F.col(c).alias(f"opp_{c}") for c in cols])
    form = form.dropDuplicates([game, "opp_athlete_id"])
    named = starters_from_quotes(rows, game).withColumnRenamed("athlete_id", "opp_athlete_id")
    starters = named.join(form.select(game, "opp_athlete_id", "pitcher_team"), [game, "opp_athlete_id"])
    d = opposing(rows, starters.withColumnRenamed("opp_athlete_id", "athlete_id"), game, "player_team")
    d = d.withColumn("has_opp_starter", F.when(F.col("opp_athlete_id").isNotNull(), 1.0).otherwise(0.0))
    return d.join(form.drop("pitcher_team"), [game, "opp_athlete_id"], "left")


def add_projection(df: DataFrame) -> DataFrame:
    """Projected statistic from blended form, and the line relative to it."""

    def mix(stem: str, windows) -> Column:
        return P.blend([F.col(f"{stem}_{w}") for w in windows])

    proj = None
    pa = mix("bat_pa", ("r10", "r30", "exp"))
    rules = [(m, mix(c, ("r10", "r30", "exp")) * pa) for m, c in BATTER_RATE.items()]
    rules += [(m, mix(c, ("r3", "r8", "exp"))) for m, c in PITCHER_COUNT.items()]
    for market, value in rules:
        hit = F.col("market") == market
        proj = F.when(hit, value) if proj is None else proj.when(hit, value)
    d = df.withColumn("proj_mean", proj)
    return d.withColumns({
        "line_minus_proj": F.col("line") - F.col("proj_mean"),
        "line_over_proj": F.when(F.col("proj_mean") > 0, F.try_divide("line", "proj_mean")),
    })


def feature_profile(df: DataFrame, cols: list[str], by: str = "market") -> DataFrame:
    """(by, feature, n, varies): which features exist and vary per market, from one aggregate pass.

    Varying is minimum unlike maximum, which needs no distinct set. The result goes long after the aggregation.
    """
    aggs = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias("varies")).alias(c) for c in cols]
    return df.groupBy(by).agg(*aggs).select(by, F.inline(F.array(*[F.col(c) for c in cols])))


def select_features(profile: DataFrame, by: str = "market") -> DataFrame:
    """Features of the profile that suit the side of each market and are neither empty nor constant."""
    side = market_attr("side", F.col(by))
    fits = F.col("feature").isin(*STRUCTURE)
    for s, prefixes in SIDE_PREFIXES.items():
        named = F.lit(False)
        for p in prefixes:
            named = named | F.col("feature").startswith(p)
        fits = fits | ((side == s) & named)
    return profile.filter(fits & (F.col("n") > 0) & F.col("varies"))


def book_primary_anchor(judged: DataFrame, primary: DataFrame) -> DataFrame:
    """Each book's consensus at the primary line of its group, which already leaves the book out."""
    p = primary.select(*L.GROUP, "primary_line")
    d = judged.join(p, list(L.GROUP)).filter(F.col("line") == F.col("primary_line"))
    return d.groupBy(*L.GROUP, "book").agg(F.median("p_cons").alias("p_primary_loo"))


def candidates(judged: DataFrame, props: DataFrame | None = None, table: DataFrame | None = None, tag: str = "decision", books: Books = BOOKS, key=PROPOSITION) -> DataFrame:
    """Best bettable price per (proposition, side) with an anchor, filled from the ladder where no book set one.

    A filled anchor starts from the book's own leave-one-out view of the primary line and is as well supported as
    that line, not better. Prices that pay the same (+100 and -100) go by the price, equal quotes by their other columns.
    """
    now = judged.filter(F.col("tag") == tag)
    d = now.filter(books.can_bet(F.col("book")))
    if props is not None and table is not None:
        prim = first_per_key(props, L.GROUP, [F.col("line").asc()]).select(*L.GROUP, "primary_line", "p_primary", "n_books_primary")
        d = d.join(prim, list(L.GROUP), "left").join(book_primary_anchor(now, prim), [*L.GROUP, "book"], "left")
        d = d.withColumn("p_primary_eff", F.coalesce("p_primary_loo", "p_primary"))
        d = L.apply(d, table, "p_primary_eff", "p_fill")
        need = F.col("p_cons").isNull() & F.col("p_primary_eff").isNotNull()
        d = d.withColumn("anchor_src", F.when(need, "ladder").otherwise("direct")).withColumns({
            "n_books_cons": F.when(need, F.col("n_books_primary")).otherwise(F.col("n_books_cons")),
            "p_cons": F.when(need, F.col("p_fill")).otherwise(F.col("p_cons")),
        })
    d = d.filter(F.col("p_cons").isNotNull())
    rest = sorted(set(d.columns) - {*key, "side", "book", "price"})
    return first_per_key(d, [*key, "side"], [P.payout(F.col("price")).desc(), F.col("book").asc(), F.col("price").desc(), *[F.col(c) for c in rest]])


def candidate_features(cand: DataFrame, props: DataFrame, features: list[str], key=PROPOSITION) -> DataFrame:
    """Candidates with the features of their proposition; the anchor in log-odds is the candidate's own."""
    cols = [c for c in dict.fromkeys(features) if c not in key and c not in cand.columns]
    d = null_safe_join(cand, props.select(*key, *cols), key, "inner")
    return d.withColumn("logit_cons", P.logit(F.col("p_cons")))
