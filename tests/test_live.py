"""The live path: features equal the batch ones, and a sweep of quotes becomes picks."""
import pytest
from pyspark.sql import functions as F

from catalog import frames as CF
from catalog.adapters import TEST_BOOKS, view
from quotelab.operators import form as FM
from quotelab.operators import frames as FR
from quotelab.plans import live as LV
from quotelab.plans import walk as W

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    g = view(spark, SF, "games_v").withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    return view(spark, SF, "players_v"), g.withColumnRenamed("game_id", "event_id")


def _quotes(spark, event, players):
    p = players.filter(F.col("event_id") == event)
    return p.select("event_id", F.when(F.col("grp") == "batting", "batter_hits").otherwise("pitcher_outs").alias("market"), F.concat(F.lit("P"), "athlete_id").alias("subject"), F.lit(0.5).alias("line"),
                    "athlete_id", F.lit(0.45).alias("p_cons"), F.lit(0.44).alias("p_book_fair"), F.lit(0.05).alias("hold_book"), F.lit(3.0).alias("n_books_prop"), F.lit(40.0).alias("lead_min"))


def test_live_features_equal_those_of_the_played_game(spark, history):
    players, games = history
    last = games.join(players.select("event_id").distinct(), "event_id").orderBy(F.col("start_ts").desc(), "event_id").first()
    as_of = str(last.start_ts)
    past = games.filter(F.col("start_ts") < F.lit(last.start_ts))
    now = games.filter(F.col("event_id") == last.event_id)
    quotes = _quotes(spark, last.event_id, players)
    live = LV.live_features(quotes, now, players, past, as_of)

    both = past.unionByName(now)
    props = FR.proposition_structure(quotes, carry=("athlete_id",)).withColumn("game_id", F.col("event_id"))
    batch = FR.attach_features(props, both.withColumnRenamed("event_id", "game_id"), FM.batter_form(players, both), FM.pitcher_form(players, both), FM.team_form(players, both), FM.park_form(both), FM.game_context(both))
    live, batch = ({(r.market, r.subject): r.asDict() for r in d.collect()} for d in (live, batch))
    assert live.keys() == batch.keys() and live
    for k, b in batch.items():
        for c, v in live[k].items():
            # The last team of a player is known before the game; the box score may name another one.
            if c.startswith(("bat_", "pit_", "park_", "home_tg_")) and c in b:
                assert (v is None and b[c] is None) or v == pytest.approx(b[c], abs=1e-9), (k, c, v, b[c])


def test_a_sweep_of_quotes_becomes_picks(spark, history):
    players, games = history
    sf = "/root/testdata/sf0.01"
    j, t = CF.staged(spark, sf)
    j = j.withColumn("game_date", F.date_add(F.lit("2023-01-01").cast("date"), F.col("day_no")))
    name = F.concat_ws("|", "event_id", "market", "subject", F.coalesce(F.col("line").cast("string"), F.lit("-")))
    features = ["n_quotes", "book_spread"]
    props = FR.proposition_frame(j, t, carry=("game_date",)).withColumn("prop", name).cache()
    cand = FR.candidate_features(FR.candidates(j, props, t, books=TEST_BOOKS), props, features).withColumn("prop", name)
    bundle = W.train(props, W.eligible(cand), features, FR.PROPOSITION, "prop", books=TEST_BOOKS)
    deployed = bundle.thresholds.withColumns({"deployment": F.lit("live"), "threshold": F.lit(-1.0)})

    live = view(spark, sf, "quotes_v").filter("tag = 'closing' AND event_id < 400").drop("tag").withColumn("athlete_id", F.lit(None).cast("bigint"))
    start = F.lit("2024-06-01 18:00:00").cast("timestamp") + F.make_interval(mins=(F.col("event_id") * 7 % 1200).cast("int"))
    events = live.select("event_id").distinct().select("event_id", F.lit(1).alias("home_team"), F.lit(2).alias("away_team"), F.lit("x").alias("venue"), start.alias("commence_ts"))
    picks = LV.serve(bundle, deployed, live, events, players, games, "2024-06-01 17:30:00", ["book"], features, TEST_BOOKS).collect()
    open_ = {r.event_id for r in events.collect() if 20 <= 30 + r.event_id * 7 % 1200 <= 14 * 60}
    assert picks and {p.event_id for p in picks} <= open_ < {r.event_id for r in events.collect()}
    keys = [(p.event_id, p.market, p.subject, p.line) for p in picks]
    assert len(set(keys)) == len(keys) and all(0 <= p.kelly <= 0.02 and p.ev >= -1 for p in picks)
