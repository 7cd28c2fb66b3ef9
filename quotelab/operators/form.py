"""Point-in-time form: what was known about an entity strictly before each of its appearances."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.operators.keys import first_per_key
from quotelab.operators.skew import ordered_rank

#: Rows of one entity that a task handles together; the overlap with the chunk before is the longest window.
CHUNK_ROWS = 8192
# ---- fixed values: statistics and windows of each form table ------------------------------------
BATTING = ("hits", "total_bases", "home_runs", "rbi", "runs", "strike_outs", "walks")
PITCHING = ("outs", "strike_outs", "hits_allowed", "earned_runs", "walks", "home_runs_allowed", "pitch_count")
BATTER_WINDOWS = (10, 30, 90)
PITCHER_WINDOWS = (3, 8, 20)
TEAM_WINDOWS = (10, 30)
PARK_WINDOWS = (30, 120)
CONTEXT_WINDOWS = (10, 30, 90)
START_OUTS = 9
# ---- end of fixed values -----------------------------------------------------------------------


def min_observations(window: int) -> int:
    return max(2, window // 5)


def lagged_form(
    df: DataFrame,
    entity: str,
    start: str,
    tie: str,
    cols,
    windows,
    prefix: str = "",
    prior: str | None = None,
    rest: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
    current: str | None = None,
) -> DataFrame:
    """Adds lagged rolling and expanding means of ``cols`` per entity, ordered by (start, tie).

    A window of w covers the w rows before the current one and is null below max(2, w // 5) values; the
    expanding mean needs three. ``prior`` names a count of earlier rows, ``rest`` the days since the last one.
    ``current`` is a prefix for the same windows with the current row in them, which only an audit wants.
    Every entity is cut into ordered chunks of ``chunk_rows``, each led by the tail of its predecessor, so a few entities
    with long histories spread over as many tasks as their rows fill; sums of whole chunks carry the expanding means.
    Inside a chunk every column is summed up once; a window is the difference of two of these sums, whatever its length.
    """
    size, halo = max(chunk_rows, max(windows)), max(windows)
    d = ordered_rank(df, [entity], F.col(start), [tie], "__rank", "__total")
    chunk, pos = F.floor((F.col("__rank") - 1) / size), F.pmod(F.col("__rank") - 1, F.lit(size))
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))
    tail = F.when(pos >= size - halo, F.array(own, F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))))
    d = d.select("*", F.inline(F.coalesce(tail, F.array(own)))).drop("__total")
    d = d.withColumn("__chunk", F.struct(entity, "chunk"))  # one key for join and windows, so rows are shuffled once; a null entity is equal to itself in it
    base = Window.partitionBy("__chunk").orderBy("__rank")
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    mine = lambda c: F.when(~F.col("halo"), F.col(c))
    sums = (
        d.filter(~F.col("halo")).groupBy(entity, "chunk")
        .agg(*[F.sum(c).alias(f"__s_{c}") for c in cols], *[F.count(c).alias(f"__n_{c}") for c in cols])
    )
    carried = Window.partitionBy(entity).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.struct(entity, "chunk").alias("__chunk"), *[F.coalesce(F.sum(f"__{k}_{c}").over(carried), F.lit(0)).alias(f"__{k}_{c}") for c in cols for k in "sn"]
    )
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(sums, "__chunk").withColumns(
        {f"__up_{k}_{c}": v for c in cols for k, v in (("s", F.coalesce(F.sum(c).over(upto), F.lit(0))), ("n", F.count(c).over(upto)))})
    out = _rolling(cols, windows, prefix, base)
    for c in cols:
        n = F.col(f"__n_{c}") + F.count(mine(c)).over(before)
        s = F.col(f"__s_{c}") + F.coalesce(F.sum(mine(c)).over(before), F.lit(0))
        out[f"{prefix}{c}_exp"] = F.when(n >= 3, F.try_divide(s, n))
    if current:
        out |= _rolling(cols, windows, current, base, 1)
    if prior:
        out[prior] = F.col("__rank") - 1
    if rest:
        out[rest] = _days_since(start, base)
    return d.select(*df.columns, *[v.alias(k) for k, v in out.items()], "halo").filter(~F.col("halo")).drop("halo")


def _rolling(cols, windows, prefix, base, shift=0):
    """Means of the ``n`` rows before the current one, or with ``shift`` 1 up to it, from the sums up to each row."""
    at = lambda c, back: F.col(c) if back == 0 else F.coalesce(F.lag(c, back).over(base), F.lit(0))
    out = {}
    for c in cols:
        for n in windows:
            s, k = (at(f"__up_{x}_{c}", 1 - shift) - at(f"__up_{x}_{c}", 1 - shift + n) for x in "sn")
            out[f"{prefix}{c}_r{n}"] = F.when(k >= min_observations(n), s / k)
    return out


def _days_since(start, base):
    return F.datediff(F.to_date(start), F.to_date(F.lag(start).over(base)))


# ---- form tables ---------------------------------------------------------------------------------


def _appearances(players: DataFrame, games: DataFrame, group: str) -> DataFrame:
    return players.filter(F.col("grp") == group).join(games.select("event_id", "start_ts"), "event_id")


def _plate_rates(b: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    b = b.withColumn("pa", F.greatest(zero("at_bats") + zero("walks"), F.lit(0.0)))
    return b.withColumns({f"{c}_ppa": F.when(F.col("pa") > 0, F.try_divide(zero(c), F.col("pa"))) for c in BATTING})


def _outing_rates(p: DataFrame) -> DataFrame:
    outs = F.when(F.col("outs") > 0, F.col("outs"))
    return p.withColumns({
        "is_start": F.when(F.col("outs") >= START_OUTS, 1.0).otherwise(0.0),
        "k_per_out": F.try_divide("strike_outs", outs),
        "pitch_per_out": F.try_divide("pitch_count", outs),
    })


BATTER_COLS = tuple(f"{c}_ppa" for c in BATTING) + ("pa",)
PITCHER_COLS = PITCHING + ("k_per_out", "pitch_per_out", "is_start")
TEAM_COLS = tuple(f"tm_{c}_ppa" for c in BATTING)
SIDE_COLS = ("runs_for", "runs_against", "won")


def _keep(df: DataFrame, keys, prefix: str) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c.startswith(prefix) and ("_r" in c or "_exp" in c or c.endswith(("prior_games", "days_rest")))])


def batter_form(players: DataFrame, games: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per (athlete, game): seven rates per plate appearance and the appearances, from earlier games."""
    b = _plate_rates(_appearances(players, games, "batting"))
    f = lagged_form(b.select("event_id", "athlete_id", "team", "start_ts", *BATTER_COLS), "athlete_id", "start_ts", "event_id",
                    BATTER_COLS, BATTER_WINDOWS, "bat_", "bat_prior_games", "bat_days_rest", chunk_rows)
    return _keep(f, ["event_id", "athlete_id", "team"], "bat_")


def pitcher_form(players: DataFrame, games: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    p = _outing_rates(_appearances(players, games, "pitching"))
    f = lagged_form(p.select("event_id", "athlete_id", "team", "start_ts", *PITCHER_COLS), "athlete_id", "start_ts", "event_id",
                    PITCHER_COLS, PITCHER_WINDOWS, "pit_", "pit_prior_games", "pit_days_rest", chunk_rows)
    return _keep(f, ["event_id", "athlete_id", "team"], "pit_")


def team_games(players: DataFrame, games: DataFrame) -> DataFrame:
    """Batting totals per team and game, as rates per plate appearance."""
    b = _appearances(players, games, "batting")
    t = b.groupBy("team", "event_id", "start_ts").agg(*[F.sum(c).alias(c) for c in (*BATTING, "at_bats")])
    pa = F.coalesce("at_bats", F.lit(0.0)) + F.coalesce("walks", F.lit(0.0))
    return t.select("team", "event_id", "start_ts", *[
        F.when(pa > 0, F.try_divide(F.coalesce(c, F.lit(0.0)), pa)).alias(f"tm_{c}_ppa") for c in BATTING])


def team_form(players: DataFrame, games: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    f = lagged_form(team_games(players, games), "team", "start_ts", "event_id", TEAM_COLS, TEAM_WINDOWS, "", chunk_rows=chunk_rows)
    return f.select("team", "event_id", "start_ts", *[c for c in f.columns if c.startswith("tm_") and c not in TEAM_COLS])


def park_totals(games: DataFrame) -> DataFrame:
    return games.select("event_id", "venue", "start_ts", (F.col("home_score") + F.col("away_score")).alias("total_runs"))


def park_form(games: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return lagged_form(park_totals(games), "venue", "start_ts", "event_id", ["total_runs"], PARK_WINDOWS, "park_", chunk_rows=chunk_rows).drop("total_runs")


def game_sides(games: DataFrame) -> DataFrame:
    """Each game from both sides: runs scored and conceded, and whether it was won."""
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opp"), F.lit(1).alias("is_home"),
                 F.col("home_score").alias("runs_for"), F.col("away_score").alias("runs_against")),
        F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opp"), F.lit(0).alias("is_home"),
                 F.col("away_score").alias("runs_for"), F.col("home_score").alias("runs_against")),
    )
    d = games.select("event_id", "start_ts", F.inline(sides))
    return d.withColumn("won", F.when(F.col("runs_for") > F.col("runs_against"), 1.0).otherwise(0.0))


def game_context(games: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each game from both sides, with the team's earlier scoring, conceding and winning."""
    f = lagged_form(game_sides(games), "team", "start_ts", "event_id", list(SIDE_COLS), CONTEXT_WINDOWS, "tg_", chunk_rows=chunk_rows)
    return f.drop(*SIDE_COLS)


def pending_form(
    appearances: DataFrame, entity: str, start: str, tie: str, cols, windows, prefix: str, as_of: str,
    prior: str | None = None, rest: str | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Form of every entity for a game that starts at ``as_of`` and has not been played.

    The same numbers as a placeholder appearance sent through ``lagged_form``, without sorting the history:
    the recent windows need only the last rows of an entity, which map tasks pick before the shuffle, and the
    expanding mean is a plain aggregate.
    """
    past = appearances.filter(F.col(start) < F.to_timestamp(F.lit(as_of)))
    latest = Window.partitionBy(entity).orderBy(F.col(start).desc(), F.col(tie).desc())
    tail = past.withColumn("__rn", F.row_number().over(latest)).filter(F.col("__rn") <= max(windows))
    recent = []
    for c in cols:
        for n in windows:
            x = F.when(F.col("__rn") <= n, F.col(c))
            recent.append(F.when(F.count(x) >= min_observations(n), F.avg(x)).alias(f"{prefix}{c}_r{n}"))
    last = [F.max(F.when(F.col("__rn") == 1, F.col(c))).alias(c) for c in keep]
    whole = [F.when(F.count(c) >= 3, F.avg(c)).alias(f"{prefix}{c}_exp") for c in cols]
    if prior:
        whole.append(F.count("*").alias(prior))
    if rest:
        whole.append(F.datediff(F.to_date(F.lit(as_of)), F.to_date(F.max(start))).alias(rest))
    return tail.groupBy(entity).agg(*last, *recent).join(past.groupBy(entity).agg(*whole), entity)


def pending_batters(players: DataFrame, games: DataFrame, as_of: str) -> DataFrame:
    b = _plate_rates(_appearances(players, games, "batting"))
    return pending_form(b, "athlete_id", "start_ts", "event_id", BATTER_COLS, BATTER_WINDOWS, "bat_", as_of,
                        "bat_prior_games", "bat_days_rest", ("team",))


def pending_pitchers(players: DataFrame, games: DataFrame, as_of: str) -> DataFrame:
    p = _outing_rates(_appearances(players, games, "pitching"))
    return pending_form(p, "athlete_id", "start_ts", "event_id", PITCHER_COLS, PITCHER_WINDOWS, "pit_", as_of,
                        "pit_prior_games", "pit_days_rest", ("team",))


def latest_per_entity(form: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Most recent row per entity."""
    return first_per_key(form, [entity], [F.col(c).desc() for c in order])


def start_buckets(events: DataFrame, start: str = "start_ts", minutes: int = 30, lead_minutes: int = 30) -> DataFrame:
    """Bucket of each start and the one snapshot instant that serves the bucket: its earliest start less the lead.

    Aggregates the buckets and joins them back, so a crowded bucket is combined before the shuffle.
    """
    bucketed = events.withColumn("bucket", F.window(start, f"{minutes} minutes")["start"])
    first = bucketed.groupBy("bucket").agg(
        (F.min(start) - F.expr(f"INTERVAL {lead_minutes} MINUTES")).alias("snapshot_ts"), F.count("*").alias("n_events"))
    return bucketed.join(first, "bucket")
