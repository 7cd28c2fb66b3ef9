"""Matching, settlement, consensus and gate rules on small known cases."""
import pytest
from pyspark.sql import functions as F

from catalog.adapters import TEST_BOOKS
from quotelab.operators import audit as A
from quotelab.operators import consensus as C
from quotelab.operators import evaluate as E
from quotelab.operators import gate as G
from quotelab.operators import match as M
from quotelab.functions.names import person_key
from quotelab.functions.times import date_range, format_iso, parse_iso
from quotelab.operators import settle as S
from quotelab.sources import results as R
from quotelab.operators.keys import PROPOSITION, null_safe_join


def test_doubleheader_claims_each_game_once(spark):
    games = spark.createDataFrame([("g1", "A", "B", "2024-06-01 17:00:00"), ("g2", "A", "B", "2024-06-01 23:00:00")], "game_id string, home_team string, away_team string, t string")
    ev = spark.createDataFrame([("e1", "A", "B", "2024-06-01 17:10:00"), ("e2", "A", "B", "2024-06-01 22:50:00"), ("e3", "A", "B", "2024-06-01 17:40:00"), ("e4", "B", "A", "2024-06-01 17:00:00")], "event_id string, home_team string, away_team string, t string")
    ts = lambda d: d.withColumn("start_ts", F.to_timestamp("t"))
    got = {r.event_id: r.game_id for r in M.match_games(ts(ev), ts(games)).collect()}
    assert got == {"e1": "g1", "e2": "g2", "e3": None, "e4": None}


@pytest.mark.parametrize("similarity", ["edit", "ratio"])
def test_name_cascade(spark, similarity):
    roster = spark.createDataFrame([(1, 10, "José Ramírez"), (1, 11, "Gunnar Henderson"), (1, 12, "Will Smith"), (1, 13, "Josh Smith"), (2, 20, "Solo Player")], "scope_id int, entity_id int, canon_name string")
    asked = [(1, "Jose Ramirez Jr."), (1, "G. Henderson"), (1, "Bobby Ramirez"), (1, "Smith"), (1, "Gunnar Hendersen"), (1, "Nobody Here"), (9, "Solo Player")]
    got = {r.book_name: (r.entity_id, r.match_how) for r in M.resolve_names(spark.createDataFrame(asked, "scope_id int, book_name string"), roster, similarity).collect()}
    assert got == {"Jose Ramirez Jr.": (10, "exact"), "G. Henderson": (11, "initial_last"), "Bobby Ramirez": (10, "last_name"), "Smith": (None, "unmatched"),
                   "Gunnar Hendersen": (11, "fuzzy"), "Nobody Here": (None, "unmatched"), "Solo Player": (None, "no_game")}


def test_names_lose_accents_beyond_latin_1(spark):
    names = [("Nikola Jokić", "nikola jokic"), ("Antonín Dvořák Jr.", "antonin dvorak"), ("Ağa Şahin", "aga sahin"), ("Nguyễn Ổn", "nguyen on"), ("O\u0301scar", "oscar")]
    got = spark.createDataFrame(names, "name string, want string").select(person_key(F.col("name")).alias("key"), "want").collect()
    assert [r.key for r in got] == [r.want for r in got]


def test_string_ids(spark):
    bets = spark.range(3000).select(F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("market"), F.concat(F.lit("ev"), F.hex(F.col("id") % 700)).alias("event_id"), F.concat(F.lit("b"), "id").alias("bet_id"),
                                    F.when(F.col("id") % 5 < 2, 1.1).otherwise(-1.0).alias("profit"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("game_date"))
    boot = {r.market: r for r in E.bootstrap(bets, ["market"], 300).collect()}
    assert all(r.roi_lo < r.roi < r.roi_hi and r.n_clusters == 350 for r in boot.values())
    last = E.most_recent(bets, ["market"], 100, "bet_id").collect()
    by_market = {m: sorted(((r.game_date, r.bet_id) for r in bets.collect() if r.market == m))[-100:] for m in ("m0", "m1")}
    assert sorted((r.market, r.game_date, r.bet_id) for r in last) == sorted((m, *x) for m, rows in by_market.items() for x in rows)


def test_box_score_with_repeated_and_empty_keys(spark, tmp_path):
    import json

    line = {"team": {"abbreviation": "T"}, "statistics": [{"keys": ["atBats", "hits", None, "hits", "runs"], "athletes": [{"athlete": {"id": "7", "displayName": "A"}, "stats": ["4", "1", "9", "2"]}]}]}
    (tmp_path / "one.json").write_text(json.dumps({"header": {"id": "g", "competitions": []}, "boxscore": {"players": [line]}, "plays": []}))
    row = R.player_rows(R.read_summaries(spark, str(tmp_path))).first()
    assert (row.at_bats, row.hits, row.runs) == (4.0, 2.0, 0.0)


def test_close_keys_find_every_close_pair(spark):
    words = [f"{a}{b} {c}{d}son" for a in ("mar", "mark", "max") for b in ("o", "ello") for c in ("ander", "hend", "will") for d in ("s", "ers", "")]
    names = spark.createDataFrame([(1, w, i) for i, w in enumerate(words)], "scope_id int, key string, entity_id int")
    asked = names.select("scope_id", F.concat("key", F.lit("x")).alias("key"), F.col("key").alias("book_name"))
    far = F.levenshtein("a.key", "b.key")
    want = {r.book_name for r in asked.alias("a").join(names.alias("b"), far <= 0.12 * F.greatest(F.length("a.key"), F.length("b.key"))).select("book_name").collect()}
    assert {r.book_name for r in M.close_keys(asked, names).collect()} == want


def quotes(spark, rows):
    return spark.createDataFrame([(1, "totals", "game", ln, side, b, p, "decision") for ln, side, b, p in rows], "event_id int, market string, subject string, line double, side string, book string, price double, tag string")


def test_leave_one_out_excludes_own_book_and_null_lines_match(spark):
    base = [(None, s, b, p) for b, p in (("b0", -110.0), ("b1", -110.0), ("b2", -110.0)) for s in ("over", "under")]
    q = quotes(spark, base + [(None, "over", "b3", 200.0), (None, "under", "b3", -250.0), (None, "over", "b4", 120.0), (None, "over", "b17", -105.0), (None, "under", "b17", -105.0)])
    d = {(r.book, r.side): r for r in C.attach_consensus(q, books=TEST_BOOKS).collect()}
    assert len(d) == 11
    assert d["b3", "over"].p_cons == pytest.approx(0.5) and d["b3", "over"].n_books_cons == 3
    assert d["b0", "over"].p_cons < 0.5 and d["b0", "over"].n_books_cons == 3
    assert d["b4", "over"].p_book_fair is None and d["b4", "over"].n_books_cons == 4 and d["b4", "over"].p_cons < 0.5
    assert d["b17", "over"].n_books_cons == 4


def test_self_anchor(spark):
    q = quotes(spark, [(1.5, "over", "b0", 120.0), (1.5, "under", "b0", -140.0)])
    assert C.attach_consensus(q, books=TEST_BOOKS).first().p_cons is None
    r = C.attach_consensus(q, books=TEST_BOOKS, self_anchor=("totals",)).first()
    assert r.p_cons == pytest.approx(r.p_book_fair) and r.n_books_cons == 1 and r.self_anchored


def test_settlement(spark):
    games = spark.createDataFrame([(1, 5.0, 3.0)], "game_id int, home_score double, away_score double")
    stats = ("hits", "total_bases", "home_runs", "rbi", "runs", "strike_outs", "outs", "at_bats", "walks", "pitches_seen")
    players = spark.createDataFrame([(1, 7, "batting", 2.0, 4.0, 1.0, 1.0, 1.0, 0.0, None, 4.0, 0.0, 15.0), (1, 8, "batting", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, 0.0)],
                                    "event_id int, athlete_id int, grp string, " + ", ".join(f"{c} double" for c in stats))
    rows = [("h2h", None, "home", None, "win"), ("h2h", None, "away", None, "loss"), ("spreads", None, "home", -2.0, "push"), ("spreads", None, "away", -2.5, "win"), ("totals", None, "over", 8.0, "push"), ("totals", None, "under", 8.5, "win"),
            ("batter_hits", 7, "over", 1.5, "win"), ("batter_hits", 8, "under", 0.5, "void"), ("batter_hits", 9, "under", 0.5, "void"), ("totals", None, "over", None, "void"), ("batter_hits", 7, "over", None, "void")]
    q = spark.createDataFrame([(1, *r) for r in rows] + [(2, "h2h", None, "home", None, "void")], "game_id int, market string, athlete_id int, side string, line double, want string")
    assert S.grade(q, games, players).filter("result <> want").count() == 0


@pytest.mark.parametrize("last,survivors", [(0.042, 5), (0.30, 2)])
def test_step_up_procedure(spark, last, survivors):
    p = spark.createDataFrame([(f"m{i}", v) for i, v in enumerate((0.001, 0.008, 0.039, 0.041, last))], "market string, p_value double")
    assert E.benjamini_hochberg(p).filter("survives").count() == survivors


def ledger(spark, edge, n=4000, late=0.0):
    u = F.pmod(F.xxhash64("id"), F.lit(100003)) / 100003.0
    d = spark.range(n).withColumn("p", F.lit(0.5) + edge - F.when(F.col("id") >= n * 2 // 3, late).otherwise(0.0))
    win = u < F.col("p")
    return d.select(F.col("id").alias("bet_id"), F.lit("m").alias("market"), (F.col("id") / 3).cast("bigint").alias("event_id"), F.lit("b1").alias("book"), F.lit(100.0).alias("price"), F.lit("direct").alias("anchor_src"),
                    F.date_add(F.lit("2024-01-01"), (F.col("id") * 600 / n).cast("int")).alias("game_date"), (F.col("id") * 10 / n).cast("int").alias("fold"), F.lit(0.05).alias("ev"),
                    (F.col("p") + F.pmod("id", F.lit(100)) / 1e4 - 0.005).alias("p_model"), F.when(win, "win").otherwise("loss").alias("result"), F.when(win, 1.0).otherwise(-1.0).alias("profit"))


@pytest.mark.parametrize("kw,cause,deployment", [
    (dict(edge=0.06), "", "live"), (dict(edge=0.0), ("no_edge", "negative_edge"), None), (dict(edge=-0.05), "negative_edge", "killed"),
    (dict(edge=0.06, n=80), "insufficient_sample", "killed"), (dict(edge=0.09, late=0.16), "edge_decayed", "veto_filtered")])
def test_gate_names_the_cause(spark, kw, cause, deployment):
    r = G.judge(G.metrics(ledger(spark, **kw), books=TEST_BOOKS, n_boot=500)).first()
    assert r.cause in cause if isinstance(cause, tuple) else r.cause == cause
    assert deployment is None or r.deployment == deployment


def test_leak_outranks_profit(spark):
    b = ledger(spark, 0.06)
    r = G.judge(G.metrics(b, books=TEST_BOOKS, n_boot=200), b.select("market")).first()
    assert (r.verdict, r.cause, r.deployment) == ("VETO", "leakage", "killed") and r.checks["leakage"] is False


def test_clustered_interval_is_wider(spark):
    same = spark.range(3000).select(F.lit("m").alias("market"), (F.col("id") / 10).cast("int").alias("event_id"), F.when(F.pmod(F.xxhash64((F.col("id") / 10).cast("int")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("profit"))
    alone = same.withColumn("event_id", F.monotonically_increasing_id() % 100000)
    a, b = (E.bootstrap(d, ["market"], 1000).first() for d in (same, alone))
    assert a.roi_hi - a.roi_lo > 2 * (b.roi_hi - b.roi_lo)


def test_late_quote_vetoes(spark):
    q = spark.createDataFrame([(10.0,), (None,)], "lead_min double")
    f = A.audit(A.quote_timing(q)).first()
    assert f.severity == "veto" and f.vetoed and f.n == 1


def test_null_safe_join_keeps_null_keys(spark):
    a = spark.createDataFrame([(1, "h2h", "game", None, 1), (1, "h2h", "game", 2.0, 2)], "event_id int, market string, subject string, line double, v int")
    b = a.drop("v").withColumn("w", F.lit(1))
    j = null_safe_join(a, b, PROPOSITION, "inner")
    assert j.count() == 2 and "Cartesian" not in j._jdf.queryExecution().toString() and "NestedLoop" not in j._jdf.queryExecution().toString()


def test_verdict_names_the_failed_numbers(spark):
    row = [("a", 500, 400, 0.05, 0.01, 0, None, 6, 0.7, 0.3, False, 0.01, 0.01, 100, 0.02, 0.01), ("b", 120, 90, 0.05, 0.01, 0, None, 6, 0.7, 0.3, False, 0.01, 0.01, 100, 0.02, 0.01)]
    m = spark.createDataFrame(row, "market string, n_bets long, n_games long, roi double, roi_lo double, clv_n long, clv_mean double, n_folds long, fold_win_rate double, max_fold_share double, "
                              "decayed boolean, cal_error double, cal_noise_floor double, recent_n long, recent_roi double, p_value double")
    got = {r.market: (r.verdict, r.lever) for r in G.judge(m).collect()}
    assert got == {"a": ("PASS", ""), "b": ("FAIL", "n_bets 120.0 (>= 300), n_games 90.0 (>= 150)")}


def test_dates_and_iso_text(spark):
    days = [str(r.date) for r in date_range(spark, "2024-02-27", "2024-03-01").collect()]
    assert days == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"]
    texts = ["2024-06-01T18:00:00Z", "2024-06-01T18:00Z", "2024-06-01T20:00:00+02:00", "no date"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(format_iso(parse_iso(F.col("t"))).alias("t")).collect()]
    assert got == ["2024-06-01T18:00:00Z"] * 3 + [None]


def test_equal_bets_and_equal_payouts_have_one_winner(spark):
    """+100 and -100 pay the same, and both sides can be worth the same: the order of the rows does not decide."""
    from quotelab.operators import frames as FR

    cols = "event_id long, market string, subject string, line double, side string, book string, tag string, price double, p_cons double, ev_cal double"
    rows = [(1, "m", "g", None, s, "b0", "decision", p, 0.5, 0.1) for s in ("under", "over") for p in (-100.0, 100.0)]
    for some in (rows, rows[::-1]):
        d = spark.createDataFrame(some, cols).coalesce(1)
        got = FR.candidates(d, books=FR.Books(weights={}, tiers={}, bettable=("b0",), dfs=(), major=()))
        assert sorted((r.side, r.price) for r in got.collect()) == [("over", 100.0), ("under", 100.0)]
        best = E.one_bet(d, ["event_id", "market", "subject"], "ev_cal", ["book"]).collect()
        assert [(r.side, r.price) for r in best] == [("over", -100.0)]
