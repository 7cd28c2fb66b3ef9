"""Views that give the driver's tables the shape of quotes, statistics, games, names and bets.

Each view is one SELECT that reads the same in Spark and in DuckDB; Spark runs it over the Parquet tables, the
oracles use it as a common table expression.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.dims import Books

QUOTES = """
SELECT event_id, market, 'game' AS subject, line, side, book, l_orderkey AS src_order, l_linenumber AS src_line, l_suppkey AS src_supp,
       CASE WHEN raw >= 0.5e0 THEN -round(100 * raw / (1 - raw)) ELSE round(100 * (1 - raw) / raw) END AS price,
       CAST(20 + (l_orderkey % 70) AS DOUBLE) AS lead_min,
       CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'closing' ELSE 'decision' END AS tag,
       CAST(event_id % 900 AS INT) AS day_no
FROM (
  SELECT r.*, s.side,
         CASE WHEN s.side = 'over' THEN least(greatest(p_true + noise + hold / 2, 0.03e0), 0.97e0)
              ELSE least(greatest(1 - p_true - noise + hold / 2, 0.03e0), 0.97e0) END AS raw
  FROM (
    SELECT l_partkey AS event_id, l_orderkey, l_suppkey, l_linenumber, l_linestatus,
           CASE l_returnflag WHEN 'A' THEN 'totals' WHEN 'N' THEN 'batter_hits' ELSE 'h2h' END AS market,
           CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS DOUBLE) ELSE (l_linenumber % 2) + 0.5e0 END AS line,
           concat('b', CAST(l_suppkey % 20 AS VARCHAR(4))) AS book,
           0.30e0 + 0.40e0 * ((l_partkey * 7919) % 1000) / 1000.0e0
             - CASE WHEN l_returnflag <> 'R' AND l_linenumber % 2 = 1 THEN 0.15e0 ELSE 0.0e0 END AS p_true,
           ((l_suppkey * 104729 + l_orderkey * 1299709 + l_linenumber * 7) % 1000) / 1000.0e0 * 0.06e0 - 0.03e0 AS noise,
           0.02e0 + 0.01e0 * (l_suppkey % 5) AS hold
    FROM {lineitem}) r
  JOIN (SELECT 'over' AS side UNION ALL SELECT 'under') s ON s.side = 'over' OR r.l_linenumber <> 7) q"""

STATS = """
SELECT p_partkey AS event_id, m.market,
       CAST(CASE WHEN u < p THEN 1 ELSE 0 END + CASE WHEN u < p - 0.15e0 THEN 1 ELSE 0 END AS DOUBLE) AS stat_value
FROM (SELECT p_partkey, k.market,
             ((p_partkey * 48271 + k.salt * 6007) % 1000) / 1000.0e0 AS u,
             0.30e0 + 0.40e0 * ((p_partkey * 7919) % 1000) / 1000.0e0 AS p
      FROM {part} CROSS JOIN (SELECT 'totals' AS market, 1 AS salt UNION ALL SELECT 'batter_hits', 2
                            UNION ALL SELECT 'h2h', 3) k) m"""

GAMES = """
SELECT o_orderkey AS game_id, o_orderdate AS start_ts, o_orderpriority AS venue,
       o_custkey % 10 AS home_team, (o_custkey % 10 + 1 + o_orderkey % 3) % 10 AS away_team,
       CAST((o_orderkey * 7 + 3) % 11 AS DOUBLE) AS home_score,
       CAST((o_orderkey * 5 + o_custkey) % 11 AS DOUBLE) AS away_score
FROM {orders}"""

NAMES = """
SELECT c_custkey AS entity_id, c_nationkey AS scope_id,
       concat(f, ' ', l) AS canon_name,
       CASE c_custkey % 6 WHEN 0 THEN concat(f, ' ', l) WHEN 1 THEN concat(upper(f), ' ', l, ' Jr.')
         WHEN 2 THEN concat(substr(f, 1, 1), '. ', l) WHEN 3 THEN concat(f, ' ', l, ' (2002)')
         WHEN 4 THEN replace(concat(f, ' ', l), 'e', 'é') ELSE concat(f, ' ', substr(l, 1, 4), 'x', substr(l, 6)) END AS book_name
FROM (SELECT c_custkey, c_nationkey, concat('Name', substr('abcdefghij', CAST(c_custkey % 10 AS INT) + 1, 1)) AS f,
             concat('Keller', substr('klmnopqrst', CAST((c_custkey * 3) % 10 AS INT) + 1, 1),
                    substr('uvwxyzabcd', CAST(floor((c_custkey * 7919 % 100) / 10.0e0) AS INT) + 1, 1)) AS l
      FROM {customer}) t"""

BETS = """
SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS bet_id, l_orderkey AS event_id, l_partkey AS subject_id, concat('m', CAST(l_suppkey % 11 AS VARCHAR(4))) AS market,
       concat('b', CAST(l_suppkey % 20 AS VARCHAR(4))) AS book,
       CASE WHEN l_partkey % 4 = 0 THEN 'ladder' ELSE 'direct' END AS anchor_src,
       l_shipdate AS game_date, CAST(l_orderkey % 14 AS INT) AS fold,
       price, p_raw, p_raw + edge AS p_model,
       CASE WHEN u < p_raw + edge / 2 - 0.01e0 THEN 'win' WHEN u > 0.99e0 THEN 'push' ELSE 'loss' END AS result,
       CASE WHEN u < p_raw + edge / 2 - 0.01e0 THEN (1 - p_raw) / p_raw WHEN u > 0.99e0 THEN 0.0e0 ELSE -1.0e0 END AS profit,
       (p_raw + edge) / p_raw - 1 AS ev,
       CAST(1 + l_suppkey % 12 AS DOUBLE) AS n_books_cons, CAST(20 + l_orderkey % 70 AS DOUBLE) AS lead_min
FROM (SELECT t.*, CASE WHEN p_raw >= 0.5e0 THEN -100 * p_raw / (1 - p_raw) ELSE 100 * (1 - p_raw) / p_raw END AS price
      FROM (SELECT l.*, 0.20e0 + 0.60e0 * ((l_partkey * 7919 + l_suppkey * 31) % 1000) / 1000.0e0 AS p_raw,
                   -0.02e0 + 0.10e0 * ((l_orderkey * 613 + l_linenumber * 101) % 1000) / 1000.0e0 AS edge,
                   ((l_orderkey * 48271 + l_linenumber * 7907 + l_partkey * 17) % 10007) / 10007.0e0 AS u
            FROM {lineitem} l) t) x"""

PLAYERS = """
SELECT l_orderkey AS event_id, l_partkey AS athlete_id, CASE WHEN l_returnflag = 'R' THEN 'pitching' ELSE 'batting' END AS grp,
       max(l_suppkey % 10) AS team, CAST(max(l_linenumber % 5) AS DOUBLE) AS at_bats,
       CAST(max(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey % 3 END) AS DOUBLE) AS walks,
       CAST(max((l_orderkey + l_suppkey) % 4) AS DOUBLE) AS hits, CAST(max((l_orderkey * 3 + l_suppkey) % 7) AS DOUBLE) AS total_bases,
       CAST(max(l_linenumber % 2) AS DOUBLE) AS home_runs, CAST(max(l_orderkey % 5) AS DOUBLE) AS rbi,
       CAST(max((l_orderkey + l_linenumber) % 4) AS DOUBLE) AS runs, CAST(max((l_suppkey + l_linenumber) % 4) AS DOUBLE) AS strike_outs,
       CAST(max(l_linenumber * 2) AS DOUBLE) AS pitches_seen, CAST(max(l_suppkey % 28) AS DOUBLE) AS outs,
       CAST(max(l_orderkey % 9) AS DOUBLE) AS hits_allowed, CAST(max(l_orderkey % 6) AS DOUBLE) AS earned_runs,
       CAST(max(l_suppkey % 2) AS DOUBLE) AS home_runs_allowed, CAST(max(20 + l_orderkey % 80) AS DOUBLE) AS pitch_count
FROM {lineitem} GROUP BY 1, 2, 3"""

_VIEWS = {
    "players_v": (PLAYERS, "lineitem"),
    "quotes_v": (QUOTES, "lineitem"),
    "stats_v": (STATS, "part"),
    "games_v": (GAMES, "orders"),
    "names_v": (NAMES, "customer"),
    "bets_v": (BETS, "lineitem"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = _VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


#: Added before rounding to six places on both engines: averages of short decimals often end in an exact half,
#: where the last bit of a sum would decide.
OFF_TIE = 1.2345678e-9


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c + F.lit(OFF_TIE), 6)
    return out.alias(name) if name else out


def off_tie(sql: str) -> str:
    """The oracle's ``round(x, 6) AS c`` with the same offset."""
    return sql.replace(", 6) AS", f" + {OFF_TIE}, 6) AS")


def ctes(*names: str) -> str:
    """``WITH`` prefix that defines the named views for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({_VIEWS[n][0].replace('{' + _VIEWS[n][1] + '}', _VIEWS[n][1])})" for n in names)


#: The book dimension of the test tables: twenty books b0 to b19.
_WEIGHT = {f"b{i}": round(1.0 - 0.05 * i, 2) for i in range(16)}
_TIER = {f"b{i}": i % 4 for i in range(20)}
TEST_BOOKS = Books(
    weights=_WEIGHT,
    tiers=_TIER,
    bettable=tuple(f"b{i}" for i in range(18)),
    dfs=("b17",),
    major=tuple(f"b{i}" for i in range(7)),
)

BOOKS_CTE = (
    "books AS (SELECT concat('b', CAST(i AS VARCHAR)) AS book, CASE WHEN i < 16 THEN round(1.0e0 - 0.05e0 * i, 2) ELSE 0.1e0 END AS w0, "
    "i % 4 AS tier, i = 17 AS dfs, i < 17 AS can_bet, i < 7 AS major FROM range(20) t(i))"
)

#: Two-sided book views and consensus of the decision quotes, as an oracle prefix.
CONSENSUS_CTE = """
bv0 AS (SELECT event_id, market, subject, line, tag, book,
         max(CASE WHEN side = 'over' THEN price END) AS price_over, max(CASE WHEN side = 'under' THEN price END) AS price_under
       FROM q GROUP BY ALL),
bv1 AS (SELECT *, CASE WHEN price_over > 0 THEN 100 / (price_over + 100) ELSE abs(price_over) / (abs(price_over) + 100) END AS ro,
         CASE WHEN price_under > 0 THEN 100 / (price_under + 100) ELSE abs(price_under) / (abs(price_under) + 100) END AS ru
       FROM bv0 WHERE price_over IS NOT NULL AND price_under IS NOT NULL),
bv AS (SELECT bv1.*, ro + ru - 1 AS hold,
         CASE WHEN ro + ru <= 1 + 1e-9 THEN ro / (ro + ru) ELSE least(greatest(ro - (ro + ru - 1) / 2, 1e-9), 1 - 1e-9) END AS p_over,
         CASE WHEN b.dfs OR ro + ru - 1 > 0.35e0 THEN 0.0e0 ELSE b.w0 END AS w
       FROM bv1 JOIN books b USING (book)),
bl AS (SELECT *, ln(least(greatest(p_over, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_over, 1e-6), 1 - 1e-6))) AS l FROM bv),
cons AS (SELECT *, sum(w) OVER p AS sw, sum(w * l) OVER p AS swl, count(*) OVER p AS n_books,
         count(*) FILTER (WHERE w > 0) OVER p AS n_books_w
       FROM bl WINDOW p AS (PARTITION BY event_id, market, subject, line, tag)),
loo AS (SELECT *, n_books_w - CASE WHEN w > 0 THEN 1 ELSE 0 END AS n_books_loo,
         CASE WHEN n_books_w >= 2 AND sw > 0 THEN 1 / (1 + exp(-(swl / sw))) END AS p_cons_all,
         CASE WHEN n_books_w - CASE WHEN w > 0 THEN 1 ELSE 0 END >= 2 AND sw - w > 0
              THEN 1 / (1 + exp(-((swl - w * l) / (sw - w)))) END AS p_cons_loo
       FROM cons)"""

#: Every quote with the consensus it is judged against; needs q, books and the consensus prefix.
ATTACH_CTE = """
prop AS (SELECT event_id, market, subject, line, tag, max(p_cons_all) AS p_all, max(n_books_w) AS n_w FROM loo GROUP BY ALL),
judged AS (SELECT q.*, loo.p_over AS p_book_fair, loo.hold AS hold_book,
         CASE WHEN loo.book IS NOT NULL THEN loo.p_cons_loo ELSE prop.p_all END AS p_cons,
         CAST(CASE WHEN loo.book IS NOT NULL THEN loo.n_books_loo ELSE prop.n_w END AS DOUBLE) AS n_books_cons,
         CAST(prop.n_w AS DOUBLE) AS n_books_prop
       FROM q LEFT JOIN prop ON q.event_id = prop.event_id AND q.market = prop.market AND q.subject = prop.subject
           AND q.line IS NOT DISTINCT FROM prop.line AND q.tag = prop.tag
         LEFT JOIN loo ON q.event_id = loo.event_id AND q.market = loo.market AND q.subject = loo.subject
           AND q.line IS NOT DISTINCT FROM loo.line AND q.tag = loo.tag AND q.book = loo.book)"""

PAYOUT = "(CASE WHEN {0} > 0 THEN {0} / 100 ELSE 100.0e0 / abs({0}) END)"
RAW = "(CASE WHEN {0} > 0 THEN 100 / ({0} + 100) ELSE abs({0}) / (abs({0}) + 100) END)"
LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
LOGLOSS = ("-({0} * ln(least(greatest({1}, {2}), 1 - {2})) + (1 - {0}) * ln(1 - least(greatest({1}, {2}), 1 - {2})))")
