"""Quotes, prices, margins and consensus."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import (ATTACH_CTE, BOOKS_CTE, CONSENSUS_CTE, LOGIT, PAYOUT, RAW, TEST_BOOKS, ctes, view)
from catalog.adapters import r6 as R
from quotelab.functions import pricing as P
from quotelab.operators import consensus as C
from quotelab.operators import normalize as N



def best_price_ev(spark, sf):
    q = view(spark, sf, "quotes_v").filter("tag = 'decision'")
    d = C.best_prices(q, books=TEST_BOOKS)
    return d.select(
        "event_id", "market", "line", F.when(F.col("over"), "over").otherwise("under").alias("side"), "book", "price",
        R(F.col("p_side"), "p_side"), R(F.col("ev"), "ev"), F.col("n_books_cons").cast("bigint").alias("n_books"),
    )


BEST_PRICE_SQL = f"""{ctes('quotes_v')}, {BOOKS_CTE}, q AS (SELECT * FROM quotes_v WHERE tag = 'decision'), {CONSENSUS_CTE}, {ATTACH_CTE},
cand AS (SELECT event_id, market, line, side, book, price, n_books_cons, CASE WHEN side = 'over' THEN p_cons ELSE 1 - p_cons END AS p_side,
    row_number() OVER (PARTITION BY event_id, market, line, side ORDER BY {PAYOUT.format('price')} DESC, book) AS rn
  FROM judged JOIN books USING (book) WHERE can_bet AND p_cons IS NOT NULL)
SELECT event_id, market, line, side, book, price, round(p_side, 6) AS p_side,
  round(p_side * {PAYOUT.format('price')} - (1 - p_side), 6) AS ev, CAST(n_books_cons AS BIGINT) AS n_books
FROM cand WHERE rn = 1"""


def _raw_quotes(spark, sf):
    """Quotes put back into feed form: outcome names, points as text, regions, the odd broken price."""
    q = view(spark, sf, "quotes_v")
    h2h, away = F.col("market") == "h2h", F.col("side") == "under"
    k = F.col("src_supp") % 3
    return q.select(
        "event_id", "market", "subject", "book", "tag", "src_order", "src_line", "src_supp",
        F.when(h2h, "featured").when(F.col("market") == "totals", "featured").otherwise("prop").alias("kind"),
        F.when(h2h & away, "Away Club").when(h2h, "Home Club").when(away, F.when(k == 0, " NO").otherwise("Under"))
        .otherwise(F.when(k == 0, "yes ").otherwise("Over")).alias("name"),
        F.col("line").cast("string").alias("point"),
        F.when(F.col("src_order") % 97 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(k == 0, "us").when(k == 1, "eu").otherwise("us_ex").alias("region"),
        (F.col("lead_min") - 22).alias("lead_min"),
    )


def quote_normalise(spark, sf):
    raw = _raw_quotes(spark, sf)
    side = N.outcome_side(F.col("kind"), F.col("market"), F.col("name"), F.lit("Home Club"), F.lit("Away Club"))
    d = raw.withColumn("side", side).filter(F.col("side").isNotNull())
    d = d.withColumn("line", N.outcome_line(F.col("market"), F.col("side"), N.number(F.col("point"))))
    d = N.finish(d, books=TEST_BOOKS, tie=["src_order", "src_line", "src_supp"])
    return d.select("event_id", "market", "side", "line", "book", "tag", "region", "price", "lead_min",
                    F.col("tier").cast("bigint").alias("tier"))


QUOTE_NORMALISE_SQL = f"""{ctes('quotes_v')}, raw AS (
  SELECT *, CASE WHEN market = 'h2h' THEN CASE side WHEN 'over' THEN 'home' ELSE 'away' END ELSE side END AS s,
    src_supp % 3 AS reg FROM quotes_v WHERE src_order % 97 <> 0 AND abs(price) >= 100 AND lead_min - 22 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id, market, s, line, book, tag ORDER BY reg, price DESC, src_order, src_line, src_supp) AS rn FROM raw)
SELECT event_id, market, s AS side, line, book, tag, CASE reg WHEN 0 THEN 'us' WHEN 1 THEN 'eu' ELSE 'us_ex' END AS region, price,
  lead_min - 22 AS lead_min, CAST(substr(book, 2) AS BIGINT) % 4 AS tier FROM k WHERE rn = 1"""


def book_weights_join(spark, sf):
    """Weights and tiers per book view; a fitted table overrides the prior, thin propositions are dropped."""
    from quotelab.dims import min_books

    q = view(spark, sf, "quotes_v").filter("tag = 'decision'")
    fitted = q.select("market", "book").distinct().filter(F.substring("book", 2, 9).cast("int") % 3 == 0)
    fitted = fitted.withColumn("w", 0.01 * F.substring("book", 2, 9).cast("int") + 0.2)
    v = C.book_views(q, books=TEST_BOOKS, fitted=fitted)
    v = C.consensus(v).filter(F.col("n_books_w") >= min_books(F.col("market")))
    return v.select("event_id", "market", "line", "book", R(F.col("hold"), "hold"), R(F.col("w"), "w"),
                    TEST_BOOKS.tier(F.col("book")).cast("bigint").alias("tier"),
                    F.col("n_books_w").cast("bigint").alias("n_books_w"))


BOOK_WEIGHTS_SQL = f"""{ctes('quotes_v')}, {BOOKS_CTE}, q AS (SELECT * FROM quotes_v WHERE tag = 'decision'), {CONSENSUS_CTE},
w2 AS (SELECT *, CASE WHEN w = 0 THEN 0.0e0 WHEN CAST(substr(book, 2) AS INT) % 3 = 0 THEN 0.01e0 * CAST(substr(book, 2) AS INT) + 0.2e0 ELSE w END AS wf FROM bv),
n AS (SELECT *, count(*) FILTER (WHERE wf > 0) OVER (PARTITION BY event_id, market, line) AS n_books_w FROM w2)
SELECT event_id, market, line, book, round(hold, 6) AS hold, round(wf, 6) AS w, CAST(substr(book, 2) AS BIGINT) % 4 AS tier, n_books_w
FROM n WHERE n_books_w >= 2"""


def price_table(spark, sf):
    q = view(spark, sf, "quotes_v")
    p = F.col("price")
    d = q.select("market", "side", "price").groupBy("market", "side", "price").agg(F.count("*").alias("n"))
    return d.select(
        "market", "side", "price", "n", R(P.decimal_odds(p), "dec"), R(P.raw_prob(p), "raw"), R(P.payout(p), "payout"),
        R(P.american_from_decimal(P.decimal_odds(p)), "back"), R(P.american_from_prob(P.raw_prob(p)), "from_prob"),
        R(P.expected_value(F.lit(0.5), p, 0.05), "ev_push"), R(P.kelly(F.lit(0.55), p, 0.02), "kelly"),
        R(P.logit(P.raw_prob(p)), "l"), R(P.expit(P.logit(P.raw_prob(p))), "back_p"),
        P.price_band(p).alias("band"),
    )


_DEC = f"(1 + {PAYOUT.format('price')})"
_BACK = f"(CASE WHEN {_DEC} >= 2 THEN ({_DEC} - 1) * 100 ELSE -100 / ({_DEC} - 1) END)"
_B = PAYOUT.format("price")
BAND_SQL = ("CASE WHEN price <= -250 THEN '(-100000.0, -250.0]' WHEN price <= -150 THEN '(-250.0, -150.0]' WHEN price <= -110 THEN '(-150.0, -110.0]' "
            "WHEN price <= 100 THEN '(-110.0, 100.0]' WHEN price <= 150 THEN '(100.0, 150.0]' WHEN price <= 250 THEN '(150.0, 250.0]' "
            "WHEN price <= 400 THEN '(250.0, 400.0]' ELSE '(400.0, 100000.0]' END")
PRICE_TABLE_SQL = f"""{ctes('quotes_v')}, g AS (SELECT market, side, price, count(*) AS n FROM quotes_v GROUP BY ALL)
SELECT market, side, price, n, round({_DEC}, 6) AS dec, round({RAW.format('price')}, 6) AS raw, round({_B}, 6) AS payout,
  round({_BACK}, 6) AS back,
  round(CASE WHEN 1 / {RAW.format('price')} >= 2 THEN (1 / {RAW.format('price')} - 1) * 100 ELSE -100 / (1 / {RAW.format('price')} - 1) END, 6) AS from_prob,
  round(0.5e0 * {_B} - (1 - 0.5e0 - 0.05e0), 6) AS ev_push,
  round(least(greatest(({_B} * 0.55e0 - (1 - 0.55e0)) / {_B}, 0), 0.02e0), 6) AS kelly,
  round({LOGIT.format(RAW.format('price'))}, 6) AS l, round({RAW.format('price')}, 6) AS back_p, {BAND_SQL} AS band
FROM g"""


def devig_methods(spark, sf):
    q = view(spark, sf, "quotes_v")
    v = C.book_views(q, books=TEST_BOOKS)
    ro, ru = P.raw_prob(F.col("price_over")), P.raw_prob(F.col("price_under"))
    return v.select("event_id", "market", "line", "tag", "book", R(F.col("hold"), "hold"),
                    *[R(P.devig_pair(ro, ru, m), m) for m in ("multiplicative", "additive", "shin", "power")])


DEVIG_SQL = f"""{ctes('quotes_v')}, {BOOKS_CTE}, q AS (SELECT * FROM quotes_v), {CONSENSUS_CTE},
RECURSIVE_PLACEHOLDER
SELECT event_id, market, line, tag, book, round(ro + ru - 1, 6) AS hold, round(ro / (ro + ru), 6) AS multiplicative,
  round(least(greatest(ro - (ro + ru - 1) / 2, 1e-9), 1 - 1e-9), 6) AS additive, round(p_over, 6) AS shin,
  round(pow(ro, k) / (pow(ro, k) + pow(ru, k)), 6) AS power
FROM bv JOIN root USING (ro, ru)"""
DEVIG_SQL = DEVIG_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_PLACEHOLDER", """
it AS (SELECT ro, ru, 0 AS i, CAST(0.05 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi FROM (SELECT DISTINCT ro, ru FROM bv)
  UNION ALL SELECT ro, ru, i + 1, CASE WHEN pow(ro, (lo + hi) / 2) + pow(ru, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN pow(ro, (lo + hi) / 2) + pow(ru, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END FROM it WHERE i < 60),
root AS (SELECT ro, ru, (lo + hi) / 2 AS k FROM it WHERE i = 60)""")


def devig_n_way(spark, sf):
    """Three-outcome sets: one book's best home or over price in each market of an event."""
    q = view(spark, sf, "quotes_v").filter("side = 'over'")
    best = q.groupBy("event_id", "book", "market").agg(F.max("price").alias("price"))
    return (
        C.devig_group(best, ["event_id", "book"], "market", "price")
        .select("event_id", "book", "market", R(F.col("overround"), "overround"),
                *[R(F.col(m), m) for m in ("multiplicative", "additive", "shin", "power")])
    )


DEVIG_N_SQL = f"""{ctes('quotes_v').replace('WITH ', 'WITH RECURSIVE ', 1)},
b AS (SELECT event_id, book, market, max(price) AS price FROM quotes_v WHERE side = 'over' GROUP BY ALL),
r0 AS (SELECT *, {RAW.format('price')} AS r FROM b),
r1 AS (SELECT *, sum(r) OVER g AS t, count(*) OVER g AS n FROM r0 WINDOW g AS (PARTITION BY event_id, book)),
r AS (SELECT * FROM r1 WHERE n >= 2),
sets AS (SELECT event_id, book, max(CASE WHEN market = 'totals' THEN r END) AS a, max(CASE WHEN market = 'batter_hits' THEN r END) AS b,
   max(CASE WHEN market = 'h2h' THEN r END) AS c, max(t) AS t FROM r GROUP BY ALL),
pw AS (SELECT event_id, book, a, b, c, 0 AS i, CAST(0.2 AS DOUBLE) AS lo, CAST(8 AS DOUBLE) AS hi FROM sets
  UNION ALL SELECT event_id, book, a, b, c, i + 1, CASE WHEN f > 0 THEN m ELSE lo END, CASE WHEN f > 0 THEN hi ELSE m END
  FROM (SELECT *, (lo + hi) / 2 AS m, coalesce(pow(a, (lo + hi) / 2), 0) + coalesce(pow(b, (lo + hi) / 2), 0) + coalesce(pow(c, (lo + hi) / 2), 0) - 1 AS f FROM pw) WHERE i < 70),
sh AS (SELECT event_id, book, a, b, c, t, 0 AS i, CAST(1e-9 AS DOUBLE) AS lo, CAST(0.9999 AS DOUBLE) AS hi FROM sets
  UNION ALL SELECT event_id, book, a, b, c, t, i + 1, CASE WHEN f > 0 THEN m ELSE lo END, CASE WHEN f > 0 THEN hi ELSE m END
  FROM (SELECT *, coalesce((sqrt(m*m + 4*(1-m)*a*a/t) - m)/(2*(1-m)), 0) + coalesce((sqrt(m*m + 4*(1-m)*b*b/t) - m)/(2*(1-m)), 0)
        + coalesce((sqrt(m*m + 4*(1-m)*c*c/t) - m)/(2*(1-m)), 0) - 1 AS f FROM (SELECT *, (lo + hi) / 2 AS m FROM sh)) WHERE i < 70),
kz AS (SELECT pw.event_id, pw.book, (pw.lo + pw.hi) / 2 AS k, (sh.lo + sh.hi) / 2 AS z,
   coalesce(pow(pw.a, 0.2e0), 0) + coalesce(pow(pw.b, 0.2e0), 0) + coalesce(pow(pw.c, 0.2e0), 0) > 1
   AND coalesce(pow(pw.a, 8e0), 0) + coalesce(pow(pw.b, 8e0), 0) + coalesce(pow(pw.c, 8e0), 0) < 1 AS ok
   FROM pw JOIN sh ON pw.event_id = sh.event_id AND pw.book = sh.book WHERE pw.i = 70 AND sh.i = 70),
x AS (SELECT r.*, k, z, ok, (sqrt(z*z + 4*(1-z)*r*r/t) - z)/(2*(1-z)) AS s0 FROM r JOIN kz USING (event_id, book)),
y AS (SELECT *, sum(s0) OVER (PARTITION BY event_id, book) AS ss FROM x)
SELECT event_id, book, market, round(t - 1, 6) AS overround, round(least(greatest(r / t, 1e-12), 1 - 1e-12), 6) AS multiplicative,
  round(least(greatest(r - (t - 1) / n, 1e-12), 1 - 1e-12), 6) AS additive,
  round(CASE WHEN t <= 1 + 1e-9 THEN r / t ELSE s0 / ss END, 6) AS shin,
  round(least(greatest(CASE WHEN abs(t - 1) < 1e-9 THEN r WHEN ok THEN pow(r, k) ELSE r / t END, 1e-12), 1 - 1e-12), 6) AS power
FROM y"""


def loo_consensus(spark, sf):
    q = view(spark, sf, "quotes_v")
    d = C.consensus(C.book_views(q, books=TEST_BOOKS))
    return d.select("event_id", "market", "line", "tag", "book", R(F.col("p_over"), "p_over"), R(F.col("hold"), "hold"),
                    R(F.col("w"), "w"), "n_books", "n_books_w", F.col("n_books_loo").cast("bigint").alias("n_books_loo"),
                    R(F.col("p_cons_all"), "p_cons_all"), R(F.col("p_cons_loo"), "p_cons_loo"))


LOO_SQL = f"""{ctes('quotes_v')}, {BOOKS_CTE}, q AS (SELECT * FROM quotes_v), {CONSENSUS_CTE}
SELECT event_id, market, line, tag, book, round(p_over, 6) AS p_over, round(hold, 6) AS hold, round(w, 6) AS w, n_books, n_books_w,
  n_books_loo, round(p_cons_all, 6) AS p_cons_all, round(p_cons_loo, 6) AS p_cons_loo FROM loo"""


def self_anchor(spark, sf):
    q = view(spark, sf, "quotes_v")
    d = C.attach_consensus(q, books=TEST_BOOKS, self_anchor=("batter_hits",))
    return d.select("event_id", "market", "line", "side", "tag", "book", "price", "src_order", "src_line", "src_supp",
                    R(F.col("p_cons"), "p_cons"), F.col("n_books_cons").cast("bigint").alias("n_books_cons"),
                    F.col("n_books_prop").cast("bigint").alias("n_books_prop"), R(F.col("hold_book"), "hold_book"),
                    R(F.col("p_book_fair"), "p_book_fair"), "self_anchored")


SELF_ANCHOR_SQL = f"""{ctes('quotes_v')}, {BOOKS_CTE}, q AS (SELECT * FROM quotes_v), {CONSENSUS_CTE}, {ATTACH_CTE},
a AS (SELECT *, p_cons IS NULL AND p_book_fair IS NOT NULL AND market = 'batter_hits' AS lone FROM judged)
SELECT event_id, market, line, side, tag, book, price, src_order, src_line, src_supp, round(CASE WHEN lone THEN p_book_fair ELSE p_cons END, 6) AS p_cons,
  CAST(CASE WHEN lone THEN 1 ELSE n_books_cons END AS BIGINT) AS n_books_cons, CAST(n_books_prop AS BIGINT) AS n_books_prop,
  round(hold_book, 6) AS hold_book, round(p_book_fair, 6) AS p_book_fair, lone AS self_anchored FROM a"""

QUERIES = {
    "best_price_ev": best_price_ev, "quote_normalise": quote_normalise, "book_weights_join": book_weights_join,
    "price_table": price_table, "devig_methods": devig_methods, "devig_n_way": devig_n_way,
    "loo_consensus": loo_consensus, "self_anchor": self_anchor,
}
ORACLES = {
    "best_price_ev": BEST_PRICE_SQL, "quote_normalise": QUOTE_NORMALISE_SQL, "book_weights_join": BOOK_WEIGHTS_SQL,
    "price_table": PRICE_TABLE_SQL, "devig_methods": DEVIG_SQL, "devig_n_way": DEVIG_N_SQL,
    "loo_consensus": LOO_SQL, "self_anchor": SELF_ANCHOR_SQL,
}
