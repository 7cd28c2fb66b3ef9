"""Book views, weighted log-odds consensus and its leave-one-out form."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.dims import BOOKS, Books
from quotelab.functions import pricing as P
from quotelab.operators.keys import first_per_key, null_safe_join

KEY = ("event_id", "market", "subject", "line", "tag")
MAX_HOLD = 0.35


def book_views(
    quotes: DataFrame,
    method: str = "shin",
    books: Books = BOOKS,
    fitted: DataFrame | None = None,
    key=KEY,
    one_sided: bool = False,
) -> DataFrame:
    """One row per (proposition, book): best price per side, fair probability, hold and weight.

    One conditional aggregation with map-side combine, so a proposition that is quoted over and over arrives at
    the shuffle as one row per book and task. ``one_sided`` keeps books that priced only one side.
    ``fitted`` is an optional table (market, book, w) that overrides the prior weights.
    """
    over = P.is_over(F.col("side"))
    out = quotes.groupBy(*key, "book").agg(
        F.max(F.when(over, F.col("price"))).alias("price_over"),
        F.max(F.when(~over, F.col("price"))).alias("price_under"),
    )
    if not one_sided:
        out = out.filter(F.col("price_over").isNotNull() & F.col("price_under").isNotNull())
    raw_o, raw_u = P.raw_prob(F.col("price_over")), P.raw_prob(F.col("price_under"))
    weight = books.weight(F.col("book"))
    if fitted is not None:
        out = out.join(fitted.select("market", "book", F.col("w").alias("__fit")), ["market", "book"], "left")
        weight = F.coalesce("__fit", weight)
    out = out.withColumns({"p_over": P.devig_pair(raw_o, raw_u, method), "hold": raw_o + raw_u - 1})
    muted = books.is_dfs(F.col("book")) | (F.col("hold") > MAX_HOLD)
    return out.withColumn("w", F.when(muted, 0.0).otherwise(weight)).drop("__fit")


def consensus(view: DataFrame, min_books: int = 2, key=KEY) -> DataFrame:
    """All-book and leave-one-out consensus for each row of a book view.

    The window runs over book views, not quotes: a proposition has one row per book, so its group is bounded by
    the book dimension however often it was quoted.
    """
    two = F.col("p_over").isNotNull()
    counted = two & (F.col("w") > 0)
    over_prop = Window.partitionBy(*key)
    d = view.withColumn("__l", P.logit(F.col("p_over"))).withColumn("__wl", F.col("w") * F.col("__l"))
    d = d.withColumns({
        "__w_sum": F.sum(F.when(two, F.col("w"))).over(over_prop),
        "__wl_sum": F.sum("__wl").over(over_prop),
        "n_books": F.count(F.when(two, 1)).over(over_prop),
        "n_books_w": F.count(F.when(counted, 1)).over(over_prop),
    })
    rest_w, rest_wl = F.col("__w_sum") - F.col("w"), F.col("__wl_sum") - F.col("__wl")
    d = d.withColumn("n_books_loo", F.when(two, F.col("n_books_w") - F.when(counted, 1).otherwise(0)))
    return d.withColumns({
        "p_cons_all": F.when(
            (F.col("n_books_w") >= min_books) & (F.col("__w_sum") > 0), P.expit(F.try_divide("__wl_sum", "__w_sum"))
        ),
        "p_cons_loo": F.when(
            two & (F.col("n_books_loo") >= min_books) & (rest_w > 0), P.expit(F.try_divide(rest_wl, rest_w))
        ),
    }).drop("__l", "__wl", "__w_sum", "__wl_sum")


def anchor(view: DataFrame, min_books: int = 2, self_anchor: tuple[str, ...] = (), key=KEY) -> DataFrame:
    """The consensus each (proposition, book) is judged against.

    A two-sided book gets the consensus without itself. A one-sided book added nothing to the consensus, so the
    all-book value already leaves it out. In a self-anchored market a lone book's fair price stands in.
    """
    d = consensus(view, min_books, key)
    own = F.col("p_over").isNotNull()
    d = d.select(
        *key, "book", "price_over", "price_under",
        F.when(own, F.col("p_cons_loo")).otherwise(F.col("p_cons_all")).alias("p_cons"),
        F.when(own, F.col("n_books_loo")).when(F.col("n_books") > 0, F.col("n_books_w")).cast("double").alias("n_books_cons"),
        F.col("hold").alias("hold_book"),
        F.col("p_over").alias("p_book_fair"),
        F.when(F.col("n_books") > 0, F.col("n_books_w")).cast("double").alias("n_books_prop"),
    )
    lone = (
        F.col("p_cons").isNull() & F.col("p_book_fair").isNotNull() & F.col("market").isin(list(self_anchor))
        if self_anchor else F.lit(False)
    )
    return d.withColumns({
        "p_cons": F.when(lone, F.col("p_book_fair")).otherwise(F.col("p_cons")),
        "n_books_cons": F.when(lone, 1.0).otherwise(F.col("n_books_cons")),
        "self_anchored": lone,
    })


def attach_consensus(
    quotes: DataFrame,
    method: str = "shin",
    min_books: int = 2,
    self_anchor: tuple[str, ...] = (),
    books: Books = BOOKS,
    fitted: DataFrame | None = None,
    key=KEY,
) -> DataFrame:
    """Each quote with ``p_cons, n_books_cons, hold_book, p_book_fair, n_books_prop, self_anchored``.

    The book view keeps one-sided books, so every quote finds its row in one join on (proposition, book); a hot
    proposition spreads over its books there.
    """
    view = book_views(quotes, method, books, fitted, key, one_sided=True)
    judged = anchor(view, min_books, self_anchor, key).drop("price_over", "price_under")
    return null_safe_join(quotes, judged, [*key, "book"], "left")


def best_prices(
    quotes: DataFrame,
    method: str = "shin",
    min_books: int = 2,
    self_anchor: tuple[str, ...] = (),
    books: Books = BOOKS,
    fitted: DataFrame | None = None,
    key=KEY,
) -> DataFrame:
    """Best bettable price per (proposition, side) with its leave-one-out probability and expected value.

    The best price of a book is already in the book view, so the quotes are shuffled once and never joined back.
    """
    view = anchor(book_views(quotes, method, books, fitted, key, one_sided=True), min_books, self_anchor, key)
    sides = F.array(
        F.struct(F.lit(True).alias("over"), F.col("price_over").alias("price")),
        F.struct(F.lit(False).alias("over"), F.col("price_under").alias("price")),
    )
    d = view.filter(books.can_bet(F.col("book")) & F.col("p_cons").isNotNull())
    d = d.select(*key, "book", "p_cons", "n_books_cons", F.inline(sides)).filter(F.col("price").isNotNull())
    d = first_per_key(d, [*key, "over"], [P.payout(F.col("price")).desc(), F.col("book").asc()])
    p_side = F.when(F.col("over"), F.col("p_cons")).otherwise(1 - F.col("p_cons"))
    return d.select(*key, "over", "book", "price", "n_books_cons", p_side.alias("p_side"),
                    P.expected_value(p_side, F.col("price")).alias("ev"))


def devig_group(prices: DataFrame, group: list[str], outcome: str, price: str) -> DataFrame:
    """Margin-free probabilities of complete outcome sets by all four methods, one row per outcome.

    ``prices`` holds one price per (group, outcome), so a set has as many members as the market has outcomes.
    """
    legs = F.sort_array(F.collect_list(F.struct(F.col(outcome).alias("o"), F.col(price).alias("a"))))
    d = prices.groupBy(*group).agg(legs.alias("legs")).filter(F.size("legs") >= 2)
    d = d.withColumn("raw", F.transform("legs", lambda x: P.raw_prob(x["a"])))
    d = d.withColumns({m: P.devig_array(F.col("raw"), m) for m in ("multiplicative", "additive", "shin", "power")})
    total = F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x)
    legs_out = F.arrays_zip("legs", "multiplicative", "additive", "shin", "power")
    return d.select(*group, (total - 1).alias("overround"), F.inline(legs_out)).select(
        *group, F.col("legs.o").alias(outcome), F.col("legs.a").alias(price), "overround",
        "multiplicative", "additive", "shin", "power",
    )
