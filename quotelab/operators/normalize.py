"""Raw outcomes to tidy quotes: side and line, validity, lead time, one row per takeable price."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.dims import REGION_ORDER, BOOKS, Books
from quotelab.operators.keys import first_per_key

QUOTE_KEY = ("event_id", "market", "subject", "side", "line", "book", "tag")
# ---- fixed values: outcome names that mean over and under ---------------------------------------
OVER_NAMES = ("over", "yes")
UNDER_NAMES = ("under", "no")
# ---- end of fixed values -----------------------------------------------------------------------


def outcome_side(kind: Column, market: Column, name: Column, home: Column, away: Column) -> Column:
    """Side of an outcome, null when it is none that can be settled."""
    plain, low = F.trim(name), F.lower(F.trim(name))
    two_team = (kind == "featured") & market.isin("h2h", "spreads")
    return (
        F.when(two_team & (plain == home), "home")
        .when(two_team & (plain == away), "away")
        .when(~two_team & low.isin(*OVER_NAMES), "over")
        .when(~two_team & low.isin(*UNDER_NAMES), "under")
    )


def outcome_line(market: Column, side: Column, point: Column) -> Column:
    """Handicap from the home or over perspective, so that both sides of a proposition share it."""
    return F.when(market == "h2h", None).when((market == "spreads") & (side == "away"), -point).otherwise(point)


def number(x: Column) -> Column:
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def finish(quotes: DataFrame, key=QUOTE_KEY, books: Books = BOOKS, tie: list[str] = ()) -> DataFrame:
    """Valid quotes before the start, one per takeable price.

    The same book can arrive through several regions: the first region in the fixed order wins, then the
    highest price, then ``tie``, the latest snapshot and the remaining columns in the order of their names.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in REGION_ORDER]), F.col("region"))
    d = quotes.withColumns({"price": number(F.col("price")), "line": number(F.col("line"))})
    d = d.filter((F.abs(F.col("price")) >= 100) & (F.col("lead_min") > 0))
    d = d.withColumn("tier", books.tier(F.col("book")).cast("byte"))
    order = [F.when(rank > 0, rank).otherwise(len(REGION_ORDER) + 1), F.col("price").desc(), F.col("region"), *[F.col(c) for c in tie]]
    rest = sorted(set(d.columns) - {*key, "price", "region", *tie})
    return first_per_key(d, key, order + [F.col(c).desc() if c == "snapshot_ts" else F.col(c) for c in sorted(rest, key=lambda c: c != "snapshot_ts")])
