"""Market and book dimensions: small fixed tables, inlined into plans as literals."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: markets, books, weights, seasons --------------------------------------------
MARKET_COLUMNS = "name string, api_key string, kind string, stat string, side string, regions array<string>, label string"
_STANDARD = ["us", "eu", "us_ex"]
_PLAYER = ["us", "eu", "us_ex", "us2"]
MARKETS = [
    ("h2h", "h2h", "featured", "moneyline", "team", _STANDARD, "Moneyline"),
    ("spreads", "spreads", "featured", "run_line", "team", _STANDARD, "Run line"),
    ("totals", "totals", "featured", "total_runs", "team", _STANDARD, "Game total"),
    ("batter_hits", "batter_hits", "prop", "hits", "batting", _PLAYER, "Batter hits"),
    ("batter_rbis", "batter_rbis", "prop", "rbi", "batting", _PLAYER, "Batter RBIs"),
    ("batter_total_bases", "batter_total_bases", "prop", "total_bases", "batting", _PLAYER, "Batter total bases"),
    ("batter_home_runs", "batter_home_runs", "prop", "home_runs", "batting", _PLAYER, "Batter home runs"),
    ("runs_scored", "batter_runs_scored", "prop", "runs", "batting", _PLAYER, "Batter runs scored"),
    ("batter_strikeouts", "batter_strikeouts", "prop", "strike_outs", "batting",
     ["us2", "us_dfs", "us_ex", "us", "eu"], "Batter strikeouts"),
    ("pitcher_strikeouts", "pitcher_strikeouts", "prop", "strike_outs", "pitching", _PLAYER, "Pitcher strikeouts"),
    ("pitcher_outs", "pitcher_outs", "prop", "outs", "pitching", _PLAYER, "Pitcher outs"),
]
ALTERNATE_KEYS = {"alternate_spreads": "spreads", "alternate_totals": "totals"}
HANDICAP_MARKETS = ("spreads",)
SELF_ANCHOR_MARKETS = ("batter_strikeouts",)
STARTER_MARKETS = ("pitcher_strikeouts", "pitcher_outs")
MIN_BOOKS_DEFAULT = 2
MIN_BOOKS = {"batter_strikeouts": 1}
REGION_ORDER = ("us", "eu", "us_ex", "us2", "us_dfs")
SEASONS = {
    2023: ("2023-03-30", "2023-10-01"),
    2024: ("2024-03-28", "2024-09-30"),
    2025: ("2025-03-27", "2025-09-28"),
    2026: ("2026-03-26", "2026-09-27"),
}
_EXCHANGE = {"novig", "prophetx", "betfair_ex_eu", "matchbook", "betopenly"}
_SHARP = {"pinnacle", "lowvig", "betonlineag", "betus", "mybookieag"}
_RETAIL = {"draftkings", "fanduel", "betmgm", "williamhill_us", "betrivers", "espnbet", "fanatics",
           "hardrockbet", "bovada"}
_DFS = {"prizepicks", "underdog", "pick6", "betr_us_dfs", "dabble_au"}
_BETTABLE = {"draftkings", "fanduel", "betmgm", "williamhill_us", "betrivers", "espnbet", "fanatics",
             "hardrockbet", "bovada", "betonlineag", "lowvig", "betus", "mybookieag", "novig", "prophetx",
             "fliff", "ballybet", "betparx", "rebet", "windcreek", "pinnacle"}
_MAJOR = {"draftkings", "fanduel", "betmgm", "williamhill_us", "espnbet", "betrivers", "fanatics"}
_WEIGHTS = {"pinnacle": 1.00, "novig": 0.85, "prophetx": 0.80, "betfair_ex_eu": 0.75, "matchbook": 0.60,
            "lowvig": 0.55, "betonlineag": 0.50, "draftkings": 0.45, "fanduel": 0.45, "betmgm": 0.40,
            "williamhill_us": 0.30, "espnbet": 0.25, "betrivers": 0.25, "fanatics": 0.25,
            "hardrockbet": 0.20, "bovada": 0.20}
DEFAULT_WEIGHT = 0.10
# ---- end of fixed values -----------------------------------------------------------------------


@dataclass(frozen=True)
class Books:
    """What the jobs need to know about books; its size is that of the book dimension."""

    weights: Mapping[str, float]
    tiers: Mapping[str, int]
    bettable: tuple[str, ...]
    dfs: tuple[str, ...]
    major: tuple[str, ...]
    default_weight: float = DEFAULT_WEIGHT
    default_tier: int = 3

    def weight(self, book: Column) -> Column:
        return F.coalesce(lookup(self.weights, book), F.lit(self.default_weight))

    def tier(self, book: Column) -> Column:
        return F.coalesce(lookup(self.tiers, book), F.lit(self.default_tier))

    def can_bet(self, book: Column) -> Column:
        """A plain IN list, so that the predicate reaches the Parquet scan."""
        return book.isin([b for b in self.bettable if b not in self.dfs])

    def is_dfs(self, book: Column) -> Column:
        return book.isin(list(self.dfs)) if self.dfs else F.lit(False)

    def is_major(self, book: Column) -> Column:
        return book.isin(list(self.major))


def lookup(values: Mapping, key: Column) -> Column:
    """Literal map lookup; null where the key is unknown."""
    if not values:
        return F.lit(None)
    pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


BOOKS = Books(
    weights=_WEIGHTS,
    tiers={**{b: 0 for b in _EXCHANGE}, **{b: 1 for b in _SHARP}, **{b: 2 for b in _RETAIL}},
    bettable=tuple(sorted(_BETTABLE)),
    dfs=tuple(sorted(_DFS)),
    major=tuple(sorted(_MAJOR)),
)


def market_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKETS, MARKET_COLUMNS)


def market_attr(attr: str, market: Column, by: str = "name") -> Column:
    """One attribute of the market dimension as an expression over a market column."""
    names = [c.split()[0] for c in MARKET_COLUMNS.split(", ")]
    k, v = names.index(by), names.index(attr)
    return lookup({m[k]: m[v] for m in MARKETS}, market)


def canonical_market(api_key: Column) -> Column:
    """Feed key to market name; alternate-line keys map to the market they extend."""
    names = {m[1]: m[0] for m in MARKETS}
    return lookup({**names, **ALTERNATE_KEYS}, api_key)


def min_books(market: Column, deployment: Column | None = None, veto_floor: int = 5) -> Column:
    """Books needed behind a price: market override, raised for veto-filtered markets."""
    base = F.coalesce(lookup(MIN_BOOKS, market), F.lit(MIN_BOOKS_DEFAULT))
    if deployment is None:
        return base
    return F.when(deployment == "veto_filtered", F.greatest(base, F.lit(veto_floor))).otherwise(base)
