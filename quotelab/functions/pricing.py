"""Odds arithmetic as native column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR_EPS = 1e-9
_N_WAY_EPS = 1e-12


def clip(x: Column, lo: float, hi: float) -> Column:
    """``x`` bounded to [lo, hi]; null stays null, which ``least`` and ``greatest`` alone would not keep."""
    return F.when(x.isNotNull(), bound(x, lo, hi))


def bound(x: Column, lo: float, hi: float) -> Column:
    """``clip`` for an expression known not to be null; evaluates it once."""
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -40, 40)))


def payout(price: Column) -> Column:
    """Profit of a winning one-unit stake at an American price."""
    return F.when(price > 0, price / 100).otherwise(F.try_divide(F.lit(100.0), F.abs(price)))


def raw_prob(price: Column) -> Column:
    """Break-even probability of an American price, margin included."""
    a = F.abs(price)
    return F.when(price > 0, 100 / (a + 100)).otherwise(a / (a + 100))


def decimal_odds(price: Column) -> Column:
    return 1 + payout(price)


def american_from_decimal(d: Column) -> Column:
    return F.when(d >= 2, (d - 1) * 100).otherwise(F.try_divide(F.lit(-100.0), d - 1))


def american_from_prob(p: Column) -> Column:
    return american_from_decimal(1 / clip(p, _N_WAY_EPS, 1 - _N_WAY_EPS))


def expected_value(p_win: Column, price: Column, p_push: Column | float = 0.0) -> Column:
    push = p_push if isinstance(p_push, Column) else F.lit(float(p_push))
    return p_win * payout(price) - clip(1 - p_win - push, 0, 1)


def kelly(p_win: Column, price: Column, cap: float = 1.0, p_push: Column | float = 0.0) -> Column:
    push = p_push if isinstance(p_push, Column) else F.lit(float(p_push))
    b = payout(price)
    fraction = F.try_divide(b * p_win - clip(1 - p_win - push, 0, 1), b)
    return F.least(clip(F.coalesce(fraction, F.lit(0.0)), 0, 1), F.lit(float(cap)))


def is_over(side: Column) -> Column:
    return side.isin("over", "home")


def side_prob(p_over: Column, side: Column) -> Column:
    return F.when(is_over(side), p_over).otherwise(1 - p_over)


def settle_profit(result: Column, price: Column) -> Column:
    return F.when(result == "win", payout(price)).when(result == "loss", F.lit(-1.0)).otherwise(F.lit(0.0))


def devig_pair(raw_a: Column, raw_b: Column, method: str = "shin") -> Column:
    """Margin-free probability of side A from the raw probabilities of two sides.

    For two outcomes Shin's model has the additive closed form whenever there is a margin to strip,
    so the default stays inside code generation. Only the power method needs an iteration.
    """
    a, b = bound(raw_a, _PAIR_EPS, 1 - _PAIR_EPS), bound(raw_b, _PAIR_EPS, 1 - _PAIR_EPS)
    s = a + b
    additive = bound(a - (s - 1) / 2, _PAIR_EPS, 1 - _PAIR_EPS)
    if method == "multiplicative":
        p = a / s
    elif method == "additive":
        p = additive
    elif method == "shin":
        p = F.when(s <= 1 + 1e-9, a / s).otherwise(additive)
    elif method == "power":
        p = bound(_power_share(F.array(F.ln(a), F.ln(b)), 0.05, 10.0)[0], _PAIR_EPS, 1 - _PAIR_EPS)
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(raw_a.isNotNull() & raw_b.isNotNull(), p)


def _scaled(xs: Column) -> Column:
    """A short array divided by its sum."""
    start = F.struct(xs.alias("xs"))
    return F.aggregate(F.array(F.lit(0)), start, lambda acc, _: acc, lambda acc: F.transform(
        acc["xs"], lambda x: x / _sum(acc["xs"], lambda y: y)))


def _power_share(logs: Column, lo: float, hi: float) -> Column:
    """``x ** k`` scaled to one, for the logs in a short array and the k at which the powers sum to one.

    The sum is convex and falls with k, so Newton steps from the left climb to the root without overshoot.
    The array travels in the accumulator, which keeps its expression from being evaluated once per step.
    """

    def step(acc: Column, _: Column) -> Column:
        value = _sum(acc["ls"], lambda v: F.exp(v * acc["k"])) - 1
        slope = _sum(acc["ls"], lambda v: v * F.exp(v * acc["k"]))
        k = acc["k"] - F.try_divide(value, slope)
        return F.struct(F.greatest(F.least(k, F.lit(hi)), F.lit(lo)).alias("k"), acc["ls"].alias("ls"))

    first = F.when(_sum(logs, F.exp) > 1, 1.0).otherwise(lo)
    start = F.struct(first.alias("k"), logs.alias("ls"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step, lambda acc: _scaled(
        F.transform(acc["ls"], lambda v: F.exp(v * acc["k"]))))


def _shin_share(xs: Column, total: Column) -> Column:
    """Root in z of the Shin probabilities' sum, by halving steps of [0, 1)."""

    def share(x: Column, z: Column, t: Column) -> Column:
        return (F.sqrt(z * z + 4 * (1 - z) * x * x / t) - z) / (2 * (1 - z))

    def step(acc: Column, _: Column) -> Column:
        above = _sum(acc["xs"], lambda x: share(x, acc["z"], acc["t"])) - 1
        return F.struct(
            (acc["z"] + F.signum(above) * acc["h"]).alias("z"), (acc["h"] / 2).alias("h"),
            acc["xs"].alias("xs"), acc["t"].alias("t"),
        )

    start = F.struct(F.lit(0.5).alias("z"), F.lit(0.25).alias("h"), xs.alias("xs"), total.alias("t"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(45)), start, step,
        lambda acc: _scaled(F.transform(acc["xs"], lambda x: share(x, acc["z"], acc["t"]))),
    )


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


def devig_array(raw: Column, method: str = "shin") -> Column:
    """Margin-free probabilities of a complete outcome set held in a short array; null below two outcomes."""
    n, total = F.size(raw), _sum(raw, lambda x: x)
    inner = F.transform(raw, lambda x: bound(x, _N_WAY_EPS, 1 - _N_WAY_EPS))
    inner_total = _sum(inner, lambda x: x)
    proportional = F.transform(raw, lambda x: x / total)
    if method == "multiplicative":
        out = proportional
    elif method == "additive":
        out = F.transform(raw, lambda x: x - (total - 1) / n)
    elif method == "power":
        powered = _power_share(F.transform(inner, F.ln), 0.2, 8.0)
        bracketed = (_sum(inner, lambda x: F.pow(x, F.lit(0.2))) > 1) & (_sum(inner, lambda x: F.pow(x, F.lit(8.0))) < 1)
        out = F.when(F.abs(inner_total - 1) < 1e-9, inner).when(bracketed, powered).otherwise(proportional)
    elif method == "shin":
        out = F.when(inner_total <= 1 + 1e-9, proportional).otherwise(_shin_share(inner, inner_total))
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(n >= 2, F.transform(out, lambda x: bound(x, _N_WAY_EPS, 1 - _N_WAY_EPS)))


# ---- fixed values: price band edges, right-closed ----------------------------------------------
PRICE_BANDS = (-100000.0, -250.0, -150.0, -110.0, 100.0, 150.0, 250.0, 400.0, 100000.0)
# ---- end of fixed values -----------------------------------------------------------------------


def price_band(price: Column) -> Column:
    """Label of the right-closed band a price falls in."""
    out = None
    for lo, hi in zip(PRICE_BANDS, PRICE_BANDS[1:]):
        label, inside = F.lit(f"({lo}, {hi}]"), (price > lo) & (price <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise("nan")


def segment(anchor: Column, price: Column) -> Column:
    return F.concat(anchor, F.lit("|"), price_band(price))


def blend(values: list[Column], weights=(0.3, 0.5, 0.2)) -> Column:
    """Weighted mean of the values that are present, weights renormalised."""
    pairs = list(zip(values, weights))
    top = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    mass = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.when(mass > 0, F.try_divide(top, mass))


def confidence(ev: Column, n_books: Column, lead_min: Column) -> Column:
    """0-100 score from edge, support and timing."""
    edge = clip(ev / 0.12, 0, 1)
    support = clip((n_books - 2) / 8, 0, 1)
    timing = clip(1.2 - F.abs(lead_min - 60) / 240, 0.3, 1)
    return F.round(100 * clip(0.55 * edge + 0.32 * support + 0.13 * timing, 0, 1), 1)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def log_loss(won: Column, p: Column, eps: float = 1e-7) -> Column:
    """Row-wise log loss; average it for the metric."""
    q = clip(p, eps, 1 - eps)
    return -(won * F.ln(q) + (1 - won) * F.ln(1 - q))
