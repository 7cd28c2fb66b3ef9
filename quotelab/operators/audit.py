"""Leak audits: each returns findings (check_name, severity, detail, n)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.operators.evaluate import stratified_auc
from quotelab.operators.form import lagged_form, min_observations

# ---- fixed values: sample size, tolerances, bounds, families that are rolled up from past games -----
SAMPLE = 300
RTOL, ATOL = 1e-4, 1e-6
VETO_SHARE, VETO_COUNT = 0.02, 5
WARN_AUC, VETO_AUC = 0.60, 0.70
MIN_SIGNAL_ROWS = 500
FORM_PREFIXES = ("bat_", "pit_", "tm_", "park_", "opp_", "home_tg_", "away_tg_")
# ---- end of fixed values -----------------------------------------------------------------------
FINDING = ("check_name", "severity", "detail", "n")


def quote_timing(quotes: DataFrame) -> DataFrame:
    """Every quote must be taken before the start."""
    lead = F.col("lead_min")
    g = quotes.agg(F.count_if(lead.isNull() | (lead <= 0)).alias("bad"), F.min(lead).alias("low"), F.count("*").alias("all"))
    ok = F.col("bad") == 0
    return g.select(
        F.lit("quote_timing").alias("check_name"), F.when(ok, "ok").otherwise("veto").alias("severity"),
        F.when(ok, F.concat(F.lit("minimum lead "), F.round("low", 1).cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.col("bad").cast("string"), F.lit(" quotes at or after the start"))).alias("detail"),
        F.when(ok, F.col("all")).otherwise(F.col("bad")).alias("n"))


def fold_boundary(train: DataFrame, test: DataFrame, date: str = "game_date") -> DataFrame:
    """No training row may be dated on or after the first test date."""
    first = test.agg(F.min(date).alias("d")).scalar()
    g = train.select(F.col(date).alias("d"), first.alias("t0")).agg(
        F.count_if(F.col("d") >= F.col("t0")).alias("bleed"), F.count("*").alias("rows"), F.max("t0").alias("t0"))
    empty = (F.col("rows") == 0) | F.col("t0").isNull()
    return g.select(
        F.lit("fold_boundary").alias("check_name"),
        F.when(empty, "warn").when(F.col("bleed") > 0, "veto").otherwise("ok").alias("severity"),
        F.when(empty, "empty train or test fold").otherwise(
            F.concat(F.col("bleed").cast("string"), F.lit(" training rows from the first test date on"))).alias("detail"),
        F.col("bleed").alias("n"))


def feature_asof(features: DataFrame, source: DataFrame, entity: str, start: str, tie: str, value: str, feature: str, window: int, order: list[Column] = (), n_sample: int | None = None) -> DataFrame:
    """Recomputes a rolling feature from strictly earlier rows, for all rows or for the first ``n_sample`` by ``order``.

    A mismatch that a window with the current row in it explains means the feature saw its own outcome. All rows go by
    ordered chunks of each entity. A sample, of ``SAMPLE`` rows at most, is broadcast; the history is scanned once per
    window and each task keeps only the last ``window`` rows per sampled row.
    """
    if n_sample is None:
        keys, form = [entity, start, tie], lagged_form(source.select(entity, start, tie, value), entity, start, tie, [value], (window,), "__p_", current="__c_")
        form = form.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col(f"__p_{value}_r{window}").alias("prior"), F.col(f"__c_{value}_r{window}").alias("incl"))
        given = features.filter(F.col(feature).isNotNull()).select(*keys, F.col(feature).alias("got"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
        return _asof_finding(given.join(form, same).filter(F.col("prior").isNotNull()), feature)
    if n_sample > SAMPLE:
        raise ValueError(f"a sample has {SAMPLE} rows at most; None checks all")
    sample = features.filter(F.col(feature).isNotNull()).orderBy(*order).limit(n_sample)
    sample = sample.select(F.col(entity).alias("__e"), F.col(start).alias("__s"), F.col(tie).alias("__t"), F.col(feature).alias("got"))
    src = source.select(F.col(entity).alias("e"), F.col(start).alias("s"), F.col(tie).alias("t"), F.col(value).alias("v"))

    def recompute(same_row: bool, name: str) -> DataFrame:
        earlier = (F.col("s") < F.col("__s")) | ((F.col("s") == F.col("__s")) & ((F.col("t") <= F.col("__t")) if same_row else (F.col("t") < F.col("__t"))))
        d = src.join(F.broadcast(sample), (F.col("e") == F.col("__e")) & earlier)
        w = Window.partitionBy("__e", "__s", "__t").orderBy(F.col("s").desc(), F.col("t").desc())
        d = d.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= window)
        return d.groupBy("__e", "__s", "__t").agg(F.when(F.count("v") >= min_observations(window), F.avg("v")).alias(name), F.max("got").alias(f"got_{name}"))

    key = ["__e", "__s", "__t"]
    d = recompute(False, "prior").join(recompute(True, "incl"), key).withColumnRenamed("got_prior", "got").filter(F.col("prior").isNotNull())
    return _asof_finding(d, feature)


def _asof_finding(d: DataFrame, feature: str) -> DataFrame:
    """The finding from (prior, incl, got) of the rows checked."""
    near = lambda a: F.abs(a - F.col("got")) <= ATOL + RTOL * F.abs("got")
    bad = ~near(F.col("prior"))
    g = d.agg(F.count("*").alias("checked"), F.count_if(bad).alias("bad"), F.count_if(bad & near(F.col("incl"))).alias("future"))
    systematic = F.col("future") >= F.greatest(F.lit(float(VETO_COUNT)), VETO_SHARE * F.col("checked"))
    warn = (F.col("checked") == 0) | (F.col("future") > 0) | (F.col("bad") > 0)
    n = F.when(F.col("future") > 0, F.col("future")).when(F.col("bad") > 0, F.col("bad")).otherwise(F.col("checked"))
    return g.select(
        F.lit(f"asof::{feature}").alias("check_name"),
        F.when((F.col("checked") > 0) & systematic, "veto").when(warn, "warn").otherwise("ok").alias("severity"),
        F.concat_ws(" ", F.col("checked").cast("string"), F.lit("checked,"), F.col("bad").cast("string"), F.lit("differ,"),
                    F.col("future").cast("string"), F.lit("match a window with the current row")).alias("detail"),
        n.alias("n"))


def vetoable(feature: Column) -> Column:
    return reduce(lambda a, b: a | b, [feature.startswith(p) for p in FORM_PREFIXES])


def signal_table(df: DataFrame, features: list[str], by: list[str], won: str, market: str, tie: str, min_rows: int = MIN_SIGNAL_ROWS) -> DataFrame:
    """(by, feature, n, auc): what each feature still separates once the market is held fixed, at least 0.5."""
    long = df.select(*by, won, market, tie, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    auc = stratified_auc(long, [*by, "feature"], "x", won, market, tie)
    return auc.filter(F.col("n") >= min_rows).withColumn("auc", F.greatest("auc", 1 - F.col("auc")))


def conditional_signal(signals: DataFrame, by: list[str]) -> DataFrame:
    """Finding per group from its worst feature; only form rolled up from past games can be vetoed."""
    worst = signals.groupBy(*by).agg(F.max(F.when(F.col("auc") > 0.5, F.struct("auc", "feature"))).alias("w"), F.count_if(
        (F.col("auc") >= WARN_AUC) & ~vetoable(F.col("feature"))).alias("informative"))
    a, f = F.col("w.auc"), F.col("w.feature")
    sev = (F.when(a.isNull(), "ok").when((a >= VETO_AUC) & vetoable(f), "veto").when(a >= WARN_AUC, "warn").otherwise("ok"))
    return worst.select(*by, F.lit("conditional_signal").alias("check_name"), sev.alias("severity"), f.alias("detail"), a.alias("auc"), F.col("informative").alias("n"))


def audit(*findings: DataFrame) -> DataFrame:
    """All findings of a bundle, with whether any of them vetoes."""
    d = reduce(lambda a, b: a.unionByName(b), [f.select(*FINDING) for f in findings])
    return d.withColumn("vetoed", F.max((F.col("severity") == "veto").cast("int")).over(Window.partitionBy(F.lit(0))) == 1)
