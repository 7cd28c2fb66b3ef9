"""Market-anchored probability models, all markets and folds in one fit; trees by Spark ML."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quotelab.functions import pricing as P
from quotelab.operators.calibrate import best_shrink, shrink_grid
from quotelab.operators.folds import date_fold, stored_fold  # noqa: F401
from quotelab.operators.isotonic import apply_isotonic, fit_isotonic
from quotelab.operators.keys import null_safe_join
from quotelab.operators.skew import ordered_rank
from quotelab.session import batches_of, discard, materialise

FULL = -1
# ---- fixed values: row bounds, folds, tuned configurations ------------------------------------------
MIN_ROWS, MIN_TRAIN_PROPS = 400, 800
OOF_FOLDS = 3
CONFIGS = {
    "shallow": {"step": 0.06, "leaves": 7, "min_leaf": 300, "l2": 1.0},
    "default": {"step": 0.05, "leaves": 31, "min_leaf": 200, "l2": 1.0},
    "conservative": {"step": 0.03, "leaves": 15, "min_leaf": 500, "l2": 2.0},
    "very_regular": {"step": 0.02, "leaves": 15, "min_leaf": 1000, "l2": 5.0},
    "deep_regular": {"step": 0.04, "leaves": 63, "min_leaf": 400, "l2": 3.0},
    "aggressive": {"step": 0.08, "leaves": 63, "min_leaf": 100, "l2": 0.5},
}
# ---- end of fixed values -----------------------------------------------------------------------


def block(by: str, fold: Column) -> Column:
    return F.concat_ws("|", F.col(by).cast("string"), fold.cast("string"))


def _targets(k: int) -> Column:
    return F.array(*[F.lit(i) for i in range(k)], F.lit(FULL))


def with_targets(df: DataFrame, by: str, k: int, max_rows: int | None = None, tie: str | None = None, fold: str = "oof_fold", date: str = "game_date") -> DataFrame:
    """Adds ``__targets``: the fits that a row trains, which are the full one and those of the folds it is not in.

    With ``max_rows`` each fit takes the most recent rows, by (date, ``tie``), of those its fold leaves: were the bound put on the
    market, its last rows might share one fold, and the fit that leaves this fold out would have none. Rows of no fit go.
    Counts per day tell which days a fit takes whole; only rows of the days at a cut are ranked.
    """
    whole = df.withColumn("__targets", F.filter(_targets(k), lambda f: f != F.col(fold)))
    if max_rows is None or df.groupBy(by).count().filter(F.col("count") > max_rows).isEmpty():
        return whole
    day = F.coalesce(F.to_date(date), F.lit("0001-01-01").cast("date"))
    # A day lies in one fold.
    days = whole.groupBy(by, day.alias("__day"), "__targets").agg(F.count("*").alias("__n")).withColumn("t", F.explode("__targets"))
    later = F.sum("__n").over(Window.partitionBy(by, "t").orderBy(F.col("__day").desc())) - F.col("__n")
    days = days.withColumn("left", F.lit(max_rows) - later).filter("left > 0").groupBy(by, "__day", "__n").agg(F.collect_list(F.struct("t", "left")).alias("__fits"))
    d = null_safe_join(df.withColumn("__day", day), days, [by, "__day"], "inner", nullable=[by])
    fits = lambda rank: F.transform(F.filter("__fits", lambda f: f["left"] >= rank), lambda f: f["t"])
    uncut = F.forall("__fits", lambda f: f["left"] >= F.col("__n"))
    ranked = d.filter(~uncut).withColumn("__rank", F.row_number().over(Window.partitionBy(by, "__day").orderBy(F.col(tie).desc())))
    d = d.filter(uncut).withColumn("__targets", fits(F.lit(0))).unionByName(ranked.withColumn("__targets", fits(F.col("__rank"))).drop("__rank"))
    return d.filter(F.size("__targets") > 0).select(*whole.columns)


def training_copies(df: DataFrame, by: str, k: int, fold: str = "oof_fold") -> DataFrame:
    """Each row once for every fit it trains, tagged with its ``block``."""
    d = df if "__targets" in df.columns else with_targets(df, by, k, fold=fold)
    return d.withColumn("__target", F.explode("__targets")).withColumn("block", block(by, F.col("__target"))).drop("__target", "__targets")


def feature_stats(df: DataFrame, by: str, features: list[str]) -> DataFrame:
    aggs = [a for c in features for a in (F.avg(c).alias(f"__mu_{c}"), F.stddev_samp(c).alias(f"__sd_{c}"))]
    return df.groupBy(by).agg(F.count("*").alias("__rows"), *aggs)


def standardised(df: DataFrame, stats: DataFrame, by: str, features: list[str], how: str = "inner") -> DataFrame:
    """Features on the scale of their market, missing ones at its mean with an indicator of their own."""
    d = df.join(stats.drop("__rows"), by, how)
    z = {f"__z_{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"__mu_{c}"), F.nullif(f"__sd_{c}", F.lit(0.0))), F.lit(0.0)) for c in features}
    m = {f"__m_{c}": F.col(c).isNull().cast("double") for c in features}
    return d.withColumns({**z, **m, "__one": F.lit(1.0)}).drop(*[f"__{s}_{c}" for s in ("mu", "sd") for c in features])


def _inputs(features: list[str]) -> list[str]:
    return ["__one", *[f"__z_{c}" for c in features], *[f"__m_{c}" for c in features]]


@dataclass
class BlockModel:
    """Logistic regressions of all blocks: each (market, fold) has coefficients of its own, a row of ``coefficients`` (block, w).

    All blocks are fitted in the same passes over the data, so there is no loop over markets, and a hot market spreads over all tasks.
    """

    coefficients: DataFrame | None
    stats: DataFrame
    by: str
    features: list[str]

    def score(self, df: DataFrame, out: str, fold: Column | None = None, how: str = "inner") -> DataFrame:
        """Adds the raw probability of the full fit, or of the fit that left a row's fold out.

        A row without any fit goes; with ``how`` "left" it stays, with null.
        """
        if self.coefficients is None:
            return df.filter(F.lit(how == "left")).withColumn(out, F.lit(None).cast("double"))
        d = df.withColumn("__block", block(self.by, fold if fold is not None else F.lit(FULL))).join(F.broadcast(self._terms()), "__block", how)
        eta = reduce(lambda a, b: a + b, [F.col("__w"), *[
            F.coalesce((F.col(c).cast("double") - F.col(f"__mu{i}")) / F.col(f"__sd{i}") * F.col(f"__z{i}"), F.col(f"__m{i}")) for i, c in enumerate(self.features)]])
        return d.select(*df.columns, (1 / (1 + F.exp(-eta))).alias(out))

    def _terms(self) -> DataFrame:
        """Scale and coefficients of each block in columns of their own, worked out once a block: what a row does with them must
        stay short, as methods that are too long are never compiled to machine code. The driver has held all of it.
        """
        n = len(self.features)
        name = F.expr("substring(block, 1, length(block) - length(substring_index(block, '|', -1)) - 1)")
        d = self.coefficients.withColumn("__name", name).join(self.stats.withColumn("__name", F.col(self.by).cast("string")), "__name")
        columns = [F.col("block").alias("__block"), F.col("w")[0].alias("__w")]
        for i, c in enumerate(self.features):
            flat = F.coalesce(F.col(f"__sd_{c}") == 0, F.lit(True))
            columns += [F.coalesce(f"__mu_{c}", F.lit(0.0)).alias(f"__mu{i}"), F.when(flat, 1.0).otherwise(F.col(f"__sd_{c}")).alias(f"__sd{i}"),
                        F.when(flat, 0.0).otherwise(F.col("w")[1 + i]).alias(f"__z{i}"), F.col("w")[1 + n + i].alias(f"__m{i}")]
        return d.select(*columns)


def _probability(inputs: list[str]) -> Column:
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [F.col("w")[i] * F.col(c) for i, c in enumerate(inputs)])))


#: Rows of a market that are stored packed together at most, rows that a task packs at a time, and packs in an Arrow batch.
PACK_ROWS, HELD_ROWS, PACKS = 1 << 16, 1 << 18, 32


def _packs(by: str, scales: dict, n_features: int):
    """Partition function: (market, x, missing, y, mask) of up to ``PACK_ROWS`` rows of a market as bytes of arrays.

    ``x`` holds the standardised features, column by column, as ``standardised`` makes them. A fit reads the rows once in
    every step, and what that costs is the passing of rows and columns one by one.
    """
    at = {m: i for i, m in enumerate(scales)}
    mu, sd = (np.array([[np.nan if v is None else v for v in s[i]] for s in scales.values()], float).reshape(len(at), n_features) for i in (0, 1))
    flat = np.isnan(sd) | (sd == 0)

    def pack(rows: pa.Table) -> pa.RecordBatch:
        coded = rows.column(by).combine_chunks().dictionary_encode()
        code = np.array([at[v] for v in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        order = np.argsort(code, kind="stable")
        code = code[order]
        x, missing = np.zeros((n_features, len(code))), np.zeros((n_features, len(code)), np.uint8)
        for i in range(n_features):
            c = rows.column(f"f{i}").combine_chunks()
            missing[i] = c.is_null().to_numpy(zero_copy_only=False)[order]
            with np.errstate(divide="ignore", invalid="ignore"):
                z = (c.to_numpy(zero_copy_only=False)[order] - mu[code, i]) / sd[code, i]
            x[i] = np.where((missing[i] > 0) | flat[code, i], 0.0, z)
        y = rows.column("y").to_numpy()[order]
        mask = rows.column("mask").to_numpy()[order]
        out = []
        ends = np.searchsorted(code, np.arange(len(at) + 1))
        for m, market in enumerate(at):
            for low in range(ends[m], ends[m + 1], PACK_ROWS):
                s = slice(low, min(low + PACK_ROWS, ends[m + 1]))
                out.append((market, x[:, s].tobytes(), missing[:, s].tobytes(), y[s].tobytes(), mask[s].tobytes()))
        kinds = [rows.schema.field(by).type, *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[by, "x", "missing", "y", "mask"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD_ROWS:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    return run


def _block_sums(by: str, at: dict, w: np.ndarray):
    """Partition function: (cell, sums) of packed rows per block: number, loss, gradient and upper half of the Hessian at ``w`` (market x target x input)."""
    markets, targets, p = w.shape
    upper = np.triu_indices(p)

    def add(total: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray, member: np.ndarray) -> None:
        eta = w @ x
        e = np.exp(-np.abs(eta))
        d = 1 / (1 + e)
        prob = np.where(eta >= 0, d, e * d)
        total[:, 0] += member.sum(axis=1)
        total[:, 1] += ((np.maximum(eta, 0) - y * eta - np.log(d)) * member).sum(axis=1)
        total[:, 2:2 + p] += ((prob - y) * member) @ x.T
        v = e * d * d * member
        for t in range(targets):
            total[t, 2 + p:] += ((x * v[t]) @ x.T)[upper]

    def run(batches):
        total = np.zeros((markets, targets, 2 + p + len(upper[0])))
        for b in batches:
            for market, *packed in zip(*(b.column(c) for c in (by, "x", "missing", "y", "mask")), strict=True):
                z, missing, y, mask = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(packed, (float, np.uint8, float, np.int32), strict=True))
                n, m = len(y), at[market.as_py()]
                for low in range(0, n, 1 << 12):  # what stays in a core's cache
                    s = slice(low, min(low + (1 << 12), n))
                    x = np.concatenate([np.ones((1, s.stop - low)), z.reshape(-1, n)[:, s], missing.reshape(-1, n)[:, s]])
                    add(total[m], w[m], x, y[s], ((mask[s] >> np.arange(targets)[:, None]) & 1).astype(float))
        total = total.reshape(markets * targets, -1)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["cell", "sums"])

    return run


def _newton_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray, bound: int | None) -> np.ndarray:
    """The minimum of each block's quadratic model; the coefficient ``bound`` may not become negative."""
    new = w - np.linalg.solve(hess, grad[..., None])[..., 0]
    if bound is not None:
        low = new[:, bound] < 0
        free = np.delete(np.arange(w.shape[1]), bound)
        g = grad[low] - hess[low][:, :, bound] * w[low, bound, None]  # after the step that takes the coefficient to zero
        new[low, bound] = 0.0
        new[np.ix_(low, free)] = w[np.ix_(low, free)] - np.linalg.solve(hess[low][:, free][:, :, free], g[:, free, None])[..., 0]
    return new


@dataclass
class BlockRows:
    """Standardised training rows, stored packed for fits with any penalty; ``mask`` has a bit for each fit that a row trains."""

    rows: DataFrame
    stats: DataFrame
    markets: list
    by: str
    features: list[str]
    k: int


def block_rows(train: DataFrame, features: list[str], label: str, by: str = "market", k: int = OOF_FOLDS) -> BlockRows:
    train = train if "__targets" in train.columns else with_targets(train, by, k)
    stats = materialise(feature_stats(train, by, features), "feature-stats")
    scales = {r[by]: ([r[f"__mu_{c}"] for c in features], [r[f"__sd_{c}"] for c in features]) for r in stats.filter(F.col(by).isNotNull()).collect()}
    mask = reduce(lambda a, b: a + b, [F.array_contains("__targets", t).cast("int") * (1 << i) for i, t in enumerate([*range(k), FULL])])
    d = train.filter(F.col(by).isNotNull()).select(by, F.col(label).cast("double").alias("y"), mask.alias("mask"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    schema = T.StructType([train.schema[by], *[T.StructField(c, T.BinaryType()) for c in ("x", "missing", "y", "mask")]])
    return BlockRows(materialise(d.mapInArrow(_packs(by, scales, len(features)), schema), "block-rows"), stats, sorted(scales), by, features, k)


def fit_stored(held: BlockRows, l2: float = 1e-4, max_iter: int = 30, increasing: str | None = None, tolerance: float = 1e-7) -> BlockModel:
    """Newton's method for all blocks at once: a pass over the rows adds up each block's gradient and Hessian, the driver solves the blocks.

    A block's step that does not lower its loss is halved. What reaches the driver is a few dozen numbers per block. A block
    without rows has the minimum of its penalty, zero.
    """
    spark, inputs = held.rows.sparkSession, _inputs(held.features)
    if not held.markets:
        return BlockModel(None, held.stats, held.by, held.features)
    p, shape = len(inputs), (len(held.markets), held.k + 1)
    at = {m: i for i, m in enumerate(held.markets)}
    bound = inputs.index(f"__z_{increasing}") if increasing else None
    upper = np.triu_indices(p)
    best = np.zeros((shape[0] * shape[1], p))
    trial, lowest = best.copy(), np.full(len(best), np.inf)
    grad, hess = np.zeros_like(best), np.zeros((len(best), p, p))
    for _ in range(max_iter):
        run = _block_sums(held.by, at, trial.reshape(*shape, p))
        d = held.rows.mapInArrow(run, "cell long, sums array<double>").select("cell", F.posexplode("sums").alias("i", "v"))
        with batches_of(spark, PACKS):
            got = d.groupBy("cell", "i").agg(F.sum("v").alias("v")).toArrow()
        sums = np.zeros((len(best), 2 + p + len(upper[0])))
        sums[got["cell"].to_numpy(), got["i"].to_numpy()] = got["v"].to_numpy()
        sums[:, 1:] /= np.maximum(sums[:, :1], 1)
        loss = sums[:, 1] + l2 / 2 * (trial ** 2).sum(axis=1)
        better = loss <= lowest + 1e-10
        best[better], lowest[better] = trial[better], loss[better]
        grad[better] = sums[better, 2:2 + p] + l2 * trial[better]
        full = np.zeros((int(better.sum()), p, p))
        full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = sums[better, 2 + p:]
        hess[better] = full + l2 * np.eye(p)
        slope = np.abs(grad)
        if bound is not None:
            at_bound = best[:, bound] <= 0
            slope[at_bound, bound] = np.maximum(0, -grad[at_bound, bound])
        todo = slope.max(axis=1) > tolerance
        if not todo.any():
            break
        step = todo & better
        trial = np.where(better[:, None], best, (trial + best) / 2)
        trial[step] = _newton_step(best[step], grad[step], hess[step], bound)
    names = [f"{m}|{t if t < held.k else FULL}" for m in held.markets for t in range(shape[1])]
    coefficients = spark.createDataFrame(pa.table({"block": names, "w": pa.array(list(best), pa.list_(pa.float64()))}))
    return BlockModel(coefficients, held.stats, held.by, held.features)


def fit_blocks(train: DataFrame, features: list[str], label: str, by: str = "market", k: int = OOF_FOLDS, l2: float = 1e-4, max_iter: int = 30, increasing: str | None = None) -> BlockModel:
    """``train`` holds ``oof_fold``, or ``__targets``. ``increasing`` names a feature whose effect may not be negative.

    A block's coefficients minimise its own mean loss plus ``l2`` / 2 times their squares, however many other blocks are
    fitted beside it. Stores the training rows while it runs. Without rows nothing is fitted.
    """
    held = block_rows(train, features, label, by, k)
    model = fit_stored(held, l2, max_iter, increasing)
    discard(held.rows)
    return model


def block_gradients(model: BlockModel, train: DataFrame, label: str, l2: float, k: int = OOF_FOLDS) -> DataFrame:
    """(block, n, worst): the largest gradient of a block's mean loss and penalty in its coefficients.

    Near zero for every block, it proves that the joint fit has found each block's own minimum.
    """
    inputs = _inputs(model.features)
    d = training_copies(standardised(train, model.stats, model.by, model.features), model.by, k).join(model.coefficients, "block")
    d = d.withColumn("__r", _probability(inputs) - F.col(label).cast("double"))
    g = d.groupBy("block").agg(F.count("*").alias("n"), F.first("w").alias("w"), F.array(*[F.avg(F.col("__r") * F.col(c)) for c in inputs]).alias("g"))
    return g.select("block", "n", F.array_max(F.zip_with("g", "w", lambda a, w: F.abs(a + l2 * w))).alias("worst"))


@dataclass
class BoostedBlocks:
    """Gradient-boosted trees per market and fold, for users who want the trees and accept one fit per block."""

    models: dict
    by: str
    features: list[str]
    stats: DataFrame

    def score(self, df: DataFrame, out: str, fold: Column | None = None) -> DataFrame:
        d = standardised(df, self.stats, self.by, self.features).withColumn("block", block(self.by, fold if fold is not None else F.lit(FULL)))
        d = VectorAssembler(inputCols=_inputs(self.features), outputCol="features").transform(d)
        parts = [m.transform(d.filter(F.col("block") == b)).select(*df.columns, vector_to_array("probability")[1].alias(out)) for b, m in self.models.items()]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def fit_boosted(train: DataFrame, features: list[str], label: str, by: str = "market", k: int = OOF_FOLDS, config: dict | None = None, max_iter: int = 20) -> BoostedBlocks:
    c = config or CONFIGS["default"]
    stats = materialise(feature_stats(train, by, features), "feature-stats")
    d = standardised(train, stats, by, features)
    d = VectorAssembler(inputCols=_inputs(features), outputCol="features").transform(d)
    d = training_copies(d, by, k).select("block", label, "features")
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, stepSize=c["step"], maxDepth=(c["leaves"] + 1).bit_length() - 1, minInstancesPerNode=c["min_leaf"], seed=0)
    blocks = [r["block"] for r in d.select("block").distinct().orderBy("block").collect()]
    return BoostedBlocks({b: gbt.fit(d.filter(F.col("block") == b)) for b in blocks}, by, features, stats)


@dataclass
class MarketModel:
    """Booster, isotonic calibration and shrinkage towards the market, fitted per market."""

    booster: object
    calibration: DataFrame
    shrink: DataFrame
    oof: DataFrame
    report: DataFrame
    by: str
    features: list[str]
    #: The stored table that ``oof`` reads.
    scored: DataFrame | None = None

    def predict(self, df: DataFrame, logit_cons: str = "logit_cons", out: str = "p_over_model") -> DataFrame:
        """Adds the probability of the over or home side; null where the market is unknown."""
        d = self.booster.score(df, "__raw")
        d = _calibrated(d, self.calibration, self.by)
        return _final(d.join(self.shrink.select(self.by, "shrink"), self.by), logit_cons, out).select(*df.columns, out)


def _calibrated(d: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    return apply_isotonic(d, blocks, [by], "__raw", "__cal")


def _final(d: DataFrame, logit_cons: str, out: str) -> DataFrame:
    lc = F.col(logit_cons)
    return d.withColumn(out, P.expit(lc + F.col("shrink") * (P.logit(F.col("__cal")) - lc)))


def training_rows(props: DataFrame, by: str, min_rows: int, label: str = "won", logit_cons: str = "logit_cons") -> DataFrame:
    """Rows with label and anchor of the markets that have enough of them."""
    d = props.filter(F.col(label).isNotNull() & F.col(logit_cons).isNotNull())
    return d.join(_big(d, by, min_rows), by, "left_semi")


def _big(d: DataFrame, by: str, min_rows: int) -> DataFrame:
    return d.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows).select(by)


def fit_market_model(props: DataFrame, features: list[str], tie: str, by: str = "market", label: str = "won", logit_cons: str = "logit_cons", k: int = OOF_FOLDS, booster: str = "linear", config: dict | None = None, min_rows: int = MIN_ROWS, max_rows: int | None = None) -> MarketModel:
    """Fits every market: out-of-fold scores by date, isotonic on them, shrinkage on that, and a fit over all folds.

    A fit takes all rows of its market and folds, or with ``max_rows`` the most recent ones. Scores, isotonic curves,
    shrinkage and the report cover all rows, each scored by the fit that left its fold out.
    """
    c = config or CONFIGS["default"]
    rows, train, feats = _prepared(props, features, tie, by, label, logit_cons, k, min_rows, max_rows)
    if booster == "linear":
        b = fit_blocks(train, feats, label, by, k, l2=1e-4 * c["l2"])
    elif booster == "gbt":
        b = fit_boosted(train, feats, label, by, k, c)
    else:
        raise ValueError(f"unknown booster {booster!r}")
    m = _blended(b, rows, by, label, logit_cons, feats)
    discard(rows)
    return m


def _prepared(props: DataFrame, features: list[str], tie: str, by: str, label: str, logit_cons: str, k: int, min_rows: int, max_rows: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with their fold, those of them that the booster is fitted on, and its features.

    Rows are stored before markets and days are counted, so what makes them runs once.
    """
    d = materialise(props.filter(F.col(label).isNotNull() & F.col(logit_cons).isNotNull()), "model-rows")
    rows = stored_fold(d.join(materialise(_big(d, by, min_rows), "model-markets"), by, "left_semi"), k)
    return rows, with_targets(rows, by, k, max_rows, tie), list(dict.fromkeys([*features, logit_cons]))


def _blended(b, rows: DataFrame, by: str, label: str, logit_cons: str, feats: list[str]) -> MarketModel:
    """What follows the booster: isotonic curves, shrinkage and report on out-of-fold scores.

    ``oof`` is one stored table, the rows with their calibrated score; the rest of it is worked out when read.
    """
    raw = b.score(rows, "__raw", F.col("oof_fold"))
    stored = isinstance(b, BoostedBlocks)  # trees; a linear score is a few products a row
    raw = materialise(raw, "model-oof") if stored else raw
    iso = materialise(fit_isotonic(raw, [by], "__raw", label), "model-isotonic")
    cal = materialise(_calibrated(raw, iso, by).drop("__raw"), "model-final")
    if stored:
        discard(raw)
    shrink = materialise(best_shrink(shrink_grid(cal.withColumn("__lm", P.logit(F.col("__cal"))), [by], label, logit_cons, "__lm"), [by]), "model-shrink")
    oof = _final(cal.join(shrink.select(by, "shrink"), by), logit_cons, "p_over_oof")
    ll = lambda p: F.avg(P.log_loss(F.col(label), p))
    report = oof.groupBy(by).agg(F.count("*").alias("n_train"), F.max("shrink").alias("shrink"), ll(P.expit(F.col(logit_cons))).alias("ll_market"), ll(F.col("__cal")).alias("ll_model"), ll(F.col("p_over_oof")).alias("ll_final"))
    report = materialise(report.withColumn("model_gain", F.col("ll_market") - F.col("ll_final")), "model-report")
    return MarketModel(b, iso, shrink, oof.drop("__cal"), report, by, feats, cal)


def importances(model: MarketModel, df: DataFrame, label: str, tie: str, n: int | None = 20_000, top: int = 10) -> DataFrame:
    """(market, feature, loss_gain): rise in log loss when one feature is shuffled, over ``n`` rows of a market or, with None, all.

    A shuffled column is the column of the row that has the same number under another order of the rows.
    """
    by, mix = model.by, F.xxhash64
    order = Window.partitionBy(by).orderBy(mix(F.col(tie)), F.col(tie))
    columns = [by, label, tie, "__r", *[F.col(c).cast("double").alias(c) for c in model.features]]
    if n is None:
        sample = ordered_rank(ordered_rank(df, [by], mix(F.col(tie)), [tie], "__r", "__n").select(*columns), [by], mix(F.col(tie), F.lit(17)), [tie], "__s", "__n").drop("__n")
    else:
        sample = df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n)
        other = Window.partitionBy(by).orderBy(mix(F.col(tie), F.lit(17)), F.col(tie))
        sample = sample.select(*columns).withColumn("__s", F.row_number().over(other))
    sample = materialise(sample, "importance")
    parts = [sample.withColumn("feature", F.lit(""))]
    for c in model.features:
        donor = sample.select(F.col(by).alias("__b"), F.col("__s").alias("__d"), F.col(c).alias("__v"))
        d = sample.join(donor, (F.col(by) == F.col("__b")) & (F.col("__r") == F.col("__d")))
        parts.append(d.withColumn(c, F.col("__v")).withColumn("feature", F.lit(c)).select(*parts[0].columns))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    g = model.booster.score(whole, "__p").groupBy(by, "feature").agg(F.avg(P.log_loss(F.col(label), F.col("__p"))).alias("ll"))
    base = g.filter("feature = ''").select(by, F.col("ll").alias("base"))
    g = g.filter("feature <> ''").join(base, by).select(by, "feature", (F.col("ll") - F.col("base")).alias("loss_gain"))
    best = Window.partitionBy(by).orderBy(F.col("loss_gain").desc(), "feature")
    return g.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= top).drop("__rn")


def tune(props: DataFrame, features: list[str], tie: str, by: str = "market", configs: dict | None = None, booster: str = "linear") -> DataFrame:
    """(market, config, n, log_loss, best): blended out-of-fold loss of each named configuration."""
    named = configs or CONFIGS
    if booster == "linear":  # reads the penalty only: one fit for each, over rows stored once
        rows, train, feats = _prepared(props, features, tie, by, "won", "logit_cons", OOF_FOLDS, MIN_ROWS)
        held = block_rows(train, feats, "won", by)
        fits = {}
        for x in dict.fromkeys(c["l2"] for c in named.values()):
            fits[x] = _blended(fit_stored(held, 1e-4 * x), rows, by, "won", "logit_cons", feats)
            discard(fits[x].scored)
        discard(held.rows)
        discard(rows)
        models = {name: fits[c["l2"]] for name, c in named.items()}
    else:
        models = {name: fit_market_model(props, features, tie, by, config=c, booster=booster) for name, c in named.items()}
    out = None
    for name, m in models.items():
        r = m.report.select(by, F.lit(name).alias("config"), F.col("n_train").alias("n"), F.col("ll_final").alias("log_loss"))
        out = r if out is None else out.unionByName(r)
    lead = F.min(F.struct("log_loss", "config")).over(Window.partitionBy(by))
    return out.withColumn("best", lead["config"] == F.col("config"))
