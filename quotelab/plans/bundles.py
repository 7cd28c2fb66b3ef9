"""Trained bundles on disk: saved whole or not at all, loaded by another process.

A bundle is written into a folder of its own: Spark ML writers for trees, Parquet for coefficients, curves, shrinkage,
thresholds and segments. Last, a numbered file lists it with the rows of every table, and makes it the current one.
"""
from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from quotelab.dims import Books
from quotelab.operators.model import BlockModel, BoostedBlocks, MarketModel
from quotelab.operators.selection import SelectionCalibrator
from quotelab.plans.walk import Bundle
from quotelab.sources.versions import VersionLog


class _Writer:
    def __init__(self, at: str):
        self.at, self.rows = at, {}

    def table(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.at}/{name}")
        self.rows[name] = df.sparkSession.read.parquet(f"{self.at}/{name}").count()

    def blocks(self, name: str, model: BlockModel | BoostedBlocks | None) -> dict | None:
        if model is None:
            return None
        self.table(f"{name}-stats", model.stats)
        about = {"by": model.by, "features": model.features}
        if isinstance(model, BoostedBlocks):
            names = list(model.models)
            for k, block in enumerate(names):
                model.models[block].write().save(f"{self.at}/{name}-trees-{k}")
            return {**about, "kind": "trees", "blocks": names}
        if model.coefficients is None:
            return {**about, "kind": "nothing"}
        self.table(f"{name}-coefficients", model.coefficients)
        return {**about, "kind": "blocks"}


def save_bundle(bundle: Bundle, path: str) -> int:
    """Saves ``bundle`` below ``path`` and returns its number. Out-of-fold scores stay behind: serving does not read them."""
    spark = bundle.thresholds.sparkSession
    log = VersionLog(spark, f"{path.rstrip('/')}/_bundles")
    number = max(log.numbers(), default=0) + 1
    folder = f"bundle-{uuid.uuid4().hex}"
    w = _Writer(f"{path.rstrip('/')}/{folder}")
    model, selection = bundle.model, bundle.selection
    for name, df in (("calibration", model.calibration), ("shrink", model.shrink), ("report", model.report), ("curves", selection.curves),
                     ("thresholds", bundle.thresholds), ("segments", bundle.segments)):
        w.table(name, df)
    content = {
        "folder": folder, "booster": w.blocks("booster", model.booster), "conditional": w.blocks("conditional", selection.conditional),
        "model_by": model.by, "features": model.features, "selection_by": selection.by, "rich": selection.rich, "books": asdict(selection.books), "rows": w.rows,
    }
    log.publish(number, content)
    return number


def load_bundle(spark: SparkSession, path: str, number: int | None = None) -> Bundle | None:
    """The bundle of that number, the last one by default; None without any. One that has lost rows since is refused."""
    log = VersionLog(spark, f"{path.rstrip('/')}/_bundles")
    numbers = log.numbers()
    if not numbers:
        return None
    about = log.read(numbers[-1] if number is None else number)
    at = f"{path.rstrip('/')}/{about['folder']}"

    def table(name: str) -> DataFrame:
        df = spark.read.parquet(f"{at}/{name}")
        if df.count() != about["rows"][name]:
            raise ValueError(f"{at}/{name} does not hold the rows that were saved")
        return df

    def blocks(name: str):
        b = about[name]
        if b is None:
            return None
        stats = table(f"{name}-stats")
        if b["kind"] == "trees":
            return BoostedBlocks({k: GBTClassificationModel.load(f"{at}/{name}-trees-{i}") for i, k in enumerate(b["blocks"])}, b["by"], b["features"], stats)
        return BlockModel(None if b["kind"] == "nothing" else table(f"{name}-coefficients"), stats, b["by"], b["features"])

    model = MarketModel(blocks("booster"), table("calibration"), table("shrink"), None, table("report"), about["model_by"], about["features"])
    selection = SelectionCalibrator(table("curves"), blocks("conditional"), about["rich"], about["selection_by"], Books(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["books"].items()}))
    return Bundle(model, selection, table("thresholds"), table("segments"))
