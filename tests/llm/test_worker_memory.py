import importlib

import numpy as np

from quotelab.llm import decontaminate, language_id, packing
from quotelab.llm.queries import tokenizer_files

SF = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_a_worker_keeps_what_the_last_stage_needs_only():
    """In the driver, as every stage does it in a worker that lives through all of them."""
    from quotelab.llm import worker

    packing._encoder(*tokenizer_files())("some text")
    assert len(worker._kept) == 1
    first = worker.kept("model", lambda: language_id.Model([], np.zeros(0), {b"a": 0}, np.zeros((2, 0))))
    assert worker.kept("model", list) is first and list(worker._kept) == ["model"]
    assert not any(hasattr(m, name) for m in (packing, decontaminate, language_id) for name in ("_held", "_scorers"))


def test_stages_read_small_batches(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    before = spark.conf.get(KEY)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    try:
        spark.conf.set(KEY, "10000")
        dict(pipeline.STAGES)["line_dedup"](spark, docs, SF)
        assert int(spark.conf.get(KEY)) <= 1000
        assert all(hasattr(stage, "__wrapped__") for _, stage in pipeline.STAGES)
    finally:
        spark.conf.set(KEY, before)
