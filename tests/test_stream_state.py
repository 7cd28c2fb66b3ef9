"""Deduplicating streams: state on disk, and micro-batches by bytes."""
import glob

from pyspark.sql import functions as F

from quotelab.session import scratch_dir
from quotelab.streaming import live as LV


def test_many_small_files_are_one_batch_and_state_is_on_disk(spark):
    base = scratch_dir(spark, "small-files").replace("file://", "")
    rows = spark.range(400).select((F.col("id") % 100).alias("k"), F.to_timestamp(F.lit("2024-01-01 10:00:00")).alias("ts"))
    rows.repartition(20).write.json(f"{base}/in")
    before = {k: spark.conf.get(k, None) for k in LV.STATE_STORE}
    src = LV.snapshot_stream(spark, f"{base}/in", "k bigint, ts timestamp", max_bytes=1 << 20)
    LV.to_table(LV.deduplicated(src, ["k"], "ts"), f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{base}/out").collect()) == list(range(100))
    kept = [open(f).read() for f in glob.glob(f"{base}/checkpoint/offsets/[0-9]*")]
    assert sum('"logOffset":0' in o for o in kept) >= 1 and not any('"logOffset":1' in o for o in kept)
    assert all("RocksDBStateStoreProvider" in o for o in kept)
    assert {k: spark.conf.get(k, None) for k in LV.STATE_STORE} == before
