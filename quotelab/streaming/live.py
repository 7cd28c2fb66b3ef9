"""Live snapshots as streams: source, late data, deduplication, state, scoring and upserts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotelab.operators.keys import first_per_key
from quotelab.operators.movement import CHECKPOINTS, HISTORY_MIN
from quotelab.plans.ledger import upsert_picks
from quotelab.session import discard, materialise, remove_path
from quotelab.sources.tables import read_fitted
from quotelab.sources.versions import VersionedTable

LATENESS = "12 hours"
#: State on local disk: it may outgrow the memory of executors, and a batch writes what it changed.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def snapshot_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None, partitioned: bool = False, max_bytes: int | None = None) -> DataFrame:
    """New JSON files of a directory, plain or compressed, under a fixed schema.

    With ``partitioned``, ``name=value`` folders fill the columns of the schema that bear their names. A micro-batch takes up to
    ``max_files`` files or, as files may be small and many, files of ``max_bytes`` together.
    """
    r = spark.readStream.schema(schema).option("recursiveFileLookup", str(not partitioned).lower())
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r
    return (r.option("maxBytesPerTrigger", max_bytes) if max_bytes else r).json(path)


def before_start(quotes: DataFrame, snapshot: str, start: str, lateness: str = LATENESS, horizon: float = HISTORY_MIN) -> DataFrame:
    """Quotes within ``horizon`` minutes before their start, with a watermark on the snapshot time."""
    lead = (F.unix_micros(F.col(start)) - F.unix_micros(F.col(snapshot))) / 6e7
    return quotes.withColumn("lead_min", lead).filter((lead > 0) & (lead <= horizon)).withWatermark(snapshot, lateness)


def deduplicated(quotes: DataFrame, key: list[str], snapshot: str, lateness: str | None = LATENESS) -> DataFrame:
    """The same price seen in several sweeps, once; state is dropped when the watermark has passed.

    Quotes that bring a watermark, as those of ``before_start`` do, take None for ``lateness``.
    """
    return (quotes.withWatermark(snapshot, lateness) if lateness else quotes).dropDuplicatesWithinWatermark(key)


def start_buckets(events: DataFrame, start: str, minutes: int = 30, lateness: str = LATENESS) -> DataFrame:
    """Events and earliest start per tumbling bucket of starts."""
    g = events.withWatermark(start, lateness).groupBy(F.window(start, f"{minutes} minutes").alias("w"))
    return g.agg(F.min(start).alias("first_start"), F.count("*").alias("n_events")).select(F.col("w.start").alias("bucket"), "first_start", "n_events")


def latest_state(quotes: DataFrame, key: list[str], start: str, snapshot: str, value: Column, lateness: str = LATENESS, checkpoints=CHECKPOINTS) -> DataFrame:
    """Latest value per key and, as movement, its difference to the latest value at or before each checkpoint.

    A plain streaming aggregation: one row of state per key. The start of the game is part of the key and carries
    the watermark, so a key's state goes when its game is over.
    """
    lead = (F.unix_micros(F.col(start)) - F.unix_micros(F.col(snapshot))) / 6e7
    d = quotes.withColumns({"__lead": lead, "__v": value}).filter((F.col("__lead") > 0) & (F.col("__lead") <= HISTORY_MIN)).withWatermark(start, lateness)
    at = lambda cp: F.min_by("__v", F.when(F.col("__lead") >= cp, F.col("__lead")))
    g = d.groupBy(start, *key).agg(
        F.min_by("__v", "__lead").alias("latest"), F.max(snapshot).alias("latest_ts"), F.count("*").alias("n_snapshots"), *[at(cp).alias(f"__{cp}") for cp in checkpoints])
    return g.select(start, *key, "latest", "latest_ts", "n_snapshots", *[(F.col("latest") - F.col(f"__{cp}")).alias(f"move_{cp}m") for cp in checkpoints])


def _run(writer, checkpoint: str, once: bool, every: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _state_on_disk(spark: SparkSession, start) -> StreamingQuery:
    """Starts a query under ``STATE_STORE``, which it keeps."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_table(df: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "15 minutes") -> StreamingQuery:
    """Appends final rows to a Parquet table, exactly once."""
    return _state_on_disk(df.sparkSession, lambda: _run(df.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, once, every))


def updates_to_table(df: DataFrame, path: str, checkpoint: str, key: list[str], once: bool = False, every: str = "15 minutes", compact_after: int = 8) -> StreamingQuery:
    """Adds the changed state of each micro-batch as a folder of its own, and merges all folders once there are ``compact_after``.

    A batch that is repeated is not added twice. Of merged and replaced folders those of one version before the current stay,
    for readers that have just opened it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = VersionedTable(spark, path, "batch_id")
        base = table.current()
        if base.applied.get("state", -1) >= batch_id:
            return
        after = table.replace(batch.withColumn("batch_id", F.lit(batch_id)), base, [str(batch_id)], "state", batch_id)
        if len(after.folders) >= compact_after:
            merged = first_per_key(table.read(after), key, [F.col("batch_id").desc()]).withColumn("batch_id", F.lit(batch_id))
            table.replace(merged, after, None, "state", batch_id)
            table.vacuum()

    return _run(df.writeStream.outputMode("update").foreachBatch(write), checkpoint, once, every)


def current(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Latest state per key from a table written by ``updates_to_table``."""
    return first_per_key(VersionedTable(spark, path).read(), key, [F.col("batch_id").desc()]).drop("batch_id")


def score_batches(quotes: DataFrame, score, upsert, checkpoint: str, once: bool = False, every: str = "15 minutes") -> StreamingQuery:
    """Runs a batch scoring function and a ledger upsert on every sweep.

    Both are the functions of the batch path. A sweep that runs twice after a failure leaves the same ledger.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        upsert(score(batch), batch_id)

    return _run(quotes.writeStream.foreachBatch(sweep), checkpoint, once, every)


def serve_sweeps(quotes: DataFrame, serve, path: str, checkpoint: str, writer: str = "serve", once: bool = False, every: str = "15 minutes", before_publish=None) -> StreamingQuery:
    """Runs ``serve`` (quotes of one sweep -> picks) on every sweep and merges its picks into the ledger at ``path``.

    The ledger notes the sweeps it holds, in the step that makes them current. So a sweep whose job dies is repeated by the
    restarted query, and one whose ledger was published before the query noted it is not applied again. What ``serve``
    reads besides the quotes is read anew in every sweep.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        picks = serve(batch).withColumn("generated_at", F.lit(batch_id))
        upsert_picks(picks, path, writer=writer, batch=batch_id, before_publish=before_publish)

    return _run(quotes.writeStream.foreachBatch(sweep), checkpoint, once, every)


def keep_last(rows: DataFrame, path: str, key: list[str], version: str, checkpoint: str, partition: str, tie: tuple[str, ...] = (), once: bool = False, every: str = "15 minutes") -> StreamingQuery:
    """Merges finished games into the history, the last version of a key kept; only touched partitions are rewritten.

    Touched are the partitions of the batch and those that hold an older version of one of its keys, so a record that
    moves to another partition leaves none behind. Of equal versions the one greatest in ``tie`` stays, then in the other
    columns by name.
    """

    def merge(batch: DataFrame, _: int) -> None:
        keep_last_batch(batch, path, key, version, partition, tie)

    return _run(rows.writeStream.foreachBatch(merge), checkpoint, once, every)


def keep_last_batch(batch: DataFrame, path: str, key: list[str], version: str, partition: str, tie: tuple[str, ...] = ()) -> None:
    """One batch of ``keep_last``. A partition that loses its last record loses its folder."""
    order = [version, *tie, *sorted(set(batch.columns) - {*key, version, *tie})]
    best = lambda d: first_per_key(d, key, [F.col(c).desc() for c in order])
    old = read_fitted(batch.sparkSession, path, None)
    if old is None:
        best(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        return
    old = old.select(*batch.columns)
    moved = old.join(batch.select(*key).distinct(), key, "left_semi").select(partition)
    touched = materialise(batch.select(partition).union(moved).distinct(), "touched")
    merged = materialise(best(old.join(touched, partition, "left_semi").unionByName(batch)), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    emptied = touched.join(merged.select(partition).distinct(), partition, "left_anti").collect()  # partitions of one batch
    for row in emptied:
        remove_path(batch.sparkSession, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if row[0] is None else row[0]}")
    discard(merged)
    discard(touched)
