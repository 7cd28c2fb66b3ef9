"""Stored tables that survive crashes: ledger versions, repeated batches, half-written and damaged tables, saved bundles."""
import os

import pytest
from pyspark.sql import functions as F

from quotelab.plans import ledger as LG
from quotelab.sources import tables as TB
from quotelab.sources.versions import VersionedTable
from quotelab.streaming import live as ST

PICK = "game_date date, market string, subject string, line double, side string, book string, generated_at int, ev double"


def _picks(spark, sweep, days=("2024-01-01", "2024-01-02")):
    rows = [(d, "m", f"s{k}", None, "over", "b", sweep, sweep + k / 10) for d in days for k in range(4)]
    return spark.createDataFrame(rows, PICK.replace("game_date date", "game_date string")).withColumn("game_date", F.to_date("game_date"))


def _held(spark, path):
    return sorted((str(r.game_date), r.subject, r.generated_at) for r in LG.read_picks(spark, path).collect())


def test_a_crash_before_publishing_leaves_the_old_ledger(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    assert LG.read_picks(spark, path) is None
    LG.upsert_picks(_picks(spark, 1), path, writer="w", batch=0)
    before = _held(spark, path)

    def crash():
        raise OSError("killed")

    with pytest.raises(OSError):
        LG.upsert_picks(_picks(spark, 2), path, writer="w", batch=1, before_publish=crash)
    assert _held(spark, path) == before and VersionedTable(spark, path).whole()
    LG.upsert_picks(_picks(spark, 2, ("2024-01-02", "2024-01-03")), path, writer="w", batch=1)
    after = _held(spark, path)
    assert [v for *_, v in after] == [1] * 4 + [2] * 8
    LG.upsert_picks(_picks(spark, 3), path, writer="w", batch=1)  # the batch is in already
    assert _held(spark, path) == after
    table = VersionedTable(spark, path, "game_date")
    table.vacuum(1)
    assert _held(spark, path) == after and table.current().number == 2 and len([f for f in os.listdir(f"{path}/_versions") if f.endswith(".json")]) == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "k")
    base = table.current()
    rows = spark.createDataFrame([(None, 1), ("a b/c", 2), ("é", 3)], "k string, v int")
    table.replace(rows, base, None)
    with pytest.raises(RuntimeError):
        table.replace(rows.limit(1), base, None)
    assert table.read().count() == 3 and sorted(table.current().folders) == ["a b/c", "null", "é"]
    assert [r.v for r in table.read(parts=["a b/c"]).collect()] == [2]
    table.replace(rows.limit(0), table.current(), ["null"])
    assert table.read().count() == 2 and table.whole()
    table.replace(rows.limit(0), table.current(), None)
    assert table.read().isEmpty() and table.read().columns == ["k", "v"]


def test_damaged_and_half_written_tables_count_as_missing(spark, tmp_path):
    garbage = tmp_path / "garbage"
    garbage.mkdir()
    (garbage / "part-0.parquet").write_bytes(b"not parquet at all")
    assert TB.read_fitted(spark, str(garbage), "a int").columns == ["a"] and TB.read_fitted(spark, str(garbage), None) is None
    path = f"{tmp_path}/fitted"
    TB.write_fitted(spark.range(100).repartition(4), path)
    assert TB.read_fitted(spark, path, None).count() == 100
    parts = [f for f in os.listdir(path) if f.endswith(".parquet")]
    os.remove(f"{path}/{parts[0]}")
    assert TB.read_fitted(spark, path, None) is None
    base, built = f"{tmp_path}/d", []

    def build():
        built.append(1)
        return spark.range(5)

    config = {"a": 1}
    half = f"{base}/n/config={TB.config_sig(config)}"
    spark.range(3).write.parquet(half)  # data without a note: its writer died
    for _ in range(2):
        assert TB.derived(spark, base, "n", config, build).count() == 5
    assert len(built) == 1


def test_seasons_deduplicate_on_an_id(spark, tmp_path):
    TB.write_stage(spark.createDataFrame([(1, 2023), (1, 2023), (1, 2024), (2, 2024)], "game_id int, season int"), f"{tmp_path}/g")
    assert TB.read_seasons(spark, f"{tmp_path}/g", [2023, 2024], unique=("game_id",)).count() == 2
    assert TB.read_seasons(spark, f"{tmp_path}/g", [2024]).count() == 2


def test_state_stays_small_over_many_batches(spark, tmp_path):
    """Thirty micro-batches leave a bounded number of folders and the last state of every key."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(30):
        spark.createDataFrame([(k % 4, k), (9, k)], "key int, v int").coalesce(1).write.mode("append").json(src)
    stream = ST.snapshot_stream(spark, src, "key int, v int", max_files=1)
    state = stream.groupBy("key").agg(F.max("v").alias("v"), F.count("*").alias("n"))
    ST.updates_to_table(state, out, f"{tmp_path}/cp", ["key"], once=True, compact_after=6).awaitTermination()
    assert sorted(tuple(r) for r in ST.current(spark, out, ["key"]).collect()) == [(0, 28, 8), (1, 29, 8), (2, 26, 7), (3, 27, 7), (9, 29, 30)]
    assert len(os.listdir(f"{out}/data")) <= 2 * 6 + 1 and len(VersionedTable(spark, out).current().folders) < 6


def test_latest_rows_at_ties_and_missing_dates(spark):
    from quotelab.operators.evaluate import most_recent

    rows = [("a", d, k) for k, d in enumerate(["2024-01-01"] * 3 + ["2024-01-02"] * 4 + [None] * 2)] + [(None, "2024-01-05", 20), ("b", None, 21)]
    df = spark.createDataFrame(rows, "g string, game_date string, k int")
    for n in range(11):
        want = set()
        for g in ("a", "b", None):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] or "", r[2]))
            want |= {r[2] for r in mine[len(mine) - min(n, len(mine)):]}
        assert {r.k for r in most_recent(df, ["g"], n, "k").collect()} == want


def test_bundles_of_trees_come_back(spark, tmp_path):
    """Saved trees score as before; a bundle that lost rows is refused, and one that was never published does not count."""
    from quotelab.operators.model import fit_boosted
    from quotelab.operators.selection import SelectionCalibrator
    from quotelab.plans import bundles as BU
    from quotelab.plans.walk import Bundle, MarketModel
    from quotelab.dims import BOOKS

    rows = [("m" if k % 2 else "n", k % 3, float((k * 7) % 11 > 5), float((k * 7) % 11)) for k in range(600)]
    df = spark.createDataFrame(rows, "market string, oof_fold int, won double, x double")
    trees = fit_boosted(df, ["x"], "won", config={"step": 0.1, "leaves": 3, "min_leaf": 5, "l2": 1.0}, max_iter=2)
    empty = spark.createDataFrame([], "market string, v double")
    bundle = Bundle(MarketModel(trees, empty, empty, None, empty, "market", ["x"]), SelectionCalibrator(empty, None, [], "market", BOOKS), spark.createDataFrame([("m", 0.5)], "market string, threshold double"), empty)
    path = f"{tmp_path}/bundles"
    assert BU.load_bundle(spark, path) is None
    assert BU.save_bundle(bundle, path) == 1 and BU.save_bundle(bundle, path) == 2
    back = BU.load_bundle(spark, path, 1)
    scores = lambda t: sorted(map(tuple, t.score(df, "p").collect()))
    assert scores(back.model.booster) == scores(trees) and back.selection.books == BOOKS and back.thresholds.first().threshold == 0.5
    os.rename(f"{path}/_bundles/{2:012d}.json", f"{path}/_bundles/.lost")
    assert len([f for f in os.listdir(path) if f.startswith("bundle-")]) == 2 and BU.load_bundle(spark, path) is not None
    folder = next(t for t in back.thresholds.inputFiles()).removeprefix("file://").rsplit("/", 1)[0]
    os.remove(next(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet") and spark.read.parquet(f"{folder}/{f}").count()))
    with pytest.raises(ValueError):
        BU.load_bundle(spark, path, 1)
