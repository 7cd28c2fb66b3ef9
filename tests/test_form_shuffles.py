import datetime as dt

from pyspark.sql import functions as F

from quotelab.operators import form as FM
from quotelab.operators.skew import ordered_rank


def test_rows_are_shuffled_once_for_join_and_windows(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(None if k % 3 == 0 else k % 3, day + dt.timedelta(days=k), k, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "who long, ts timestamp, id long, x double")
    d = FM.lagged_form(df, "who", "ts", "id", ["x"], (3,), "f_", "prior", chunk_rows=5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "coalesce(who" not in plan  # keys of a null-safe join, by which no window is partitioned
    got = {(r.who, r.id): (r.prior, r.f_x_r3, r.f_x_exp) for r in d.collect()}
    for who in (None, 1, 2):
        mine = [r for r in rows if r[0] == who]
        for i, (_, _, k, _) in enumerate(mine):
            past = [r[3] for r in mine[:i]]
            last = past[-3:]
            assert got[who, k] == (i, sum(last) / len(last) if len(last) >= 2 else None, sum(past) / i if i >= 3 else None)


def test_ranks_over_ranges_with_null_groups(spark):
    rows = [(None if k % 4 == 0 else "ab"[k % 2], (k * 7) % 11, k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(7)
    r = ordered_rank(df, ["g"], F.col("v"), ["id"])
    assert "row_number" not in r._jdf.queryExecution().optimizedPlan().toString()
    got = {x.id: (x.rank, x.group_rows) for x in r.collect()}
    for g in (None, "a", "b"):
        mine = sorted((v, k) for h, v, k in rows if h == g)
        assert all(got[k] == (i + 1, len(mine)) for i, (_, k) in enumerate(mine))
