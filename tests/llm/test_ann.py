import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelab.llm import ann as A
from quotelab.llm import queries as Q

VEC = "vec_id long, embedding array<float>, v string, part int"


def _brute(rows, k=10):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i)[:k]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = _brute(rows), {}
    for r in Q.op5_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(x) == 10 and x == sorted(x) for x in got.values())
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(s - np.linalg.norm(vectors[q] - vectors[j])) < 1e-12 for q, x in got.items() for s, j in x)
    recall = np.mean([len({j for _, j in got[q]} & {j for _, j in x}) / 10 for q, x in want.items()])
    assert recall >= 0.9, recall


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).astype("f4").tolist()) for k in range(150)] + [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(1000, 1300)]
    odd = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0, 1.0]),
           (700, [1.0, 2.0]), (800, []), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], VEC)
    want = _brute(rows)
    got = {}
    for r in A.nearest_neighbours(df, F.col("vec_id") % 100 == 0, sample=200, parts=4, probes=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q, x in want.items():
        assert [j for _, j in got[q]] == [j for _, j in x] and np.allclose([s for s, _ in got[q]], [s for s, _ in x])
    few = df.filter("vec_id < 4")
    assert A.nearest_neighbours(few, F.col("vec_id") % 100 == 0).count() == 3
    assert A.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("block, query_block", [(1, 1), (7, 3)])
def test_small_blocks_and_ids_with_many_vectors(spark, monkeypatch, block, query_block):
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).astype("f4").tolist()) for k in range(0, 1200, 20)] + [(100, [2.0, 0.0, 0.0, 1.0]), (100, [-9.0, 5.0, 1.0, 1.0]), (20, [-9.0, 5.0, 1.0, 2.0])]
    got = {}
    for r in A.nearest_neighbours(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VEC), F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = {i: min(v for j, v in rows if j == i) for i, _ in rows if i % 100 == 0}
    assert got.keys() == asked.keys()
    for q, v in asked.items():
        want = sorted((float(np.linalg.norm(np.subtract(v, w))), j) for j, w in rows if j != q)[:3]
        assert [j for j, _ in got[q]] == [j for _, j in want] and np.allclose([s for _, s in got[q]], [s for s, _ in want])


def test_clustered_vectors_need_a_tenth_of_the_parts(spark):
    rng = np.random.default_rng(4)
    centres = 6 * rng.normal(size=(64, 16))
    rows = [(k, (centres[k % 64] + rng.normal(size=16)).astype("f4").tolist()) for k in range(6400)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VEC)
    want, got = _brute(rows), {}
    for r in A.nearest_neighbours(df, F.col("vec_id") % 100 == 0, probes=6).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {j for _, j in x}) / 10 for q, x in want.items()])
    assert recall >= 0.9, recall


def test_parts_are_balanced_and_follow_clusters():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(100, 8)) + 20 * rng.normal(size=8) for _ in range(8)])
    graph = A.neighbour_graph(x, 10)
    part = A.balanced_parts(graph, x, 8)
    assert np.bincount(part, minlength=8).max() <= 110
    assert (part[graph] == part[:, None]).mean() > 0.8
    router = A.Router(x, part, 8)
    assert (router.probable(x, 2) == part[:, None]).any(axis=1).mean() > 0.95
