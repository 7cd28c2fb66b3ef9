import random

import numpy as np

from quotelab.llm import queries as Q
from quotelab.llm import simhash as S
from quotelab.llm.components import connected_components
from tests.llm import brute

DOC = "doc_id long, text string, fp long, least long"


def test_shards_are_asked_across_close_boundaries():
    for levels in (4, 7):
        own, value, leaf = S.shard_values(levels)
        asked = {*zip(value.tolist(), leaf.tolist(), strict=True), *enumerate(own.tolist())}
        rng = random.Random(levels)
        for v in rng.sample(range(1 << 16), 300):
            assert all((v, own[v ^ (1 << b)]) in asked for b in range(16))
        assert 2**levels <= own.min() and own.max() < 2 ** (levels + 1)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**63, 300).astype(np.uint64)
    for _ in range(3):
        points = np.concatenate([points, points ^ (np.uint64(1) << rng.integers(0, 64, len(points)).astype(np.uint64))])
    queries = points[::3]

    class Pairs(set):
        def add(self, a, b):
            self.update(zip(a.tolist(), b.tolist(), strict=True))

    found = Pairs()
    for quarter in range(4):
        S.tree_links(points, queries, quarter, found)
    near = np.argwhere(np.bitwise_count(queries[:, None] ^ points[None]) <= 4)
    assert found == {(int(i), len(queries) + int(j)) for i, j in near}


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(6000, 6300)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs = []
    for _ in range(40):
        w = words(rng.choice([1, 3, 4, 5, 80, 200]))
        for _ in range(rng.choice([1, 1, 3, 12])):
            v = list(w)
            if len(v) > 20 and rng.random() < 0.7:
                v[rng.randrange(len(v))] = "edit"
            docs.append((len(docs), " ".join(v)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, docs[0][1]), (None, "quite alone here"), (3, docs[3][1]), (1003, "É a  B\tc\vd\x1ce f"), (1004, "x y " * 30000)]
    spark.createDataFrame([(a, b, 1, 2) for a, b in docs], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([tuple(r) for r in Q.op3_simhash(spark, str(tmp_path)).collect()], key=key)
    assert got == sorted(brute.groups([(d, brute.fingerprint(t)) for d, t in docs]), key=key)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op3_simhash(spark, str(tmp_path)).count() == 0
