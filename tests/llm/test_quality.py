import numpy as np
import pytest

from quotelab.llm import quality as L
from quotelab.llm import queries as Q

SF = "/root/testdata/sf0.01"


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = Q.op6_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in out]), np.array([r.score for r in out])
    assert len(out) > 60 and _auc(s, y) > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.93
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=5), rng.normal(size=7)
    risk, d_pos, d_unl = L.positive_unlabelled_gradient(a, b, 0.4)
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        assert abs((L.positive_unlabelled_gradient(a + e, b, 0.4)[0] - risk) / 1e-6 - d_pos[k]) < 1e-4
    for k in range(7):
        e = np.eye(7)[k] * 1e-6
        assert abs((L.positive_unlabelled_gradient(a, b + e, 0.4)[0] - risk) / 1e-6 - d_unl[k]) < 1e-4
    low, d_pos, d_unl = L.positive_unlabelled_gradient(a + 9, b - 9, 0.9)  # overfitted: the negative part is below zero
    assert low >= 0 and (d_pos > 0).all() and (d_unl < 0).all()


def test_positives_part_from_unlabelled_noise():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (3000, L._WIDTH)), rng.normal(2, 1, (1000, L._WIDTH))
    net = L.Network(good[:1000], np.vstack([good[1000:], bad]), 2 / 3)
    assert _auc(np.r_[net.scores(good), net.scores(bad)], np.r_[np.ones(3000), np.zeros(1000)]) > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (None, "some words here.", "e"), (3, "A good text. " * 30_000, "e"), (3, "A good text.", "e"), (4, "\n\n", "e")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, "z"), (3, 0, "z"), (None, 1, "z"), (2, None, "z")], "doc_id long, quality int, text string")
    got = L.predictions(docs, labels).collect()
    assert len(got) == 6 and {r.score for r in got if r.doc_id in (1, 2, 4)} == {0.0} and {r.score for r in got if r.doc_id == 3} == {0.5}
    assert L.predictions(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.15, 0.4, 0.7])
def test_prior_of_mixtures_of_known_share(share):
    rng = np.random.default_rng(9)
    draw = lambda n, at: rng.normal(at, 1, (n, 4))
    n = 8000
    ones = int(n * share)
    unlabelled = np.vstack([draw(ones, 1.5), draw(n - ones, -1.5)])
    assert L.estimate_prior(draw(4000, 1.5), unlabelled) == pytest.approx(share, abs=0.05)


def test_prior_of_tiny_samples():
    assert L.estimate_prior(np.ones((2, 3)), np.ones((9, 3))) == 0.5
    assert 0.01 <= L.estimate_prior(np.ones((50, 3)), np.ones((90, 3))) <= 0.99
