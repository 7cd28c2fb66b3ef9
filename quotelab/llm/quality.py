"""Quality scores learned from trusted positives and unlabelled text alone (non-negative positive-unlabelled risk).

A small network over statistics of a text is fitted to positives, unlabelled texts and the share of positives among the
latter. Its risk is prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]); where the difference falls below
zero, the step goes the other way, which keeps the network from fitting the unlabelled texts one by one. With the logistic
loss its output is the log odds of being a positive.

The share of positives is estimated from positives and unlabelled texts too: negative labels are never read. A first network
tells the two samples apart; among the texts it likes best nearly all unlabelled ones are positives, so there the tail of the
unlabelled over that of the positives is the share.

Null texts and texts without words score 0. Without positives every other text scores the prior. Rows of labels that
disagree on a document, or hold nulls, teach nothing (a negative label only takes back a positive one); repeated rows of documents are scored one by one.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.llm.language_id import held_out
from quotelab.llm.texts import keyed_text

#: Trusted positives and unlabelled texts that the fit takes, as an expectation; never more than twice as many.
POSITIVES, UNLABELLED = 6000, 18_000

_MARKS = b"#$%&*@|!?.,;:\"'()-"
_SENTENCE_END = re.compile(rb"[.!?](?:\s|$)")


def features(text: bytes | None) -> np.ndarray | None:
    """Statistics of a whole text: lengths, shares of characters, repetition. None without words."""
    words = text.split() if text else []
    if not words:
        return None
    n, chars = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    upper, lower, digits = chars[65:91].sum(), chars[97:123].sum(), chars[48:58].sum()
    often = Counter(words)
    top = [c for _, c in often.most_common(3)]
    lines = text.split(b"\n")
    some = chars[chars > 0]
    return np.array([
        np.log1p(len(text)), np.log1p(n), np.log1p(len(lines)), len(text) / n, upper, lower, digits, upper / (upper + lower + 1e-9),
        chars[128:].sum(), chars[10], *chars[list(_MARKS)], top[0] / n, sum(top) / n, len(often) / n ** 0.8,
        len(set(zip(words, words[1:], strict=False))) / n, len(set(lines)) / len(lines), -(some * np.log(some)).sum(),
        sum(w.isupper() for w in words) / n, sum(w[:1].isupper() for w in words) / n, sum(not w[:1].isalpha() and w[0] < 128 for w in words) / n,
        sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / n, len(_SENTENCE_END.findall(text)) / n,
        float(np.mean([len(w) for w in often])), max(map(len, words)) / 100,
    ])


_WIDTH = len(features(b"a"))


def positive_unlabelled_gradient(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk and the direction of descent in the outputs of positives and unlabelled texts."""
    soft, sig = (lambda z: np.logaddexp(0, z)), (lambda z: 1 / (1 + np.exp(-z)))
    p, u = max(1, len(z_pos)), max(1, len(z_unl))
    positive = prior * soft(-z_pos).sum() / p
    negative = soft(z_unl).sum() / u - prior * soft(z_pos).sum() / p
    d_unl, d_pos = sig(z_unl) / u, -prior * sig(z_pos) / p
    if negative < 0:
        return positive, -d_pos, -d_unl
    return positive + negative, d_pos - prior * sig(-z_pos) / p, d_unl


def two_sample_gradient(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The logistic loss of telling positives from unlabelled texts, both of weight one, and its gradient."""
    p, u = max(1, len(z_pos)), max(1, len(z_unl))
    loss = np.logaddexp(0, -z_pos).sum() / p + np.logaddexp(0, z_unl).sum() / u
    return loss, -1 / (1 + np.exp(z_pos)) / p, 1 / (1 + np.exp(-z_unl)) / u


def tail_share(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among ``unlabelled`` scores: the least ratio of upper tails.

    Of all cuts that one counts at which the ratio is surely small: its value plus the error its two tails may have, at
    confidence ``delta``, is least. Far up the tails are pure but hold few texts.
    """
    cuts = np.unique(positive)
    above = lambda z: 1 - np.searchsorted(np.sort(z), cuts) / len(z)
    p, u = above(positive), above(unlabelled)
    error = (np.log(4 / delta) / (2 * len(unlabelled))) ** 0.5 + (np.log(4 / delta) / (2 * len(positive))) ** 0.5
    k = int(((u + error) / p).argmin())
    return float(min(max(u[k] / p[k], 0.01), 0.99))


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among ``unlabelled``: halves fit the first network, the other halves are its held-back tails."""
    if min(len(positives), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(5)
    x, y = positives[rng.permutation(len(positives))], unlabelled[rng.permutation(len(unlabelled))]
    half, mid = len(x) // 2, len(y) // 2
    first = Network(x[:half], y[:mid], 0.5, epochs=20, gradient=two_sample_gradient)
    return tail_share(first.outputs(x[half:]), first.outputs(y[mid:]))


class Network:
    """One hidden layer over clipped standard scores of the features."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32, epochs: int = 60, seed: int = 3,
                 gradient=positive_unlabelled_gradient):
        self.prior, self.fitted = prior, len(positives) > 0 and len(unlabelled) > 0
        if not self.fitted:
            return
        low, mid, high = np.quantile(unlabelled, [0.1, 0.5, 0.9], axis=0)
        spread = np.where(high > low, high - low, np.maximum(unlabelled.std(axis=0), 1e-6))
        self.mid, self.spread = mid, spread
        x, y, rng = self._scaled(positives), self._scaled(unlabelled), np.random.default_rng(seed)
        width = x.shape[1]
        self.w = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        steps = max(8, len(y) // 512)
        for epoch in range(epochs):
            deal_x, deal_y = np.array_split(rng.permutation(len(x)), steps), np.array_split(rng.permutation(len(y)), steps)
            for a, b in zip(deal_x, deal_y, strict=True):
                both = np.vstack([x[a], y[b]])
                h, z = self._forward(both)
                _, d_pos, d_unl = gradient(z[:len(a)], z[len(a):], prior)
                d = np.concatenate([d_pos, d_unl])
                dh = np.outer(d, self.w[2]) * (h > 0)
                t += 1
                for k, g in enumerate((both.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
                    g = g + 1e-4 * self.w[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= 0.005 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mid) / self.spread, -5, 5)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        return h, h @ self.w[2] + self.w[3]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x))[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.outputs(x), -50, 50)))


def _feature_rows(batches):
    for b in batches:
        found = [f for t in b.column("text").to_pylist() if (f := features(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], names=["x"])


def _sample_features(rows: DataFrame, most: int) -> np.ndarray:
    got = rows.select("text").mapInArrow(_feature_rows, "x array<double>").limit(most).toArrow()
    return np.array(got["x"].to_pylist(), float).reshape(-1, _WIDTH)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Network:
    """Fit on samples of the documents and of the rows of ``labels`` with label 1. Prior and network come from these alone."""
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most")
    ones = marks.filter("y = 1").count()
    within = lambda h, most, of: F.pmod(h, F.lit(1 << 30)) < int(min(1.0, most / max(of, 1)) * (1 << 30))
    trusted = marks.filter("y = 1").filter(within(F.xxhash64("doc_id", F.lit(5)), positives, ones)).select("doc_id").limit(2 * positives)
    rows = keyed_text(docs, id_col, text_col).filter("text IS NOT NULL")
    total = rows.count()
    x = _sample_features(rows.join(F.broadcast(trusted), "doc_id"), 2 * positives)  # at most 2 * positives ids
    u = _sample_features(rows.filter(within(F.xxhash64("doc_id", "text"), unlabelled, total)), 2 * unlabelled)
    return Network(x, u, estimate_prior(x, u))


def score(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            at = [k for k, f in enumerate(found) if f is not None]
            out = np.zeros(len(found))
            if at:
                out[at] = held.value.scores(np.array([found[k] for k in at]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    rows = keyed_text(docs, id_col, text_col)
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the rows that are not held out."""
    out = lambda d: F.coalesce(held_out(d["doc_id"]), F.lit(False))
    model = train(docs.filter(~out(docs)), labels.filter(~out(labels)))
    found = score(docs, model)
    return found.select("doc_id", out(found).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
