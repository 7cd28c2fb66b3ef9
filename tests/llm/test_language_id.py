import itertools
import json
import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quotelab.llm import language_id as L
from quotelab.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, row string, score int, lang_pred string"


def _cuts(word):
    for marks in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, m in enumerate(marks) if m], len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_forward_sums_all_segmentations():
    rng = random.Random(1)
    pieces = {p: k for k, p in enumerate([b"a", b"b", b"ab", b"aba", b" ", b" a", b"bb"])}
    p = np.vstack([np.random.default_rng(1).random((len(pieces), 2)), np.zeros((1, 2))])
    model = L.Model(["x", "y"], np.zeros(2), pieces, p)
    words = [b" " + bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 8))) for _ in range(20)]
    for w, got in zip(words, L.log_scores(words, model), strict=True):
        want = sum(np.prod([p[pieces[x]] for x in cut], axis=0) for cut in _cuts(w) if all(x in pieces for x in cut))
        assert np.allclose(np.exp(got), want)


def _logs_of_sums(word, p, pieces):
    """log of the sum over all segmentations, in exact fractions."""
    a = [Fraction(1)]
    for end in range(1, len(word) + 1):
        a.append(sum((a[end - n] * Fraction(p[pieces[word[end - n:end]]]) for n in range(1, end + 1) if word[end - n:end] in pieces), Fraction(0)))
    return math.log(a[-1].numerator) - math.log(a[-1].denominator)


def test_long_words_are_summed_whole():
    rng = random.Random(2)
    pieces = {p: k for k, p in enumerate([b"a", b"b", b"ab", b" ", b" a", b"ab" * 30, b"b" * 9])}
    p = np.vstack([np.random.default_rng(2).random((len(pieces), 2)) * 1e-9, np.zeros((1, 2))])
    model = L.Model(["x", "y"], np.zeros(2), pieces, p)
    words = [b" " + bytes(rng.choice(b"ab") for _ in range(n)) for n in (3, 22, 23, 24, 25, 40, 41, 64, 129, 400)] + [b" " + b"ab" * 150, b" ab" + b"b" * 30]
    for w, got in zip(words, L.log_scores(words, model), strict=True):
        assert got == pytest.approx([_logs_of_sums(w, p[:, k], pieces) for k in (0, 1)], rel=1e-9)


def test_long_and_short_words_share_alike(monkeypatch):
    pieces = {p: k for k, p in enumerate([b"a", b"b", b"ab", b" ", b" a", b"bab"])}
    model = L.Model(["x", "y"], np.zeros(2), pieces, np.vstack([np.random.default_rng(3).random((len(pieces), 2)), np.zeros((1, 2))]))
    words = pa.RecordBatch.from_pydict({"lang": ["x", "y", "y"], "word": [b" abab", b" babba", b" a"], "n": [3, 1, 7]})
    short = next(L._expect(model)([words])).to_pylist()
    monkeypatch.setattr(L, "SHORT", 0)
    for one, other in zip(short, next(L._expect(model)([words])).to_pylist(), strict=True):
        assert one == pytest.approx(other)


def test_table_finds_exactly_the_pieces():
    found = L.vocabulary_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {p: k for k, p in enumerate(found)}
    assert max(map(len, found)) > 60 and all(bytes([c]) in pieces for c in range(256))
    table, rng = L.Pieces(pieces), random.Random(4)
    for n in (1, 5, 12, 40, 140):
        words = [(b" " + rng.choice(found) + bytes(rng.randrange(256) for _ in range(n)))[:n] for _ in range(50)]
        spans = np.array([(a, b) for a in range(n) for b in range(a + 1, n + 1)])
        got = table.ids(table.sums(words), spans[:, 0], spans[:, 1])
        assert got.tolist() == [[pieces.get(w[a:b], len(pieces)) for a, b in spans] for w in words]


def _brute_fit(docs, pieces, rounds, smoothing):
    """Expectation maximisation by listing the segmentations of every word."""
    langs = sorted({la for _, la in docs})
    p = {la: dict.fromkeys(pieces, 1 / len(pieces)) for la in langs}
    for _ in range(rounds):
        counts = {la: dict.fromkeys(pieces, smoothing) for la in langs}
        for text, la in docs:
            for w in L.words(text.encode()):
                cuts = [c for c in _cuts(w) if all(x in pieces for x in c)]
                each = [math.prod(p[la][x] for x in c) for c in cuts]
                for c, share in zip(cuts, each, strict=True):
                    for x in c:
                        counts[la][x] += share / sum(each)
        p = {la: {x: n / sum(c.values()) for x, n in c.items()} for la, c in counts.items()}
    return langs, p


def test_fit_and_prediction_equal_brute_force(spark, tmp_path):
    """A vocabulary of single bytes and some pieces: the brute force only needs those that occur."""
    rng = random.Random(6)
    made = [("".join(rng.choice(a) for _ in range(rng.randrange(1, 9))), la) for la, a in (("x", "aab "), ("y", "abbc "), ("x", "ab c")) for _ in range(12)]
    vocabulary = tmp_path / "v.json"
    vocabulary.write_text(json.dumps({"model": {"vocab": {w: k for k, w in enumerate(["ab", "\u0120a", "bb", "abc", "\u0120ab"])}}}))
    docs = spark.createDataFrame([(k, t, la) for k, (t, la) in enumerate(made)], "doc_id long, text string, lang string")
    model = L.train(docs, str(vocabulary), rows=10**6)
    langs, p = _brute_fit(made, L.vocabulary_pieces(str(vocabulary)), L.ROUNDS, 0.01)
    got = {r.doc_id: r for r in L.identify(L.keyed_text(docs), model).collect()}
    for k, (text, _) in enumerate(made):
        joint = np.array([math.log(sum(la == x for _, la in made) / len(made)) + sum(math.log(sum(
            math.prod(p[x][c] for c in cut) for cut in _cuts(w) if all(c in p[x] for c in cut))) for w in L.words(text.encode())) for x in langs])
        if not L.has_letter(text.encode()):
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
        else:
            assert got[k].lang_pred == langs[joint.argmax()] and got[k].score == pytest.approx(1 / np.exp(joint - joint.max()).sum())


def test_words_keep_the_whole_text():
    assert L.words("Der Öl-Preis 3x".encode()) == [b" der", " Öl".encode(), b" preis", b" x"]
    assert L.words(b"q" * 1000) == [b" " + b"q" * 1000]
    assert not L.has_letter(b"12 ! %") and not L.has_letter(None) and L.has_letter("漢".encode()) and not L.has_letter("€".encode())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 20 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_edge_cases(spark):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, t, la, "r", 1, "z") for k, (t, la) in enumerate([("the thing of the", "en"), ("der und die das", "de")] * 10)]
    rows += [(90, None, "en", "r", 1, "z"), (91, "", "de", "r", 1, "z"), (92, "12 34", None, "r", 1, "z"), (None, "the and", None, None, 1, "z"), (93, "the " * 50_000, "en", "r", 1, "z"), (93, "the " * 50_000, "en", "r", 1, "z"), (94, "thing" * 4000, "en", "r", 1, "z")]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in L.predictions(docs, vocabulary).collect()}
    assert got[90].lang_pred == got[91].lang_pred == got[92].lang_pred == "und" and got[93].lang_pred == "en" and got[None].lang_pred == "en"
    model = L.train(docs, vocabulary)
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(20), 93, 94, None}
    none = L.train(docs.limit(0), vocabulary)
    assert none.languages == [] and {r.lang_pred for r in L.identify(L.keyed_text(docs), none).collect()} == {"und"}
    assert L.predictions(docs.limit(0), vocabulary).count() == 0
    assert model.p.sum(axis=0) == pytest.approx(1)


def test_full_scorer_keeps_the_words_in_use(monkeypatch):
    """A worker that has no room for more words scores none of those again that the texts at hand share with earlier ones."""
    import numpy as np

    from quotelab.llm import language_id as LI

    pieces = {bytes([c]): c for c in range(256)}
    model = LI.Model(["x", "y"], np.log([0.5, 0.5]), pieces, np.vstack([np.random.default_rng(1).random((256, 2)) / 256, np.zeros((1, 2))]))
    asked = []
    real = LI.log_scores
    monkeypatch.setattr(LI, "log_scores", lambda items, m: asked.extend(items) or real(items, m))
    texts = [b"red green blue", b"red green grey\n\nred", None, b" 12 "]
    want = LI.Scorer(model)(texts)
    asked.clear()
    monkeypatch.setattr(LI, "HELD_WORDS", 3)
    small = LI.Scorer(model)
    got = [small([t]) for t in texts]
    assert [g[0][0] for g in got] == want[0] and np.allclose([g[1][0] for g in got], want[1])
    assert sorted(asked) == [b" blue", b" green", b" grey", b" red"]
