import random

from quotelab.llm import decontaminate as D
from quotelab.llm import license_scan as L
from quotelab.llm import queries as Q
from quotelab.llm.suffix_automaton import SuffixAutomaton, WindowIndex
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, found int"
ITEM = "item_id long, text string"


def _random(rng, n, words="a b c d e f g"):
    return " ".join(rng.choice(words.split()) for _ in range(n))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        items = [(k, [w.encode() for w in _random(rng, rng.randint(1, 30), "a b c").split()]) for k in range(4)]
        text = [w.encode() for w in _random(rng, 80, "a b c d").split()]
        sam = SuffixAutomaton(items)
        got = {i: n for i, _, n in sam.read(text)}
        grams = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        for i in range(len(text)):
            n = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in grams), default=0)
            assert got.get(i, 0) == n


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, _random(rng, rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(30)] + [(5, "Ünïcode a B"), (None, "x y z"), (77, None)]
    docs = [(k, _random(rng, rng.choice([0, 2, 50, 300]))) for k in range(40)]
    docs += [(100, None), (None, "q X, y-Z q"), (7, docs[7][1]), (101, "ünïcode A b!" + " zz" * 20000)]
    d = spark.createDataFrame([(a, b, None, None, None, "r", 1) for a, b in docs], DOC)
    i = spark.createDataFrame(items, ITEM)
    key = lambda r: (r[0] is None, r[0], r[1:])
    want = sorted(brute.contamination(docs, items), key=key)
    for limit in (D.SHARD_WORDS, 60):  # one shard, many shards
        monkeypatch.setattr(D, "SHARD_WORDS", limit)
        found = D.contamination(d, i)
        found.createOrReplaceTempView("found")
        got = spark.sql(
            "SELECT doc_id, n_words, aggregate(spans, 0L, (n, s) -> n + s.end - s.start) n, size(items),"
            " sha2(array_join(items, ','), 256) FROM found").collect()
        assert sorted([(*r, r[2] > 0) for r in got], key=key) == want


def test_decontaminate_leaves_no_window(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, _random(rng, 14, "a b c d e f g h i j k l")) for k in range(6)]
    clean = " ".join(f"w{k}" for k in range(60))
    docs = [(0, clean), (1, f"{clean} {items[0][1]} {clean}"), (2, items[1][1]), (3, None), (4, "")]
    docs += [(5, f"{clean} {items[2][1][:8]} {items[3][1]} {items[2][1][8:]} {clean}")]
    d = spark.createDataFrame([(a, b, "en", "s", 1, "r", 1) for a, b in docs], DOC)
    i = spark.createDataFrame(items, ITEM)
    for limit in (D.SHARD_WORDS, 20):
        monkeypatch.setattr(D, "SHARD_WORDS", limit)
        got = {r.doc_id: r for r in D.decontaminate(d, i).collect()}
        assert set(got) == {0, 1, 3, 4, 5} and got[0].text == clean and got[3].text is None and got[1].row == "r"
        left = [(k, r.text) for k, r in got.items()]
        assert not any(r[-1] for r in brute.contamination(left, items))
        assert got[1].text.split() == (clean + " " + clean).split()
    empty = D.decontaminate(d, i.limit(0))
    assert empty.count() == len(docs) and D.decontaminate(d.limit(0), i).count() == 0


def test_window_index_names_every_item():
    index = WindowIndex([("x", list("abcdefghijkl")), ("y", list("zbcdefghijkl")), ("s", list("ef"))], 10)
    spans, names, longest = index.scan(list("--bcdefghijkl--"))
    assert spans == [[2, 13]] and names == {"x", "y", "s"} and longest == 11


def test_license_base_equals_brute_force(spark, tmp_path):
    docs = [(1, "Released under the MIT License. Apache license, mit-license"), (2, None), (3, ""), (None, "GNU General Public License"),
            (4, "the GNU Lesser General Public License mit"), (5, L.TEMPLATES["apache-2.0"].upper()), (5, "mit\nLICENSE"),
            (6, "w " * 50000 + L.TEMPLATES["bsd-text"])]
    spark.createDataFrame([(a, b, None, None, None, "r", 1) for a, b in docs], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op8_license_scan(spark, str(tmp_path)).collect()
    assert sorted([tuple(r)[:6] for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted(
        brute.licenses(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    by = {r.doc_id: r for r in got}
    assert "bsd-text" in by[6].labels and by[6].score == 1.0 and by[2].score == 0.0 and by[2].labels == ""


def test_license_chain_bridges_an_edit():
    text = L.TEMPLATES["mit-text"].replace("without restriction", "without any restriction").replace("publish, ", "")
    _, _, chains = L.LicenseIndex(L.BASE, L.TEMPLATES, 5).scan(text.encode())
    best = {c["template"]: c["coverage"] for c in chains}
    assert best["mit-text"] > 0.9 and best.get("isc-text", 0) < 0.8
