import hashlib
import random

import numpy as np

from quotelab.llm import fill_middle as M
from quotelab.llm import queries as Q

DOC = "doc_id long, text string, n long, form string, output string"


def _brute(d, text):
    text, digest = text or "", hashlib.sha256(f"1:{'null' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def _odd_rows():
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab <>PSM/é漢😀\ń") for _ in range(rng.choice([1, 2, 5, 40, 700])))) for k in range(400)]
    rows += [(k, "x<S" * 3 + ">" * (k % 2) + "<P" + "M>") for k in range(400, 440)]
    return rows + [(900, None), (901, ""), (902, "a"), (903, "<P>"), (None, "no id"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (904, "word 漢 " * 200_000)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = _odd_rows()
    spark.createDataFrame([(d, t, 1, "f", "o") for d, t in rows], DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, *(b := _brute(d, t))[:4], sha(b[4]), sha(t or "")) for d, t in rows]
    got = [tuple(r) for r in Q.op11_fill_middle(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], r[5])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(spark):
    rows = _odd_rows()
    got = M.fill_in_middle(spark.createDataFrame([(1, d, t) for d, t in rows], "n int, form long, output string"), id_col="form", text_col="output").collect()
    assert sorted(M.restore(r.form, r.output) for r in got) == sorted(t or "" for _, t in rows)


def test_skip_list_sums_widths():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 31, 33, 600, 50_000):
        widths = rng.integers(0, 9, n).astype(np.uint8)
        skips = M.SkipList(widths, seed=n)
        before = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        assert all(skips.code_points(int(r)) == before[r] for r in {0, 1, n // 3, n - 1, n, *rng.integers(0, n + 1, 200)} if 0 <= r <= n)
        assert len(skips.lanes) == 1 or len(skips.lanes[-1][2]) <= 2 * M.FAN
        assert all(up[1].sum() == n and up[2].sum() == before[-1] for up in skips.lanes[1:])


def test_other_units_are_never_cut():
    text = "one two\nthree  four 漢字 five. " * 30 + "tail"
    for unit in (r"\s*\S+", r"[^\n]*\n"):
        ends = {0, len(text)} | {m.end() for m in M.regex.finditer(unit, text)}
        seen = set()
        for d in range(200):
            n, form, prefix, middle, output = M.transform(d, text, unit)
            assert M.restore(form, output) == text
            if form != "plain":
                seen.add(len(prefix))
                assert {len(prefix), len(prefix + middle)} <= ends
        assert len(seen) > 20


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op11_fill_middle(spark, str(tmp_path)).count() == 0
