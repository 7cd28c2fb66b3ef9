import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quotelab.llm import packing as P
from quotelab.llm import queries as Q

DOC = "doc_id long, text string, uid long, fill string, dealt int"


def _pieces_of(text, encode):
    ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
    at = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta,", "3.14", "naïve", "e\nf", "<|endoftext|>", "漢字", "it's", "  "]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 40, 300, 1500]))) for k in range(300)]
    docs += [(900, None), (901, ""), (None, "x"), (3, docs[3][1]), (902, "word " * 2047), (903, "word " * 2048), (904, "a" * 50_000), (905, text(9000))]
    spark.createDataFrame([(a, b, 1, "f", 2) for a, b in docs], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op2_packing(spark, str(tmp_path)).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted([(d, *p) for d, t in docs for p in _pieces_of(t, encode)], key=key)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == want
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
    assert len(bins) <= len(P.best_fit([r.length for r in got], 2048))


def test_groups_meet_in_a_second_round(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    rng = random.Random(2)
    rows = [(k, 0, 0, rng.choice([2048, *range(100, 900)]), 0) for k in range(1000)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(got) == 1000 and max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 4


def test_local_search_empties_a_bin():
    size = [60, 30, 45, 70, 40, 25, 30]
    start = [[0, 1], [2, 5], [3], [4], [6]]
    search = P.LocalSearch(size, start, 100)
    before = (search.fill**2).sum()
    bins = search.run()
    assert (search.fill**2).sum() > before and len(bins) < 5 and sorted(i for b in bins for i in b) == list(range(7))
    rng = random.Random(3)
    for _ in range(50):
        size = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        bins = P.LocalSearch(size, [[i] for i in range(len(size))], 100).run()
        assert sorted(i for b in bins for i in b) == list(range(len(size)))
        assert all(sum(size[i] for i in b) <= 100 for b in bins) and len(bins) <= 1.15 * len(P.best_fit(size, 100)) + 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op2_packing(spark, str(tmp_path)).count() == 0
