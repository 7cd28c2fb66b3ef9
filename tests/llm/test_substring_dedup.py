import random

import numpy as np

from quotelab.llm import queries as Q
from quotelab.llm import substring_dedup as S
from tests.llm import brute

DOC = "doc_id long, text string, rid string, start int, packed int"


def _check(spark, docs, path):
    spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], DOC).write.parquet(f"{path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted([tuple(r) for r in Q.op7_substring_dedup(spark, str(path)).collect()], key=key)
    assert got == sorted(brute.substring(docs), key=key)
    return {r[0]: r for r in got}


def test_cover_meets_every_shift():
    for shift in range(S.PERIOD):
        assert any((a + shift) % S.PERIOD in S.COVER for a in S.COVER)
    assert list(S.cover_positions(20)) == [0, 1, 3, 8, 12, 18]
    assert list(S.candidate_starts(60, np.array([0]), 50)) == [0]
    assert list(S.candidate_starts(60, np.array([0, 10**6]), 50)) == [0]  # of a longer row with the same hash


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [fresh(n) for n in (20, 49, 50, 51, 60, 90, 200)]
    docs = [(k, "\n".join([fresh(rng.randrange(90)), rng.choice(passages), fresh(rng.randrange(90)), rng.choice(passages)])) for k in range(60)]
    docs += [(60, docs[3][1]), (61, docs[3][1]), (61, docs[3][1]), (61, passages[6]), (None, docs[3][1]), (62, None), (63, ""), (-5, passages[4])]
    docs += [(64, "a b " * 200), (65, "a b " * 25), (66, "b a " * 26), (67, fresh(200_000) + " " + passages[5] + " x")]
    got = _check(spark, docs, tmp_path)
    assert got[60][2] == got[60][1] and got[62][1] == 0 and got[67][2] == 90


def test_empty_table(spark, tmp_path):
    _check(spark, [], tmp_path)
