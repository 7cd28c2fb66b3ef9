import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from quotelab.llm import queries as Q
from quotelab.llm import token_alignment as T

DOC = "doc_id long, text string, a int, key string, links long"


def _tokens():
    """Text -> (id, start, end) of the tokens of both, None where a tokenizer does not give the bytes back."""
    fast = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    fast.encode_special_tokens = True
    spell = {int(k): base64.b64decode(t) for t, k in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def piece(k):
        p = pieces.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode()

    def spans(ids, bytes_of, whole):
        out, at = [], 0
        for k in ids:
            out.append((k, at, at := at + len(bytes_of(k))))
        return out if b"".join(bytes_of(k) for k in ids) == whole else None

    def both(text):
        whole = (" " + (text or "")).encode()
        if not text:
            return [], []
        a, b = spans(fast.encode(" " + text, add_special_tokens=False).ids, spell.get, whole), spans(pieces.encode(text), piece, whole)
        return ([], []) if a is None or b is None else (a, b)
    return both


def _brute(docs):
    both, seen, counts = _tokens(), [], Counter()
    for d, text in docs:
        a, b = both(text)
        links = Counter((x, y) for x, s, e in a for y, p, q in b if s < q and p < e)
        counts += links
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(k) for k, s, e in t if low <= s and e <= high) for t in (a, b)))
            low = high
        seen.append((d, len(a), len(b), groups, links))
    most = {}
    for (_, y), c in counts.items():
        most[y] = max(most.get(y, 0), c)
    return [(d, a, b, len(g), links.total(), sum(m for k, m in links.items() if counts[k] == most[k[1]]), sum(m * counts[k] for k, m in links.items()),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, links in seen]


def _docs():
    rng = random.Random(4)
    words = ["alpha", "Beta,", "3.14", "naïve", "naïve", "e\nf", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "漢字", "it's", " ", "   ", "\t", "ß😀", "unbelievably", " ", "...", "zwölf"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 8, 60])))) for k in range(150)]
    docs += [(900, None), (901, ""), (902, " "), (903, "▁ x"), (904, "a▁b"), (None, "alpha Beta,"), (None, None), (3, docs[3][1]), (3, docs[3][1]), (905, "a" * 900), (906, "\x00\x7f")]
    return docs


def _key(r):
    return r[0] is None, r[0] or 0, r[1:]


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    docs = _docs()
    spark.createDataFrame([(d, t, 1, "k", 2) for d, t in docs], DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(_brute(docs), key=_key)
    for held in (T.HELD_PAIRS, 0):  # counts in memory, counts joined
        monkeypatch.setattr(T, "HELD_PAIRS", held)
        got = Q.op13_token_alignment(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=_key) == want
    without = [r for r in want if not r[1]]
    assert len(without) == 5 and all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in without) and any(r[5] < r[4] for r in want)


def test_slices_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(_docs(), "doc_id long, text string").coalesce(1)
    files = (*Q.tokenizer_files(), P.path("piece_bpe_32k.model"))
    one = sorted(map(tuple, T.alignment(docs, *files).collect()), key=_key)
    seen = [first for first, _ in T._slices(T.pa.array(["ab", None, "", "c" * T.SLICE, "d"]))]
    assert seen == [0, 4]
    rows = [T.pa.RecordBatch.from_arrays([T.pa.array([{"doc_id": d, "rid": k} for k, (d, _) in enumerate(_docs())]), T.pa.array([t for _, t in _docs()])], names=["key", "text"])]
    monkeypatch.setattr(T, "SLICE", 1)
    many = [r for b in T._aligned(files)(iter(rows)) for r in b.to_pylist()]
    assert sorted([(r["key"]["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in many], key=_key) == sorted([r[:5] for r in one], key=_key)


def test_long_text(spark):
    text = "The quick brown fox, number 17, jumps. " * 20_000
    row = T.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string"), *Q.tokenizer_files(), P.path("piece_bpe_32k.model")).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_groups > 100_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op13_token_alignment(spark, str(tmp_path)).count() == 0
