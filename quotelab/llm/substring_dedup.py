"""Removal of long passages that an earlier document holds, found by difference-cover anchors.

A difference cover of a period holds, for any two positions, a common shift that brings both onto it. So of any two
equal passages of ``window`` words some ``anchor`` words start at cover positions of both texts, and hashing only there
misses no match. Anchors that one document alone holds are dropped. The others extend: a window is a candidate if a
shared anchor stands inside it, and candidates are compared by 96-bit hashes of all their words. Only counts, minima
and joins go by hash: no group is gathered and no pairs are made. Texts travel compressed.

Null texts have no words. A row with a null id neither loses words nor takes any. Rows with one id do not take words
from each other; repeated rows get the same result. Texts shorter than a window are kept whole.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.llm.rolling import run_hashes, word_hashes
from quotelab.llm.texts import keyed_text, tokens
from quotelab.session import discard, materialise

#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


def cover_positions(n: int) -> np.ndarray:
    """The positions below ``n`` that fall on the cover, ascending."""
    if n <= 0:
        return np.empty(0, np.int64)
    p = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    return p[p < n]


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind)))


def _texts(b: pa.RecordBatch):
    """The texts of a batch, one in memory at a time."""
    return (t.as_py() for t in b.column("text"))


def _anchor_rows(window: int):
    size = window - PERIOD + 1

    def run(batches):
        for b in batches:
            n_words, whole, anchors = [], [], []
            for text in _texts(b):
                words = tokens(text)
                at = cover_positions(len(words) - size + 1 if len(words) >= window else 0)
                anchors.append(run_hashes(word_hashes(words), at, size) if len(at) else at)
                n_words.append(len(words))
                whole.append(xxhash.xxh3_128_digest(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rid"), pa.array(n_words, pa.int64()), pa.array(whole, pa.binary()), _lists(anchors)],
                names=["doc_id", "rid", "n_words", "whole", "anchors"],
            )
    return run


def _packed_rows(batches):
    for b in batches:
        pack = zstandard.ZstdCompressor(level=3).compress
        packed = pa.array([pack(t or b"") for t in _texts(b)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), packed], names=["doc_id", "rid", "packed"])


def _unpacked(column: pa.Array):
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(t.as_py()) for t in column)


def candidate_starts(n_words: int, shared: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor out of ``shared``, indices of cover positions; others, of a row with the same hash, are passed over."""
    inside = np.zeros(n_words - window + 2, np.int64)
    at = cover_positions(n_words - window + PERIOD)
    at = at[shared[shared < len(at)]]
    np.add.at(inside, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(inside, np.minimum(at, n_words - window) + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[:-1])


def _window_rows(window: int):
    def run(batches):
        for b in batches:
            starts, first, second = [], [], []
            for text, shared in zip(_unpacked(b.column("packed")), b.column("shared").to_pylist(), strict=True):
                words = tokens(text)
                at = candidate_starts(len(words), np.array(shared, np.int64), window)
                h = word_hashes(words)
                starts.append(at)
                first.append(run_hashes(h, at, window, 0))
                second.append((run_hashes(h, at, window, 1) >> 32).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rid"), b.column("packed"), _lists(starts, np.int32), _lists(first), _lists(second, np.int32)],
                names=["doc_id", "rid", "packed", "start", "w1", "w2"],
            )
    return run


def _kept_rows(window: int):
    def run(batches):
        for b in batches:
            removed, kept = [], []
            for text, starts in zip(_unpacked(b.column("packed")), b.column("starts").to_pylist(), strict=True):
                words = tokens(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.array(starts) + window, -1)
                stays = np.cumsum(edge)[:-1] == 0
                removed.append(int(len(words) - stays.sum()))
                kept.append(b" ".join(w for w, stay in zip(words, stays.tolist(), strict=True) if stay))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rid"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "rid", "n_removed", "kept"],
            )
    return run


def _digest_rows(batches):
    for b in batches:
        n_words, digests = [], []
        for text in _texts(b):
            words = tokens(text)
            n_words.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            del words  # before the next text's are made
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("rid"), pa.array(n_words, pa.int64()), pa.array(digests)], names=["doc_id", "rid", "n_words", "sha256"])


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``rid``, a hash of both: with the id it names a row, and equal rows alike."""
    return keyed_text(docs, id_col, text_col).withColumn("rid", F.xxhash64("doc_id", "text"))


def word_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, n_words and sha256 of the words joined by one space, of every row."""
    rows = identified(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digest_rows, f"doc_id {kind}, rid long, n_words long, sha256 string")


def repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, n_removed, kept text as binary) of the rows that lose words to a smaller id."""
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    rows = identified(docs, id_col, text_col).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    hashed = materialise(rows.mapInArrow(
        _anchor_rows(window), f"doc_id {kind}, rid long, n_words long, whole binary, anchors array<long>"), "anchors")
    # A copy of a smaller document's words loses them all, and gives no word that the smaller one does not.
    whole = hashed.filter(F.col("n_words") >= window).select("doc_id", "rid", "n_words", "whole")
    first = materialise(whole.groupBy("whole").agg(F.min("doc_id").alias("first")), "first")
    copies = materialise(whole.join(first, "whole").filter("doc_id > first").select("doc_id", "rid", "n_words").distinct(), "copies")

    often = hashed.select(F.explode(F.array_distinct("anchors")).alias("h")).groupBy("h").count().filter("count > 1").select("h")
    placed = hashed.select("rid", F.posexplode("anchors").alias("k", "h")).join(materialise(often, "often"), "h")
    shared = placed.groupBy("rid").agg(F.collect_set("k").alias("shared"))
    named = copies.groupBy("rid").agg(F.collect_set("doc_id").alias("copies"))
    shared = materialise(shared.join(named, "rid", "left"), "shared")
    discard(hashed)

    packed = rows.mapInArrow(_packed_rows, f"doc_id {kind}, rid long, packed binary")
    found = materialise(packed.join(shared, "rid").filter(
        "copies IS NULL OR NOT array_contains(copies, doc_id)").mapInArrow(
        _window_rows(window), f"doc_id {kind}, rid long, packed binary, start array<int>, w1 array<long>, w2 array<int>"), "windows")
    windows = found.select("doc_id", "rid", F.explode(F.arrays_zip("start", "w1", "w2")).alias("w")).select("doc_id", "rid", "w.*")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    later = windows.join(materialise(least.drop("most"), "least"), ["w1", "w2"]).filter("doc_id > least")
    starts = later.groupBy("doc_id", "rid").agg(F.collect_set("start").alias("starts"))
    cut = found.select("doc_id", "rid", "packed").dropDuplicates(["doc_id", "rid"]).join(starts, ["doc_id", "rid"])
    cut = cut.mapInArrow(_kept_rows(window), f"doc_id {kind}, rid long, n_removed long, kept binary")
    return cut.unionByName(copies.select("doc_id", "rid", F.col("n_words").alias("n_removed"), F.lit("").cast("binary").alias("kept")))
