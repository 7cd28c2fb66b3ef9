"""Packing of token sequences into as few bins as possible by a swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Pieces that fill a bin stand alone. The others are dealt into
groups of ``GROUP`` pieces, whatever the input's size; in each group a best-fit start is improved by moving documents
and exchanging one for one, two for one or one for two between underfull bins. Every step takes tokens out of a bin and
into a fuller one, so the sum of squared fills grows, and ends when bins have run empty or no step is left. Bins
that are still underfull meet those of other groups in a second round. Only piece lengths travel, never texts.

A null text is an empty one; every document ends with id 0, so each has a piece. Repeated rows are packed one by one.
"""
from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.llm.worker import kept
from quotelab.session import materialise

CAPACITY = 2048
#: Pieces that one task packs together.
GROUP = 2048
#: Bins below this share of the capacity enter the second round.
UNDERFULL = 0.95

_SPECIAL = "<|endoftext|>"
#: Beyond these characters, libraries may differ in what they count as a letter.
_OTHER = re.compile("[^\\x00-\\x7e¡-ɏ]")

def _encoder(vocabulary: str, ranks: str | None):
    """text -> ids as the tokenizer file ``vocabulary`` gives them; ``ranks`` holds the same vocabulary for a faster reader."""
    def read():
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        return slow, fast

    slow, fast = kept(("encoder", vocabulary, ranks), read)

    def encode(text: str) -> list[int]:
        if fast is None or _SPECIAL in text or _OTHER.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _pieces(vocabulary: str, ranks: str | None, capacity: int):
    def run(batches):
        encode = _encoder(vocabulary, ranks)
        for b in batches:
            who, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), 0], "<u4")
                first = len(ids) % capacity or capacity
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at:at + (capacity if k else first)]
                    who.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(who, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: the longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(gaps, (lengths[i], -1))
        if at < len(gaps):
            gap, k = gaps.pop(at)
        else:
            gap, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], k))
    return bins


class LocalSearch:
    """Bins of pieces, improved by steps that shift tokens from one bin to a fuller one."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.size, self.bins, self.capacity = lengths, [list(b) for b in bins], capacity
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)

    def run(self) -> list[list[int]]:
        fewest = -(-int(self.fill.sum()) // self.capacity)
        stuck: set[int] = set()
        while np.count_nonzero(self.fill) - fewest > 0:
            open_ = [k for k in np.argsort(self.fill, kind="stable").tolist() if self.fill[k] and k not in stuck]
            if len(open_) < 2:
                break
            if self._step(open_[0]):
                continue
            stuck.add(open_[0])
            if self.fill[open_[0]] > (self.capacity * len(self.bins) - self.fill.sum()):
                break  # all gaps together are smaller than what the emptiest bin still holds
        return [b for b in self.bins if b]

    def _step(self, giver: int) -> bool:
        """The step out of ``giver`` that leaves the smallest gap in a bin at least as full; False if there is none."""
        gap = self.capacity - self.fill
        takers = np.flatnonzero((gap > 0) & (self.fill >= self.fill[giver]) & (np.arange(len(gap)) != giver))
        single = [(k, (i,)) for k in takers.tolist() for i in self.bins[k]]
        double = [(k, (i, j)) for k in takers.tolist() for n, i in enumerate(self.bins[k]) for j in self.bins[k][:n]]
        back = [(k, ()) for k in takers.tolist()] + single
        out_one = [(i,) for i in self.bins[giver]]
        out_two = [(i, j) for n, i in enumerate(self.bins[giver]) for j in self.bins[giver][:n]]
        best = None
        for outs, backs in ((out_one, back + double), (out_two, single)):
            if not outs or not backs:
                continue
            bin_of = np.array([k for k, _ in backs])
            weight = np.array([sum(self.size[i] for i in x) for _, x in backs])
            for out in outs:
                gain = sum(self.size[i] for i in out) - weight
                left = np.where((gain > 0) & (gain <= gap[bin_of]), gap[bin_of] - gain, self.capacity)
                at = int(left.argmin())
                if left[at] < self.capacity and (best is None or left[at] < best[0]):
                    best = (int(left[at]), out, *backs[at])
        if best is None:
            return False
        _, out, taker, back_ = best
        self.bins[giver] = [i for i in self.bins[giver] if i not in out] + list(back_)
        self.bins[taker] = [i for i in self.bins[taker] if i not in back_] + list(out)
        for k in (giver, taker):
            self.fill[k] = sum(self.size[i] for i in self.bins[k])
        return True


def _packer(capacity: int, round_: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        lengths = rows["length"].tolist()
        bins = LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()
        sequence, offset, fill = (np.empty(len(rows), np.int64) for _ in range(3))
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (round_ << 60) + (int(key[0]) << 12) + k, at
                at += lengths[i]
            fill[members] = at
        return rows.assign(sequence_id=sequence, offset=offset, fill=fill)
    return pack


def _packed(pieces: DataFrame, capacity: int, round_: int) -> DataFrame:
    groups = max(1, -(-pieces.count() // GROUP))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(groups)))
    return materialise(dealt.groupBy("dealt").applyInPandas(
        _packer(capacity, round_),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long, dealt long, sequence_id long, offset long, fill long",
    ), "packed")


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a closing 0; only longer ones are cut."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(vocabulary, ranks, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    columns = [*pieces.columns, "sequence_id", "offset"]
    pieces = materialise(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") >= capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = _packed(pieces.filter(F.col("length") < capacity), capacity, 0)
    low = F.col("fill") < int(capacity * UNDERFULL)
    second = _packed(first.filter(low).select(pieces.columns), capacity, 1)
    parts = [p.select(columns) for p in (full, first.filter(~low), second)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
