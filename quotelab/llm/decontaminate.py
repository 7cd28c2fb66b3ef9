"""Benchmark decontamination by matching statistics.

The benchmark items go into a generalised suffix automaton; every document's words are streamed through it. A run of
``window`` or more matched words is a contaminated span. Items are read as a stream and cut into shards of a fixed
number of words, so that neither the driver nor a worker ever holds more than one shard; documents pass every shard
without a shuffle.

Null or empty texts have no words and no spans; null items have no windows; an item with a null id is matched but not
named; repeated rows of documents stay repeated, repeated items count once.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.llm.suffix_automaton import WindowIndex
from quotelab.llm.texts import keyed_text, term_spans, terms, whole_rows, with_text
from quotelab.llm.worker import kept
from quotelab.session import materialise

#: Words of benchmark items in one automaton: about 100 MB in a worker. Longer items are cut, with an overlap.
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000

_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long"
_CUT = "n_words long, n_cut long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
_CUT_ARROW = pa.struct([("n_words", pa.int64()), ("n_cut", pa.int64())])

def _shards(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list]:
    """Lists of (item id, words) of at most ``SHARD_WORDS`` words; at least one list."""
    shard, size = [], 0
    rows = items.select(items[id_col].cast("string").alias("name"), items[text_col].cast("binary").alias("text"))
    for r in rows.filter("text IS NOT NULL").toLocalIterator():
        words = terms(bytes(r.text))
        for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
            part = words[at:at + PIECE_WORDS + window - 1]
            if shard and size + len(part) > SHARD_WORDS:
                yield shard
                shard, size = [], 0
            if part:
                shard.append((r.name, part))
                size += len(part)
    yield shard


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _found(text: bytes | None, old: dict | None, index: WindowIndex) -> dict:
    words = terms(text)
    spans, names, longest = index.scan(words)
    names.discard(None)
    if old:
        spans = _merge(spans, [[x["start"], x["end"]] for x in old["spans"]])
        names |= set(old["items"])
        longest = max(longest, old["longest"])
    return {"n_words": len(words), "spans": [{"start": x, "end": y} for x, y in spans], "items": sorted(names), "longest": longest}


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them; a line end marks each cut."""
    at, parts, done = term_spans(text), [], 0
    for start, end in spans:
        parts.append(text[done:at[start][0]])
        done = at[end - 1][1]
    return b"\n".join([*parts, text[done:]])


def _pass(rows: DataFrame, shard: list, window: int, carried: str, state: str, state_arrow: pa.StructType, step) -> DataFrame:
    """One shard over all rows: ``step(text, old state, index)`` gives the new text and state."""
    held, key = rows.sparkSession.sparkContext.broadcast(shard), uuid.uuid4().hex

    def scan(batches):
        index = kept(key, lambda: WindowIndex(held.value, window))  # built once in each worker
        for b in batches:
            old = b.column("state").to_pylist() if "state" in b.schema.names else [None] * b.num_rows
            new = [step(text, o, index) for text, o in zip(b.column("text").to_pylist(), old, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(carried), pa.array([x for x, _ in new], pa.binary()), pa.array([x for _, x in new], state_arrow)],
                names=[carried, "text", "state"],
            )

    schema = T.StructType([*rows.select(carried, "text").schema, T.StructField("state", T.StructType.fromDDL(state))])
    return rows.mapInArrow(scan, schema)


def _passes(rows: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, *how) -> tuple[DataFrame, int]:
    out, n = rows, 0
    for shard in _shards(items, id_col, text_col, window):
        out = _pass(materialise(out, "decontaminate") if n else out, shard, window, *how)
        n += 1
    return out, n


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word positions), items (ids as strings) and longest match of every document."""
    def step(text, old, index):
        return text, _found(text, old, index)

    rows, _ = _passes(keyed_text(docs, id_col, text_col), items, window, item_id, item_text, "doc_id", _FOUND, _FOUND_ARROW, step)
    return rows.select("doc_id", "state.*")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated spans, and without documents of which they cover more than ``max_coverage``.

    A cut brings words together that stood apart, so what is left is read again until no window occurs in it.
    """
    def step(text, old, index):
        n_words, n_cut = (old["n_words"], old["n_cut"]) if old else (len(terms(text)), 0)
        while text and (spans := index.scan(terms(text))[0]):
            n_cut += sum(end - start for start, end in spans)
            text = cut_spans(text, spans)
        return text, {"n_words": n_words, "n_cut": n_cut}

    how = ("row", _CUT, _CUT_ARROW, step)
    rows, n = _passes(whole_rows(docs, text_col), items, window, item_id, item_text, *how)
    while n > 1:  # a cut for one shard may have made a window of another
        rows = materialise(rows, "decontaminate")
        before = rows.agg(F.sum("state.n_cut")).first()[0]
        rows, _ = _passes(rows, items, window, item_id, item_text, *how)
        rows = materialise(rows, "decontaminate")
        if rows.agg(F.sum("state.n_cut")).first()[0] == before:
            break
    return with_text(rows.filter(F.col("state.n_cut") <= F.col("state.n_words") * max_coverage), docs.columns, text_col, "text")
