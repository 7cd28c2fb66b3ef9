"""Alignment of the tokens that two tokenizers make of the same texts, and how often each pair of tokens meets.

Both tokenizers cut the bytes of a text, so where tokens of both end, the text falls into groups; and the ends of either cut
it into segments, each of which lies in one token of A and one of B: the segments are the links. Within a task everything is
Arrow: token lists are flattened, parent indices and cumulative sums cut at documents give each token's end, Acero joins A
and B on (document, end), and ``Table.group_by`` counts pairs by document and by batch. Spark adds the batches' counts. A second
pass over the stored pairs looks the sums up: in the workers' memory where there are at most ``HELD_PAIRS`` pairs, else by a
join that deals every pair to ``SALT`` tasks.

A text that is null or empty, or whose bytes a tokenizer does not give back, has no tokens: zeros and an empty
digest. Rows are taken one by one, whatever their ids; other columns play no part. A text is tokenized whole, so a worker
holds the tokens of the longest text; shorter ones share slices of ``SLICE`` bytes.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.session import discard, materialise

#: Bytes of text that are aligned together.
SLICE = 1 << 19
#: Pairs of tokens whose counts a worker may hold: 24 bytes each.
HELD_PAIRS = 2_000_000
#: Tasks that one pair is dealt to where counts are joined.
SALT = 16

#: Beyond these characters, libraries may differ in what they count as a letter.
_ALIKE = re.compile("[\\x00-\\x7e¡-ɏ]*")

_held: dict[tuple, tuple] = {}


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _table(tokens: dict[int, bytes]) -> pa.Array:
    return pa.array([tokens.get(k) for k in range(max(tokens) + 1)], pa.binary())


def _tokenizers(a_file: str, a_ranks: str | None, b_file: str):
    """Texts -> lists of ids, and bytes by id, of A (a byte-level tokenizer file, optionally also as ranks) and of B (sentencepiece)."""
    key = a_file, a_ranks, b_file
    if key not in _held:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(a_file)
        slow.encode_special_tokens = True
        level = _byte_level()
        special = {k for k, v in slow.get_added_tokens_decoder().items() if v.special}
        a_bytes = _table({k: bytes(level[c] for c in t) for t, k in slow.get_vocab().items() if k not in special})
        fast = None
        if a_ranks:
            with open(a_ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_file)
        b_bytes = _table({k: bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode()
                          for k in range(pieces.get_piece_size()) if not (pieces.is_control(k) or pieces.is_unknown(k))})

        def encode_a(texts):
            return [fast.encode_ordinary(t) if fast and _ALIKE.fullmatch(t) else slow.encode(t, add_special_tokens=False).ids for t in texts]

        _held[key] = encode_a, a_bytes, lambda texts: pieces.encode(texts, num_threads=1), b_bytes
    return _held[key]


def _offsets(lengths: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))]), pa.int32())


def _spelled(ids: pa.ListArray, spelling: pa.Array) -> pa.Array:
    """Each list's tokens joined."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, spelling.take(ids.values)), pa.scalar(b"", pa.binary()))


def _ends(ids: pa.ListArray, spelling: pa.Array) -> pa.Table:
    """at, id and key (document, end) of every token; ends start anew with each document."""
    parent, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    run = pc.cumulative_sum(pc.cast(pc.binary_length(spelling), pa.int64()).take(flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), run]), pc.take(ids.offsets, parent))
    key = pc.add(pc.shift_left(pc.cast(parent, pa.int64()), 32), pc.subtract(run, before))
    return pa.table({"key": key, "id": flat})


def _joined_groups(ends: pa.Table, own: str, shared: pa.ChunkedArray) -> pa.Array:
    """The comma-joined ids of ``own`` in each group."""
    mine = pc.is_valid(ends[own])
    ids, last = ends[own].filter(mine).combine_chunks(), shared.filter(mine).combine_chunks()
    cuts = pc.add(pc.indices_nonzero(last), pa.scalar(1, pa.uint64()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(cuts, pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(ids, pa.string())), ",")


def align(a_ids: pa.ListArray, b_ids: pa.ListArray, a_bytes: pa.Array, b_bytes: pa.Array) -> tuple[pa.Table, list[str]]:
    """Distinct linked pairs of every document (doc, a, b, m) with their number of links, and the documents' groups as text.

    Both lists must spell the same bytes.
    """
    a, b = _ends(a_ids, a_bytes).rename_columns(["key", "a"]), _ends(b_ids, b_bytes).rename_columns(["key", "b"])
    ends = a.join(b, "key", join_type="full outer", use_threads=False).sort_by("key")
    shared = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"]))
    doc = pc.cast(pc.shift_right(ends["key"], 32), pa.int32())
    groups = pc.binary_join_element_wise(_joined_groups(ends, "a", shared), _joined_groups(ends, "b", shared), "|")
    per_doc = pa.array(np.bincount(doc.filter(shared).to_numpy(), minlength=len(a_ids)))
    texts = pc.binary_join(pa.ListArray.from_arrays(_offsets(per_doc), groups), ";")
    # the last end of a document is shared, so filling never takes a token of the next one
    links = pa.table({"doc": doc, "a": pc.fill_null_backward(ends["a"]), "b": pc.fill_null_backward(ends["b"])})
    pairs = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "a", "b", "m"])
    return pairs.sort_by("doc"), texts.to_pylist()


def _slices(texts: pa.Array):
    """(first row, texts) of consecutive rows with about ``SLICE`` bytes together."""
    first, held, size = 0, [], 0
    for k in range(len(texts)):
        held.append(texts[k].as_py() or "")
        size += len(held[-1])
        if size >= SLICE or k + 1 == len(texts):
            yield first, held
            first, held, size = k + 1, [], 0


_LINKED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, m array<int>"


def _aligned(files: tuple):
    def run(batches):
        encode_a, a_bytes, encode_b, b_bytes = _tokenizers(*files)
        ids = pa.list_(pa.int32())
        for rows in batches:
            for first, texts in _slices(rows.column("text")):
                spaced = pa.array([f" {t}".encode() for t in texts], pa.binary())
                a, b = pa.array(encode_a([f" {t}" for t in texts]), ids), pa.array(encode_b(texts), ids)
                sound = pc.and_(pc.equal(_spelled(a, a_bytes), spaced), pc.equal(_spelled(b, b_bytes), spaced))
                sound = pc.and_(pc.fill_null(sound, False), pa.array([bool(t) for t in texts]))
                none = pa.scalar([], ids)
                a, b = pc.if_else(sound, a, none), pc.if_else(sound, b, none)
                pairs, groups = align(a, b, a_bytes, b_bytes)
                offsets = _offsets(pa.array(np.bincount(pairs["doc"].to_numpy(), minlength=len(texts))))
                held = [pa.ListArray.from_arrays(offsets, pc.cast(pairs[c], pa.int32()).combine_chunks()) for c in ("a", "b", "m")]
                n_a, n_b = (pc.cast(pc.list_value_length(x), pa.int64()) for x in (a, b))
                n_groups = pa.array([g.count(";") + 1 if g else 0 for g in groups], pa.int64())
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key").slice(first, len(texts)), n_a, n_b, n_groups, pc.subtract(pc.add(n_a, n_b), n_groups), pa.array(digest), *held],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "m"])
    return run


def linked_tokens(docs: DataFrame, a_file: str, a_ranks: str | None, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid (a number of the row), counts, digest of the groups, and the distinct linked pairs a, b with their links m."""
    rows = docs.select(F.struct(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("rid")).alias("key"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_aligned((a_file, a_ranks, b_file)), f"key {kind}, {_LINKED}").select("key.*", *[c.split()[0] for c in _LINKED.split(", ")])


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, links and best: how many links of all documents hold a pair, and whether no other A token has more with that b."""
    def run(batches):
        for rows in batches:
            flat = pa.table({c: pc.list_flatten(rows.column(c)) for c in ("a", "b", "m")})
            some = flat.group_by(["a", "b"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["a", "b", "links"])
            yield from some.cast(pa.schema([("a", pa.int32()), ("b", pa.int32()), ("links", pa.int64())])).to_batches()

    partial = linked.select("a", "b", "m").mapInArrow(run, "a int, b int, links long")
    counts = materialise(partial.groupBy("a", "b").agg(F.sum("links").alias("links")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _looked_up(linked: DataFrame, counts: DataFrame) -> DataFrame:
    got = counts.toArrow()  # at most HELD_PAIRS rows
    code = lambda t: (t["a"].to_numpy().astype(np.int64) << 32) + t["b"].to_numpy()
    order = np.argsort(code(got))
    held = linked.sparkSession.sparkContext.broadcast((code(got)[order], got["links"].to_numpy()[order], got["best"].to_numpy()[order]))

    def run(batches):
        codes, links, best = held.value
        for rows in batches:
            flat = pa.table({c: pc.list_flatten(rows.column(c)) for c in ("a", "b", "m")})
            at, m = np.searchsorted(codes, code(flat)), flat["m"].to_numpy().astype(np.int64)
            ends = np.cumsum(pc.list_value_length(rows.column("m")).to_numpy())
            sums = []
            for weight in (best, links):
                run_ = np.concatenate([[0], np.cumsum(m * weight[at] if len(at) else m)])
                sums.append(np.diff(run_[ends], prepend=0))
            yield pa.RecordBatch.from_arrays([rows.column("key"), *map(pa.array, sums)], names=["key", "n_best", "count_sum"])

    key = F.struct(*[c for c in linked.columns if c not in ("a", "b", "m")]).alias("key")
    rows = linked.select(key, "a", "b", "m")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_best long, count_sum long").select("key.*", "n_best", "count_sum")


def _joined(linked: DataFrame, counts: DataFrame) -> DataFrame:
    salt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = linked.select("rid", F.pmod(F.xxhash64("rid"), F.lit(SALT)).cast("int").alias("salt"), F.explode(F.arrays_zip("a", "b", "m")).alias("x"))
    found = pairs.select("rid", "salt", "x.*").join(salt, ["a", "b", "salt"])
    sums = found.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("m").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("links")).alias("count_sum"))
    rows = linked.drop("a", "b", "m").join(sums, "rid", "left")
    return rows.na.fill(0, ["n_best", "count_sum"])


def alignment(docs: DataFrame, a_file: str, a_ranks: str | None, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    linked = materialise(linked_tokens(docs, a_file, a_ranks, b_file, id_col, text_col), "linked")
    counts = materialise(pair_counts(linked), "counts")
    found = (_looked_up if counts.count() <= HELD_PAIRS else _joined)(linked, counts)
    out = materialise(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "aligned")
    discard(linked)
    discard(counts)
    return out
