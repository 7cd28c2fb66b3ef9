"""SimHash fingerprints and their near-duplicate groups, linked through vantage-point trees.

Two fingerprints of 64 bits within ``RADIUS`` = 4 bits have, of their four quarters, one pair within 1 bit. So each
quarter has a vantage-point tree over its values: a node splits by the Hamming distance to its vantage point, and by the
triangle bound a value within 1 bit of the boundary is sought on both sides. The leaves of the tops of the trees are
shards: every distinct fingerprint is stored in its own leaf and sent as a query to the leaves on the other side of close
boundaries too. In a shard the trees go on down to small leaves, and what is left is compared over all 64 bits.

Equal fingerprints are one point from the start. A shard returns links that connect what it found connected, not all
pairs. A shard with many points is cut into blocks of queries and points that meet block by block.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.llm import near_copies
from quotelab.llm.components import connected_components
from quotelab.llm.texts import keyed_text, tokens, whole_rows
from quotelab.session import discard, materialise

RADIUS, QUARTERS, QUARTER_RADIUS = 4, 4, 1
SHINGLE, SEED = 4, 42
#: Points and queries that meet in one task.
BLOCK = 8192
#: Levels of the trees that make shards: as many as bring a shard below half a block, within these bounds.
MIN_LEVELS, MAX_LEVELS = 4, 13
#: Points in a leaf of the tree inside a shard.
LEAF = 48

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLICE = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Bit i is 1 if it is set in more than half of the hashes of the shingles; 0 without words."""
    words = tokens(text.translate(_LOWER)) if text else []
    if len(words) > SHINGLE:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    else:
        shingles, n = iter([b" ".join(words)] if words else []), int(bool(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        bits = np.unpackbits(hashes[at:at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def _fingerprints(carried: str):
    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(carried), pa.array(prints.view(np.int64))], names=[carried, "fp"])
    return run


def _vantage(node: int) -> int:
    """The vantage point of a node of the top tree: any rule serves; this one mixes the node's number."""
    return (node * 0x9E3779B1 >> 7) & 0xFFFF


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def shard_levels(n_points: int) -> int:
    return min(MAX_LEVELS, max(MIN_LEVELS, (2 * n_points // BLOCK).bit_length()))


def shard_values(levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaf of each of the 65,536 quarter values, and pairs (value, leaf) of the other leaves within 1 bit of it."""
    values = np.arange(1 << 16)
    own = np.ones(len(values), np.int64)
    sought: dict[int, np.ndarray] = {1: values}
    for level in range(levels):
        split = 7 + level % 2  # half of all values lie at most 7 or 8 bits from any vantage point, in turn
        below: dict[int, np.ndarray] = {}
        for node, here in sought.items():
            d = _popcount(here ^ _vantage(node))
            below[2 * node] = here[d <= split + QUARTER_RADIUS]
            below[2 * node + 1] = here[d > split - QUARTER_RADIUS]
            mine = own[here] == node
            own[here[mine]] = 2 * node + (d[mine] > split)
        sought = below
    value = np.concatenate(list(sought.values()))
    leaf = np.repeat(list(sought), [len(v) for v in sought.values()])
    other = own[value] != leaf
    order = np.argsort(value[other], kind="stable")
    return own, value[other][order], leaf[other][order]


_tables: dict[int, tuple] = {}


def _routes(levels: int):
    """(quarter, shard, fp, home): one row for the leaf that holds a fingerprint, one for each other leaf that is asked."""
    def run(batches):
        if levels not in _tables:
            own, value, leaf = shard_values(levels)
            _tables[levels] = own, np.searchsorted(value, np.arange((1 << 16) + 1)), leaf
        own, ends, leaves = _tables[levels]
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for quarter in range(QUARTERS):
                value = ((fp >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)).astype(np.int64)
                n = ends[value + 1] - ends[value]
                who = np.repeat(np.arange(len(fp)), n)
                other = leaves[np.repeat(ends[value] - np.cumsum(n) + n, n) + np.arange(len(who))]
                points = np.r_[fp, fp[who]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), quarter, np.int32)), pa.array(np.r_[own[value], other].astype(np.int32)),
                     pa.array(points.view(np.int64)), pa.array(np.arange(len(points)) < len(fp))],
                    names=["quarter", "shard", "fp", "home"],
                )
    return run


class Links:
    """Groups of indices below ``n`` under links that come in arrays; as few links as connect them are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not (self.label[self.label] == self.label).all():
                self.label = self.label[self.label]


def tree_links(points: np.ndarray, queries: np.ndarray, quarter: int, links: Links) -> None:
    """Give ``links`` all pairs (query, number of queries + point) within the radius whose quarters lie within 1 bit.

    A vantage-point tree over the points' quarters is walked by all queries together: those whose distance to the vantage
    point is within the radius of the boundary go down both ways.
    """
    shift = np.uint64(16 * quarter)
    part = lambda x: (x >> shift) & np.uint64(0xFFFF)
    p_value, q_value = part(points), part(queries)
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        vantage = p_value[p[len(p) // 2]]
        d = _popcount(p_value[p] ^ vantage)
        if len(p) <= LEAF or d.max() == d.min():
            for low in range(0, len(q), 1 << 13):
                some = q[low:low + (1 << 13)]
                for at in range(0, len(p), LEAF):
                    i, j = np.nonzero(np.bitwise_count(queries[some, None] ^ points[None, p[at:at + LEAF]]) <= RADIUS)
                    links.add(some[i], len(queries) + p[at + j])
            continue
        radius = min(int(np.partition(d, len(d) // 2)[len(d) // 2]), int(d.max()) - 1)
        e = _popcount(q_value[q] ^ vantage)
        todo.append((p[d <= radius], q[e <= radius + QUARTER_RADIUS]))
        todo.append((p[d > radius], q[e > radius - QUARTER_RADIUS]))


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    fp = rows["fp"].to_numpy().view(np.uint64)
    stored = rows["stored"].to_numpy()
    points, queries = fp[stored], fp[~stored]
    names = np.concatenate([queries, points])
    links = Links(len(names))
    tree_links(points, queries, int(key[0]), links)
    a, b = names, names[links.label]
    return pd.DataFrame({"a": a[a != b].view(np.int64), "b": b[a != b].view(np.int64)})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs within ``RADIUS`` bits do."""
    routed = materialise(prints.select("fp").mapInArrow(_routes(shard_levels(prints.count())), "quarter int, shard int, fp long, home boolean"), "routes")
    sizes = routed.groupBy("quarter", "shard").agg(F.count_if("home").alias("points"), F.count("*").alias("queries"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    # At most QUARTERS * 2**MAX_LEVELS rows, whatever the input.
    sizes = F.broadcast(sizes.filter("points > 0").select("quarter", "shard", blocks("points").alias("np"), blocks("queries").alias("nq")))
    rows = routed.join(sizes, ["quarter", "shard"])
    spread = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = rows.filter("home").select("quarter", "shard", "fp", spread("np", 1).alias("pb"), every("nq").alias("qb"), F.lit(True).alias("stored"))
    asked = rows.select("quarter", "shard", "fp", every("np").alias("pb"), spread("nq", 2).alias("qb"), F.lit(False).alias("stored"))
    met = stored.unionByName(asked).groupBy("quarter", "shard", "pb", "qb").applyInPandas(_meet, "a long, b long")
    links = materialise(met.distinct(), "links")
    discard(routed)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach.

    Null and empty texts have fingerprint 0 and link like any other. A row with a null id links its group but never
    names it; a group of such rows alone has a null component_id. Repeated rows stay repeated.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = materialise(rows.mapInArrow(_fingerprints("doc_id"), f"doc_id {kind}, fp long"), "fingerprints")
    return prints.join(component_of(prints, "doc_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: that with the least doc_id, of rows that share it one alone.

    Groups are linked by pairs whose sets of ``shingle`` words have a Jaccard similarity of at least ``similarity``, all of
    which are found; fingerprints within op3's radius would miss most edited copies.
    """
    rows = keyed_text(docs, id_col, text_col).withColumn("rid", F.xxhash64("doc_id", "text"))
    prints, links = near_copies.similar_links(rows, shingle, similarity)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("kept")
    kept = prints.groupBy("fp", "doc_id", "rid").agg(F.count("*").alias("n")).join(component_of(prints, "doc_id", links), "fp")
    # A group of rows without ids has no component id; its root names it.
    kept = kept.groupBy("root", "n").agg(least).groupBy("root").agg(F.min(F.struct("kept", "n")).alias("least"))
    kept = materialise(kept.select(F.col("least.kept.doc_id").alias("k_doc"), F.col("least.kept.rid").alias("k_rid"), F.col("least.n").alias("n")), "kept")
    discard(prints)
    discard(links)
    found = whole_rows(docs, text_col).drop("text").withColumn("doc_id", F.col("row").getField(id_col))
    found = found.withColumn("rid", F.xxhash64("doc_id", F.col("row").getField(text_col).cast("binary")))
    found = found.join(kept, (F.col("rid") == F.col("k_rid")) & F.col("doc_id").eqNullSafe(F.col("k_doc")))
    whole = found.filter("n = 1").unionByName(found.filter("n > 1").dropDuplicates(["rid", "doc_id"]))
    return whole.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def component_of(prints: DataFrame, id_col: str, links: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, root) for each distinct fingerprint of ``prints``; root is a fingerprint that names the group.

    ``links`` (a, b) between fingerprints are those within the radius unless given.
    """
    points = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "points")
    links = fingerprint_links(points) if links is None else links
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = points.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "groups")
    ids = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return named.join(ids, "root").select("fp", "component_id", "root")
