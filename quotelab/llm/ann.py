"""Nearest neighbours through a learned partition of the vectors.

A neighbour graph over a bounded sample is cut into balanced parts; a small classifier learns which part a vector belongs
to, and puts every vector of the table into its most probable part. A query goes to the few most probable parts and is
compared with all vectors there by exact distance. Sample, graph and classifier have a fixed size; parts grow with the table,
so they are cut into blocks, and so are the queries sent to a part; each pair of blocks answers with its own nearest, and the
answers meet per query.

A vector that is null, zero, or holds null or non-finite components takes no part, neither do vectors of another length than
the most frequent one, nor rows with a null id. Rows with one id are candidates of their own but never their own neighbours;
as a query such an id stands for the least of its vectors, compared component by component.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelab.session import materialise

#: Vectors that graph and classifier are fitted on, parts, neighbours in the graph.
SAMPLE, PARTS, DEGREE = 8192, 64, 10
PART_SAMPLE = 64
#: Parts of ``PARTS`` that a query is sent to, and in proportion of fewer. Vectors without any structure need this many for a recall of 0.9; clustered ones far fewer.
PROBES = 48
#: Vectors of one part, and queries to it, that a task compares at once.
BLOCK, QUERY_BLOCK = 1024, 8192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).filter("vec_id IS NOT NULL").filter(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].n if sizes else 0))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the nearest ``degree`` other rows of each row of a sample."""
    norm, out = (x * x).sum(axis=1), []
    for low in range(0, len(x), 64):
        d = norm[None] - 2 * x[low:low + 64] @ x.T
        d[np.arange(len(d)), low + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, degree - 1, axis=1)[:, :degree].copy())  # a view would keep all distances
    return np.vstack(out)


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """A part for each vertex: few edges between parts, none larger than its share by a tenth.

    Starts from the nearest of ``parts`` rows far apart; then each vertex asks for the part that holds most of its neighbours
    (both ways), and the strongest wishes are granted while there is room.
    """
    n, rng = len(graph), np.random.default_rng(seed)
    room = -(-n * 11 // (10 * parts))
    seeds = [int(rng.integers(n))]
    far = ((x - x[seeds[0]]) ** 2).sum(axis=1)
    for _ in range(parts - 1):
        seeds.append(int(rng.choice(n, p=far / far.sum())) if far.sum() > 0 else int(rng.integers(n)))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    pull = 2 * x @ x[seeds].T - (x[seeds] ** 2).sum(axis=1)  # nearest first; a matrix of rows by parts and no more
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    part = None
    for round_ in range(rounds):
        if round_:
            pull = np.zeros((n, parts))
            np.add.at(pull, (a, part[b]), 1.0)
            np.add.at(pull, (b, part[a]), 1.0)
            pull[np.arange(n), part] += 0.5
        part = _granted(pull, room)
    return part


def _granted(pull: np.ndarray, room: int) -> np.ndarray:
    """Each row to its strongest column with room; rows with the clearest wish come first."""
    top = np.partition(pull, -2, axis=1)
    free = np.full(pull.shape[1], room)
    part = np.empty(len(pull), np.int64)
    wishes = np.argsort(-pull, axis=1, kind="stable")
    for i in np.argsort(top[:, -2] - top[:, -1], kind="stable"):
        for k in wishes[i]:
            if free[k]:
                part[i] = k
                free[k] -= 1
                break
    return part


class Router:
    """Softmax over one hidden layer, fitted by mini-batches."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 96, epochs: int = 40, seed: int = 7):
        rng, self.parts = np.random.default_rng(seed), parts
        self.mean, self.scale = x.mean(axis=0), x.std() or 1.0
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), 256):
                at = order[low:low + 256]
                h, p = self._forward(x[at])
                p[np.arange(len(at)), part[at]] -= 1
                p /= len(at)
                dh = (p @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ p, p.sum(axis=0))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= 0.004 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def probable(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each row, the likeliest first."""
        return np.argsort(-self._forward((x - self.mean) / self.scale)[1], axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def fit_router(rows: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> Router | None:
    """Fitted on about ``sample`` distinct vectors, drawn by a hash; at most twice as many reach the driver.

    A part has ``PART_SAMPLE`` vectors of the sample at least, so small tables have fewer parts, the smallest none.
    """
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * sample).toArrow()
    x = np.unique(_matrix(drawn["v"].combine_chunks()), axis=0) if drawn.num_rows else np.empty((0, 0))
    parts = min(parts, len(x) // PART_SAMPLE)
    if parts < 2:
        return None
    return Router(x, balanced_parts(neighbour_graph(x, DEGREE), x, parts), parts)


def _routed(router: Router | None, probes: int, extra: list[str]):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            top = router.probable(x, probes) if router is not None and len(x) else np.zeros((len(x), 1), np.int64)
            ends = np.arange(len(x) + 1, dtype=np.int32) * top.shape[1]
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(top.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in extra], b.column("v"), parts], names=[*extra, "v", "parts"])
    return run


def _nearest(k: int):
    def run(key: tuple, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(points):
            x, ids = np.stack(points["v"].to_numpy()), points["vec_id"].to_numpy()
            for q, own in zip(queries["v"], queries["query_id"], strict=True):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                d[ids == own] = np.inf
                m = min(k, len(d))
                near = np.flatnonzero(d <= np.partition(d, m - 1)[m - 1])
                near = near[np.lexsort((ids[near], d[near]))][:k]
                near = near[np.isfinite(d[near])]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near], "score": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
    return run


def _found(points: DataFrame, blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each row of ``asked`` (query_id, v, parts) among the points of its parts."""
    asked = asked.select("query_id", "v", F.explode("parts").alias("part"))
    # One row per part on the driver, as for the blocks of points.
    sizes = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asks")).collect()
    asks = points.sparkSession.createDataFrame([(r.part, r.asks) for r in sizes], "part int, asks int")
    cut = F.broadcast(blocks.join(asks, "part"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    stored = points.join(cut, "part").select("vec_id", "v", "part", salt("vec_id", "blocks").alias("block"), upto("asks").alias("ask"))
    asked = asked.join(cut, "part").select("query_id", "v", "part", upto("blocks").alias("block"), salt("query_id", "asks").alias("ask"))
    at = ["part", "block", "ask"]
    found = asked.groupBy(*at).cogroup(stored.groupBy(*at)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, is_query: Column, k: int = 10, probes: int = PROBES, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query, from ``usable`` rows with long ids.

    A query whose parts hold fewer than ``k`` candidates is sent to all parts.
    """
    points = materialise(rows.mapInArrow(_routed(router, 1, ["vec_id"]), "vec_id long, v array<double>, parts array<int>"), "index")
    points = points.select("vec_id", "v", F.col("parts")[0].alias("part"))
    # One row per part: a bounded number.
    sizes = points.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()
    blocks = rows.sparkSession.createDataFrame([(r.part, r.blocks) for r in sizes], "part int, blocks int")
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = materialise(queries.mapInArrow(_routed(router, probes, ["query_id"]), "query_id long, v array<double>, parts array<int>"), "queries")
    first = materialise(_found(points, blocks, asked, k), "nearest")
    short = asked.join(first.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    every = F.array(*[F.lit(r.part) for r in sizes]).cast("array<int>")
    rest = _found(points, blocks, short.withColumn("parts", every), k)
    return first.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE, parts: int = PARTS, probes: int = PROBES,
                       id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit and search. ``is_query`` is a condition on ``vec_id``; ``probes`` of ``parts`` are searched."""
    rows = usable(vectors, id_col, vector_col)
    router = fit_router(rows, sample, parts)
    return search(rows, is_query, k, -(-probes * router.parts // parts) if router else 1, router)
