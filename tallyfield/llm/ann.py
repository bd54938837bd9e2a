"""Nearest neighbours through learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours, which is cut into
balanced parts with few edges between them. A small network learns, from a vector, how the
neighbours of its kind are spread over the parts. Every vector is indexed under its most
probable part; a query goes to the most probable parts, as many as the sample shows to be
needed for the wanted recall, and all that lies there is ranked by exact cosine. Parts are
cut into blocks of bounded size, so a part that holds most vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import store
from tallyfield.llm.embedding import matrix, unit, usable

NEAREST = 5
QUERY_EVERY = 50
#: Vectors of the sample that graph and network are fitted on, the first by hash of the id.
SAMPLE = 4000
PARTS = 16
NEIGHBOURS = 10
#: A part of the sample graph holds at most this much more than its even share.
IMBALANCE = 1.1
HIDDEN = 64
STEPS = 1500
BATCH = 256
RATE = 0.003
#: Recall on the sample that fixes how many parts a query goes to.
TARGET_RECALL = 0.95
#: Vectors of a block, all compared with a query in one task.
BLOCK = 4000
SEED = 23


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of every row (unit rows), nearest first."""
    k = min(k, len(x) - 1)
    found = np.zeros((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 500):
        near = x[at : at + 500] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else found[at : at + 500]
        order = np.argsort(np.take_along_axis(-near, best, axis=1), axis=1, kind="stable")
        found[at : at + 500] = np.take_along_axis(best, order, axis=1)
    return found


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them.

    Parts start from balanced cuts along the main axes and are then improved by moving
    rows to the part that holds most of their neighbours while it has room.
    """
    n = len(x)
    part = np.zeros(n, dtype=np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups.sort(key=len, reverse=True)
        own = groups.pop(0)
        centred = x[own] - x[own].mean(axis=0)
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        order = own[np.argsort(centred @ axes[0], kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for number, own in enumerate(groups):
        part[own] = number
    both: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(graph.tolist()):
        both[i] += near
        for j in near:
            both[j].append(i)
    room = int(np.ceil(IMBALANCE * n / parts))
    sizes = np.bincount(part, minlength=parts)
    pick = np.random.default_rng(SEED)
    for _ in range(10):
        moved = 0
        for i in pick.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts).astype(float)
            votes[(sizes >= room) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass(frozen=True)
class Router:
    """One hidden layer from a unit vector to part probabilities, and how many parts to visit."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.first + self.first_bias, 0) @ self.second + self.second_bias

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of every row, the most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, parts: int = PARTS) -> Router:
    """Graph, parts, network and the number of parts to visit, from sample rows of length one."""
    parts = max(1, min(parts, len(x) // 8))
    width = x.shape[1]
    if parts == 1:
        return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    pick = np.random.default_rng(SEED)
    weights = [
        pick.normal(size=(width, HIDDEN)) * np.sqrt(2.0), np.zeros(HIDDEN),
        pick.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts),
    ]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        own = pick.integers(0, len(x), BATCH)
        hidden = np.maximum(x[own] @ weights[0] + weights[1], 0)
        logits = hidden @ weights[2] + weights[3]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (p - target[own]) / BATCH
        back = (slope @ weights[2].T) * (hidden > 0)
        slopes = [x[own].T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
        for w, g, m, s in zip(weights, slopes, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    router = Router(*weights, probes=parts)
    return Router(*weights, probes=_probes(router, x, graph))


def _probes(router: Router, x: np.ndarray, graph: np.ndarray) -> int:
    """Fewest parts to visit for the wanted recall of the sample's nearest neighbours."""
    ranked = router.ranked(x)
    place = np.argsort(ranked, axis=1)  # of each part in each row's order
    near = graph[:, :NEAREST]
    needed = place[np.arange(len(x))[:, None], ranked[near][:, :, 0]]
    for probes in range(1, ranked.shape[1] + 1):
        if (needed < probes).mean() >= TARGET_RECALL:
            return probes
    return ranked.shape[1]


def _ranked_column(vector: Column, shared, count: int) -> Column:
    """The ``count`` most probable parts of each vector."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(vectors: pa.Array) -> pa.Array:
        router = shared.value
        ranked = router.ranked(unit(matrix(vectors, len(router.first))))[:, :count].astype(np.int32)
        offsets = np.arange(0, ranked.size + 1, ranked.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(ranked).ravel(), pa.int32()))

    return of(vector)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """The ``k`` nearest candidates of each query, ties by id; scores do not depend on the grouping."""
    q, c = unit(queries), unit(vectors)
    for at in range(0, len(q), 200):
        near = q[at : at + 200] @ c.T
        near[query_ids[at : at + 200, None] == ids[None, :]] = -np.inf
        keep = min(k, near.shape[1])
        least = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
        for i in range(len(near)):
            # Products of a matrix may differ in the last bits; all that could be among the best are taken again.
            some = np.flatnonzero((near[i] >= least[i] - 1e-9) & (near[i] > -np.inf))
            scores = (c[some] * q[at + i]).sum(axis=1)
            order = np.lexsort((ids[some], -scores))[:k]
            yield query_ids[at + i], ids[some[order]], scores[order]


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Queries are the
    rows whose id is divisible by ``every``; candidates are all rows of another id. Rows with
    a null id and vectors that are null, empty, zero, hold null or non-finite components or
    differ in length from the most vectors take no part. Of an id that comes repeatedly the
    best row counts. Ties go to the smaller id; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fit = store(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    widths = fit.df.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["width"]
    own = fit.df.filter(F.size("vector") == width)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").collect()
    router = fit_router(unit(np.array([r.vector for r in sample])))
    # The router has a fixed size.
    shared = spark.sparkContext.broadcast(router)
    parts = router.second.shape[1]
    ranked = store(
        own.withColumn(
            "parts", _ranked_column(F.col("vector"), shared, max(router.probes, 1))
        ),
        "routed",
    ).df
    placed = ranked.select("vec_id", "vector", F.col("parts")[0].alias("part"))
    # At most PARTS rows.
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(p, 0) // BLOCK))) for p in range(parts)]), F.col("part") + 1)
    candidates = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), blocks).cast("int"))
    asked = ranked.filter(F.col("vec_id") % every == 0).select("vec_id", "vector", F.explode("parts").alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def rank(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and candidates.num_rows:
            x = matrix(queries["vector"].combine_chunks(), width)
            y = matrix(candidates["vector"].combine_chunks(), width)
            for query, ids, scores in _best(queries["vec_id"].to_numpy(), x, candidates["vec_id"].to_numpy(), y, k):
                out[0] += [query] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = asked.groupBy("part", "block").cogroup(candidates.groupBy("part", "block"))
    found = found.applyInArrow(rank, "query_id long, vec_id long, score double")
    # A query brings at most k rows from each block.
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
