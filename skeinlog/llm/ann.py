"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors in order of the md5 of their id) the exact neighbour graph is built
and cut into equally large parts by recursive bisection: a smooth vector of the graph, split at its median,
then swaps that bring more neighbours together.  A small network learns from each sample vector how its
neighbours spread over the parts.  Every vector is stored in its most probable part; a query visits its most
probable parts and ranks what they hold by exact inner products.  How many parts a query visits is set on
sample vectors that training hasn't seen, so that they find ``GOAL`` of their neighbours.

Parts are split into blocks of about ``BLOCK`` vectors, so one part, however popular, is many tasks.  The
number of parts follows the number of vectors up to ``MOST_PARTS``.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without an id; a query is never its own neighbour (rows with its id are its own); ties go to the
smaller id; a query whose parts hold too few candidates searches all of them; fewer candidates than asked
for are all returned; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, staged

SAMPLE, DEGREE, HELD_OUT = 8192, 12, 768
PER_PART, MOST_PARTS, BLOCK = 3000, 256, 8192
GOAL, HIDDEN, EPOCHS = 0.95, 96, 60
QUERIES_AT_ONCE = 256


def top_inner(queries: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest inner products of each query, in no order; a block of queries at a time."""
    out = []
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ vectors.T
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node of a neighbour graph: recursive bisection into equal halves."""
    out = np.zeros(len(near), np.int64)

    def halve(nodes: np.ndarray, first: int, count: int) -> None:
        out[nodes] = first
        if count == 1 or len(nodes) < 2:
            return
        place = np.full(len(near), -1)
        place[nodes] = np.arange(len(nodes))
        a = np.repeat(np.arange(len(nodes)), near.shape[1])
        b = place[near[nodes].ravel()]
        a, b = np.concatenate([a[b >= 0], b[b >= 0]]), np.concatenate([b[b >= 0], a[b >= 0]])
        degree = np.maximum(np.bincount(a, minlength=len(nodes)), 1)
        x = np.random.default_rng(len(nodes)).standard_normal(len(nodes))
        for _ in range(60):  # towards the smoothest vector that isn't constant
            x = 0.5 * x + 0.5 * np.bincount(a, x[b], len(nodes)) / degree
            x -= (x * degree).sum() / degree.sum()
            x /= np.linalg.norm(x) + 1e-12
        side = np.zeros(len(nodes), bool)
        side[np.argsort(x, kind="stable")[len(nodes) // 2 :]] = True
        for _ in range(12):  # swaps
            other = np.bincount(a, side[b] != side[a], len(nodes))
            gain = 2 * other - np.bincount(a, minlength=len(nodes))
            l, r = (np.flatnonzero(side == s) for s in (False, True))
            l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
            m = min(len(l), len(r))
            good = np.flatnonzero(gain[l[:m]] + gain[r[:m]] > 2)
            if not len(good):
                break
            n = max(1, len(good) // 4)
            side[l[:n]], side[r[:n]] = True, False
        halve(nodes[~side], first, count // 2)
        halve(nodes[side], first + count // 2, count - count // 2)

    halve(np.arange(len(near)), 0, parts)
    return out


class Router:
    """A network with one hidden layer: the probabilities that a vector's neighbours are in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray):
        rng = np.random.default_rng(7)
        d, p = x.shape[1], target.shape[1]
        self.scale = np.float32(1 / (np.sqrt((x**2).mean()) + 1e-12))
        x = x * self.scale
        w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
        w = [a.astype(np.float32) for a in w]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                i = order[at : at + 256]
                h = np.maximum(x[i] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                dz = (z / z.sum(1, keepdims=True) - target[i]) / len(i)
                dh = (dz @ w[2].T) * (h > 0)
                grads = [x[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
                t += 1
                rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
                for k, g in enumerate(grads):
                    g = g + 1e-4 * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        self.w = w

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts, the likeliest first."""
        z = np.maximum(x.astype(np.float32) * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, parts: int, k: int) -> tuple[Router | None, int]:
    """The router of ``parts`` parts, and how many of them a query has to visit."""
    if parts < 2 or len(sample) < 8 * parts:
        return None, 1
    x = sample.astype(np.float32)
    near = top_inner(x, x, DEGREE + 1)
    part = balanced_parts(near, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    target /= target.sum(1, keepdims=True)
    held = np.zeros(len(x), bool)
    held[: min(HELD_OUT, len(x) // 4)] = True
    router = Router(x[~held], target[~held])
    home = router.ranked(x, 1)[:, 0]
    visits = router.ranked(x[held], parts)
    wanted = home[top_inner(x[held], x, min(k + 1, len(x) - 1))]
    # At which visit each wanted neighbour's part comes.
    turn = np.argsort(visits, axis=1)[np.arange(held.sum())[:, None], wanted]
    for n in range(1, parts + 1):
        if (turn < n).mean() >= GOAL:
            return router, n
    return router, parts


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = col(vectors, vector_col)
    rows = vectors.select(col(vectors, id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _ranked(ids: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By cost and id, each pair of them once."""
    order = np.lexsort((ids, cost))
    ids, cost = ids[order], cost[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (cost[1:] != cost[:-1])
    return ids[new], cost[new]


def _best(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the ids and exact scores of its ``k`` best, ties by id."""
    slack = 1e-9 * max(1.0, float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1]))
    for at in range(0, len(q), QUERIES_AT_ONCE):
        s = q[at : at + QUERIES_AT_ONCE] @ v.T
        own = ids[None, :] == query_ids[at : at + QUERIES_AT_ONCE, None]
        s[own] = -np.inf
        kk = min(k, len(ids))
        edge = np.partition(s, len(ids) - kk, axis=1)[:, len(ids) - kk]
        for i in range(len(s)):
            j = np.flatnonzero((s[i] >= edge[i] - slack) & (s[i] > -np.inf))
            exact = (v[j] * q[at + i]).sum(1)  # the same order of additions for every pair
            found, cost = _ranked(ids[j], -exact)
            if len(found) < k and len(j) < (s[i] > -np.inf).sum():  # repeats filled places
                j = np.flatnonzero(s[i] > -np.inf)
                found, cost = _ranked(ids[j], -(v[j] * q[at + i]).sum(1))
            yield int(query_ids[at + i]), found[:k], -cost[:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by inner product."""
    spark = vectors.sparkSession
    # Repeated rows would fill the places of different neighbours.
    rows = _valid(vectors, id_col, vector_col).distinct()
    asked = _valid(queries, id_col, vector_col)
    total = rows.count()
    parts = 1
    while parts < MOST_PARTS and total >= 2 * parts * PER_PART:
        parts *= 2
    # Rows of another length than most can't be compared; the sample tells the length.
    picked = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(sample).select("v").toArrow()
    lengths = [len(x) for x in picked.column("v").to_pylist()]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width)
    x = np.array([v for v in picked.column("v").to_pylist() if len(v) == width], np.float64)
    router, visits = fit(x, parts, k)
    parts = parts if router else 1
    shared = spark.sparkContext.broadcast(router)

    def routed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1))
                if shared.value is None or not len(v):
                    p = np.zeros((len(v), 1), np.int64)
                else:
                    p = shared.value.ranked(v, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "parts"])

        return run

    schema = "vec_id long, v array<double>, parts array<int>"
    stored = staged(rows.mapInArrow(routed(1), schema).select("vec_id", "v", F.get("parts", F.lit(0)).alias("part")), "vectors")
    blocks = {r["part"]: max(1, -(-r["n"] // BLOCK)) for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTS rows
    n_blocks = F.array(*[F.lit(blocks.get(p, 1)) for p in range(parts)])
    of_part = F.get(n_blocks, F.col("part"))
    placed = stored.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_part).cast("int"))

    def search(who: DataFrame, n: int) -> DataFrame:
        sent = who.mapInArrow(routed(n), schema).withColumn("part", F.explode("parts"))
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), of_part - 1)))

        def rank(left: pa.Table, right: pa.Table) -> pa.Table:
            query, found, score = [], [], []
            if left.num_rows and right.num_rows:
                ids, v = left.column("vec_id").to_numpy(), _matrix(left.column("v"))
                for q, i, s in _best(ids, v, right.column("vec_id").to_numpy(), _matrix(right.column("v")), k):
                    query.append(q)
                    found.append(i.tolist())
                    score.append(s.tolist())
            return pa.table({"query_id": pa.array(query, pa.int64()), "ids": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(score, pa.list_(pa.float64()))})

        tops = placed.groupBy("part", "block").cogroup(sent.groupBy("part", "block")).applyInArrow(rank, "query_id long, ids array<long>, scores array<double>")
        pairs = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("cost"), i.alias("vec_id")))
        # Per query at most k from each block that it visits.
        best = tops.groupBy("query_id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k).alias("best"))
        return best

    found = staged(search(asked, visits), "found")
    full = min(k, max(0, total - 1))
    if visits < parts:
        few = asked.join(found.where(F.size("best") >= full), F.col("vec_id") == F.col("query_id"), "left_anti")
        if not few.isEmpty():
            again = search(few, parts)
            found = found.where(F.size("best") >= full).union(again)
    ranked = found.select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.cost")).alias("score"))
