"""Connected components of a graph given as a table of links, by alternating large-star and small-star.

Everything stays in tables: each round is written to the shared folder, so no lineage grows and a lost
executor costs a re-read.  Before the first round every task connects the links it holds, ``LOCAL`` at a time,
and passes on a star for each part of them: never more links than it had, and of a few links only the
result is left.  A round only aggregates and joins on node ids; the links of a busy node are
pre-aggregated before they are shuffled, and adaptive execution splits what still lands on one key.  Rounds end when
the links are stars.

Defined results: links of a node with itself or with null are left out; repeated links count once; no links, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: Links that a task connects at a time.
LOCAL = 200_000


def _connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its part) of the graph of these links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (across := root[x] != root[y]).any():
        p, q = root[x[across]], root[y[across]]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(links: DataFrame, local: int) -> DataFrame:
    """Fewer links that connect the same nodes, ``a`` the larger end: about ``local`` of the input a task, no shuffle."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            a, b = _connected(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, local):
                part = batch.slice(at, local)
                held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
                n += part.num_rows
                if n >= local:
                    yield stars()
                    held, n = [], 0
        if held:
            yield stars()

    tasks = max(1, -(-links.count() // local))
    return links.where("a <> b").select("a", "b").coalesce(tasks).mapInArrow(contract, "a long, b long")


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = links.union(links.select(F.col("b"), F.col("a")))
    # As a table, so that the join below is one of plain scans, whose busy nodes the engine splits.
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = down.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), least


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either the larger end of one link or the smaller end of any number."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    wrong = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("ends")).where("ups > 0 and ends > 1")
    return not wrong.agg(F.count("*")).first()[0]


def components(links: DataFrame, label: str = "components", local: int = LOCAL) -> DataFrame:
    """``node``, ``root`` (the smallest node that can be reached) for every node with a link; columns ``a``, ``b``."""
    now = staged(_contracted(links, local), label)
    while not _are_stars(now):
        star, least = _large_star(now)
        large = staged(star, label)
        star, below = _small_star(large)
        new = staged(star, label)
        for done in (least, below, large, now):
            drop_staged(done)
        now = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
