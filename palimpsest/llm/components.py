"""Connected components by alternating large and small stars.

Each task first cuts its edges down to forests. Each round then is two joins of
the edges with the least neighbour of each node, written to the shared folder;
nodes never reach the driver, only sums do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import runtime

#: Edges that a task reduces to a forest at a time.
GATHERED = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges in memory, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        differ = np.flatnonzero(p != q)
        if not len(differ):
            break
        np.minimum.at(up, np.maximum(p, q)[differ], np.minimum(p, q)[differ])  # hook the greater root below the lesser
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _reduced(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes: each task's are cut down to forests, some at a time.

    A root is kept as an edge to itself if all its edges are loops.
    """
    runtime.arrow_limits(edges.sparkSession, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            keep = (a != b) | ~np.isin(a, b[a != b])
            a, b = a[keep], b[keep]
            for lo in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + (1 << 16)]), pa.array(b[lo : lo + (1 << 16)])], names=["a", "b"])

        for batch in batches:
            held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            if sum(len(x) for x, _ in held) >= GATHERED:
                yield from sent()
                held = []
        if held:
            yield from sent()

    return edges.mapInArrow(runtime.lean(run), "a long, b long")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least.hint("merge"), "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b")))


def _observed(rows: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """A written table, and sums over it that are made while it is written."""
    seen = Observation()
    out = runtime.written(rows.observe(seen, *[c.alias(k) for k, c in sums.items()]), "edges")
    return out, seen.get


def connected(edges: DataFrame, sparse: bool = False) -> DataFrame:
    """``node, root`` (the least node of its component) for every node of edges ``a, b`` of longs.

    Loops and repeated edges do no harm; a node with loops only is its own root.
    Rounds go on until nothing changes; each about halves the depth of the trees.
    ``sparse`` edges are few already: those that a Python function made are better
    not sent through another one in the same task.
    """
    spark = edges.sparkSession
    begun, loops = _observed((edges if sparse else _reduced(edges)).distinct(), loops=F.count_if(F.col("a") == F.col("b")))
    now, state = begun.where("a <> b"), None
    while True:
        nxt, seen = _observed(_small(_large(now)).where("a <> b").distinct(), n=F.count("*"), h=F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))))
        if state:
            runtime.discard(spark, now.shared_path)
        now = nxt
        if seen == state:
            break
        state = seen
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)
    if not loops.get("loops"):  # a plan without rows may tell nothing
        runtime.discard(spark, begun.shared_path)
        return found
    alone = begun.where("a = b").select(F.col("a").alias("node")).distinct()
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
