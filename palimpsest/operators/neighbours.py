"""Facts whose vectors are near, as a join: the candidates that order-bound ingest walks over.

Equal vectors of a history are one point. Points of a small history are one block; those
of a large one are cut by their angle to a pivot, at quantiles, and where very many have
the same angle by a hash. Vectors whose cosine reaches the threshold differ in their
angles to any pivot by no more than the threshold's angle, so only blocks that are that
near meet, each pair of blocks as one matrix product in a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import checkpointed, ship

#: Points of a block, and blocks by angle of a large history.
BLOCK, CUTS = 2048, 64
EDGE = "history_name string, a long, b long, score double"


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    n = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(n > 0, n, 1.0)[:, None]


def pairs_within(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and cosines of unit rows that reach the threshold; a pair's cosine does not depend on its block."""
    i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
    score = np.einsum("ij,ij->i", x[i], y[j])
    keep = score >= threshold
    return i[keep], j[keep], score[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)


def _tile(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Near pairs of two blocks, a <= b; of a block with itself each pair once."""
        found = []
        if len(left) and len(right):
            p, q = left["seq"].to_numpy(), right["seq"].to_numpy()
            x, y = (units(_matrix(t["embedding"])) for t in (left, right))
            one = all(left[f"{c}1"][0] == left[f"{c}2"][0] for c in ("part", "sub"))
            for lo in range(0, len(x), 512):
                i, j, score = pairs_within(x[lo : lo + 512], y, threshold)
                a, b = p[lo + i], q[j]
                keep = a <= b if one else np.ones(len(a), bool)
                found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], score[keep]))
        name = left["history_name"][0] if len(left) else None
        a, b, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"history_name": pa.array([name.as_py() if name else None] * len(a), pa.string()), "a": a, "b": b, "score": score})

    return run


def points(facts: DataFrame) -> DataFrame:
    """``history_name, seq, embedding``: each vector of a history once, under its least ``seq``; null vectors are none."""
    rows = facts.where("embedding IS NOT NULL").select("history_name", F.col("seq").cast("long").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("history_name", "embedding").agg(F.min("seq").alias("seq")).select("history_name", "seq", "embedding")


def blocked(facts: DataFrame) -> DataFrame:
    """Points with their block (``part``, ``sub``) and angle to their history's pivot."""
    p = checkpointed(points(facts))
    sizes = p.groupBy("history_name").agg(F.count("*").alias("n"), F.min_by("embedding", F.struct(F.xxhash64("seq"), "seq")).alias("pivot"))
    name = F.col("p.history_name").eqNullSafe(F.col("s.history_name"))
    with_n = p.alias("p").join(sizes.alias("s"), name).select("p.*", "n", "pivot")
    cosine = vectors.dot(vectors.normalized(F.col("embedding")), vectors.normalized(F.col("pivot")))
    turned = with_n.withColumn("angle", F.when(F.col("n") > BLOCK, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).otherwise(0.0)).drop("pivot", "n")
    cuts = turned.groupBy("history_name").agg(F.percentile_approx("angle", [i / CUTS for i in range(1, CUTS)], 10_000).alias("cuts"))
    parts = turned.alias("p").join(cuts.alias("s"), name).select("p.*", F.size(F.filter("cuts", lambda c: c < F.col("angle"))).alias("part"))
    counted = parts.groupBy("history_name", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    return parts.alias("p").join(counted.alias("s"), name & (F.col("p.part") == F.col("s.part"))).select("p.*", F.pmod(F.xxhash64("seq"), F.col("subs")).cast("int").alias("sub"))


def tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """``history_name, part1, sub1, part2, sub2``: pairs of blocks that can hold near points."""
    own = blocks.groupBy("history_name", "part", "sub").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    x = own.select("history_name", *[F.col(c).alias(f"{c}1") for c in ("part", "sub", "lo", "hi")])
    y = own.select(F.col("history_name").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("part", "sub", "lo", "hi")])
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    ordered = (F.col("part1") < F.col("part2")) | ((F.col("part1") == F.col("part2")) & (F.col("sub1") <= F.col("sub2")))
    near = F.greatest(F.col("lo2") - F.col("hi1"), F.col("lo1") - F.col("hi2")) <= reach
    return x.join(y, F.col("history_name").eqNullSafe(F.col("other")) & ordered & near).select("history_name", "part1", "sub1", "part2", "sub2")


def edges(facts: DataFrame, threshold: float) -> DataFrame:
    """``history_name, a, b, score``: points of a history (a <= b, by ``seq``) whose cosine reaches the threshold.

    Every point that does is its own neighbour too. Facts of a history have different
    ``seq``. Null histories are one.
    """
    ship(facts.sparkSession)
    blocks = checkpointed(blocked(facts))
    pairs = tiles(blocks, threshold)
    key = ["history_name", "part1", "sub1", "part2", "sub2"]
    meet = lambda k: blocks.alias("p").join(pairs.alias("t"), F.col("p.history_name").eqNullSafe(F.col("t.history_name")) & (F.col("p.part") == F.col(f"t.part{k}")) & (F.col("p.sub") == F.col(f"t.sub{k}"))).select(*[F.col(f"t.{c}").alias(c) for c in key], F.col("p.seq").alias("seq"), F.col("p.embedding").alias("embedding"))  # noqa: E731  new columns for either side
    return meet(1).groupBy(*key).cogroup(meet(2).groupBy(*key)).applyInArrow(_tile(threshold), EDGE)


class Near:
    """Each point's neighbours, the nearest first; points are named by their first fact."""

    def __init__(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        loops = a == b
        own, other, s = (np.concatenate([x, y[~loops]]) for x, y in ((a, b), (b, a), (score, score)))
        order = np.lexsort((other, -s, own))
        self.other, self.score = other[order], s[order]
        names, at = np.unique(own[order], return_index=True)
        ends = np.append(at[1:], len(order))[: len(names)]
        self.at = dict(zip(names.tolist(), zip(at.tolist(), ends.tolist(), strict=True), strict=True))

    def of(self, point: int) -> tuple[list[int], list[float]]:
        lo, hi = self.at.get(point, (0, 0))
        return self.other[lo:hi].tolist(), self.score[lo:hi].tolist()


def named(vectors_: list, seqs: list[int]) -> list[int]:
    """Each fact's point: the least ``seq`` with an equal vector; without a vector its own."""
    first: dict[bytes, int] = {}
    keys = [None if v is None else (np.asarray(v, float) + 0.0).tobytes() for v in vectors_]
    for k, s in zip(keys, seqs, strict=True):
        if k is not None:
            first[k] = min(s, first.get(k, s))
    return [s if k is None else first[k] for k, s in zip(keys, seqs, strict=True)]


def within(vectors_: list, seqs: list[int], threshold: float) -> Near:
    """The same edges for one history that a task holds, block by block."""
    held = {p: v for p, s, v in zip(named(vectors_, seqs), seqs, vectors_, strict=True) if p == s and v is not None}
    ids = np.array(list(held), np.int64)
    if not len(ids):
        return Near(ids, ids, np.empty(0))
    x = units(np.array([np.asarray(v, float) for v in held.values()]))
    found = []
    for lo in range(0, len(x), 512):
        i, j, score = pairs_within(x[lo : lo + 512], x, threshold)
        keep = ids[lo + i] <= ids[j]
        found.append((ids[lo + i][keep], ids[j][keep], score[keep]))
    return Near(*(np.concatenate(c) for c in zip(*found, strict=True)))
