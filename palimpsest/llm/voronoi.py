"""Exact top-k inner products by a Voronoi kNN join.

Pivots split the space into cells. Summaries of each cell (how many vectors, the
greatest distance to the pivot, the k + 1 ids nearest to it) and of each group of
queries (their greatest distance to the pivot, their greatest norm) bound the
scores that a group can reach in a cell from above, and its k-th best score from
below. A query goes only to the cells that can hold one of its best; cells and
queries are dealt in blocks of bounded size, a block of a cell is sent only to
the blocks of queries that ask for it, and each meeting keeps k rows for a query.

Rows: vectors that are null, empty, or hold null or non-finite components, and
rows without an id, take no part. Vectors of another length than the query's are
no candidates; lengths beyond the ``LENGTHS`` commonest are one cell each, without
bounds. Each repeated row is a candidate of its own, but rows with the
query's id are not; an id that is repeated asks once, with its smallest vector.
Equal scores go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import runtime

#: Pivots of a length, as many as the square root of its rows over 4 within these bounds, and lengths with pivots; all are collected and broadcast.
PIVOTS, MOST_PIVOTS, LENGTHS = 64, 512, 256
#: Rows of a block, of queries or of a cell; routed rows that are sent together.
BLOCK, ROUTED = 16384, 8192
K, GRID = 10, 1024.0
#: Components of pivots at most, over all lengths.
PIVOT_VALUES = 1 << 22


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integral(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` with floor(1024 * x) of every component, for usable vectors."""
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * GRID).cast("double"))
    return runtime.need(rows, "vec_id", "embedding").where("embedding is not null").where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def choose_pivots(rows: DataFrame, least: int = PIVOTS, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """By vector length, for the commonest lengths, the pivots: the first vectors by a hash of the id."""
    keyed = rows.withColumn("d", F.size("v")).withColumn("h", F.xxhash64("vec_id"))
    common = keyed.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    room = PIVOT_VALUES // max(1, len(common))
    want = {r["d"]: min(most, max(least, int(r["n"] ** 0.5) // 4), max(1, room // r["d"])) for r in common if r["d"] <= room}
    if not want:
        return {}
    order = W.partitionBy("d").orderBy("h", "vec_id", "v")
    limit = F.create_map(*[F.lit(x) for pair in want.items() for x in pair])[F.col("d")]
    found = keyed.where(F.col("d").isin(list(want))).withColumn("i", F.row_number().over(order)).where(F.col("i") <= max(want.values())).where(F.col("i") <= limit).select("d", "v").collect()
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["d"], []).append(r["v"])
    return {d: np.unique(np.array(v), axis=0) for d, v in by.items()}


def assign(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``d`` (length), ``cell`` (nearest pivot) and ``dist`` to it; -1 and 0 for a length without pivots."""
    runtime.arrow_limits(rows.sparkSession, 4096)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b["v"].offsets.to_numpy())
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                x = _matrix(part["v"])
                cell, dist = np.full(len(x), -1), np.zeros(len(x))
                if (p := shared.value.get(int(d))) is not None:
                    gap = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)
                    cell = gap.argmin(1)
                    dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(np.full(len(x), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["vec_id", "v", "d", "cell", "dist"])

    return rows.mapInArrow(runtime.lean(run), "vec_id long, v array<double>, d int, cell int, dist double")


def summaries(cells: DataFrame, k: int) -> pd.DataFrame:
    """For each cell its size, radius and k + 1 nearest ids with their distances: a bounded number of rows.

    An id counts once in a cell, by its nearest row, so k are left without a query's own id.
    """
    order = W.partitionBy("d", "cell").orderBy("dist", "vec_id")
    once = cells.groupBy("d", "cell", "vec_id").agg(F.min("dist").alias("dist"))
    pair = F.sort_array(F.collect_list(F.struct("dist", "vec_id")))
    near = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("d", "cell").agg(pair.alias("m"))
    near = near.select("d", "cell", F.col("m.dist").alias("near"), F.col("m.vec_id").alias("near_ids"))
    return cells.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).join(near, ["d", "cell"]).toPandas()


def needed_cells(own: pd.DataFrame, groups: pd.DataFrame, pivots: np.ndarray, k: int) -> dict[int, list[int]]:
    """For each group of queries the cells that can hold one of their k best, from summaries alone."""
    out: dict[int, list[int]] = {}
    cell = own["cell"].to_numpy()
    p = pivots[cell]
    norm = np.sqrt((p * p).sum(1))
    ids = np.concatenate([np.asarray(x) for x in own["near_ids"]])
    for g in groups.itertuples():
        dot, reach = p @ pivots[g.cell], g.radius * norm
        upper = dot + reach + g.norm * own["radius"].to_numpy()
        lower = np.concatenate([d - r - g.norm * np.asarray(near) for d, r, near in zip(dot, reach, own["near"], strict=True)])
        down = np.argsort(-lower, kind="stable")
        lower = lower[down[np.sort(np.unique(ids[down], return_index=True)[1])]]  # the greatest of each id
        bound = lower[k] if len(lower) > k else -np.inf  # one more than k: a query's own id is no candidate
        out[g.cell] = cell[upper >= bound - 1e-6 * (1 + abs(bound))].tolist()
    return out


def route(queries: DataFrame, own: pd.DataFrame, pivots: dict[int, np.ndarray], reach: dict[tuple[int, int], list[int]], k: int) -> DataFrame:
    """A row for each query and block of a cell that its own bounds cannot rule out."""
    shared = queries.sparkSession.sparkContext.broadcast((own, pivots, reach))
    names = ["query_id", "q", "d", "cell", "part", "block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_of, piv, cells_of = shared.value
        by = {d: x.set_index("cell") for d, x in all_of.groupby("d")}
        ids_of = {d: np.concatenate([np.asarray(m) for m in x["near_ids"]]) for d, x in by.items()}
        for pdf in batches:
            rows = []
            for q in pdf.itertuples():
                s, v = by[q.d], np.asarray(q.v)
                length, dot = np.sqrt(v @ v), piv[q.d][s.index] @ v
                lower = np.concatenate([x - length * np.asarray(near) for x, near in zip(dot, s["near"], strict=True)])
                lower = lower[ids_of[q.d] != q.vec_id]
                bound = np.sort(lower)[-k] if len(lower) >= k else -np.inf
                upper = dict(zip(s.index, dot + length * s["radius"], strict=True))
                for c in cells_of[q.d, q.cell]:
                    if upper[c] >= bound - 1e-6 * (1 + abs(bound)):
                        rows += [(q.vec_id, q.v, q.d, c, j, q.block) for j in range(-(-int(s.at[c, "n"]) // BLOCK))]
                if len(rows) >= ROUTED:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return queries.mapInPandas(run, "query_id long, q array<double>, d int, cell int, part int, block int")


def _solve(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of one block for each query of another."""
        out = [np.empty((3, 0), np.int64)]
        if len(left) and len(right):
            asked, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = _matrix(right["v"])[order], ids[order]
            all_q = _matrix(left["q"])
            for lo in range(0, len(left), 256):
                q = all_q[lo : lo + 256]
                exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2**53
                scores = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T
                for i, qid in enumerate(asked[lo : lo + 256]):
                    s = scores[i]
                    mine = np.flatnonzero(ids != qid)
                    if len(mine) > k:  # rows below the k-th best score cannot count
                        mine = mine[s[mine] >= np.partition(s[mine], -k)[-k]]
                    best = mine[np.argsort(-s[mine], kind="stable")[:k]]
                    out.append(np.stack([np.full(len(best), qid), ids[best], s[best]]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), np.concatenate(out, axis=1), strict=True)))

    return run


def topk_join(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k greatest inner products of each query.

    ``is_query`` is a condition on ``vec_id``; every row is a candidate.
    """
    spark = vectors.sparkSession
    rows = integral(vectors)
    pivots = choose_pivots(rows)
    cells = runtime.written(assign(rows, pivots), "voronoi-cells")
    own = summaries(cells.where("cell >= 0"), k)
    asked = cells.where(is_query).groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("d"), "v", "cell", "dist")).alias("s")).select("vec_id", "s.*")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    groups = asked.where("cell >= 0").groupBy("d", "cell").agg(F.max("dist").alias("radius"), F.max(norm).alias("norm")).toPandas()
    reach = {(d, g): c for d in pivots for g, c in needed_cells(own[own["d"] == d], groups[groups["d"] == d], pivots[d], k).items()}
    sizes = runtime.written(cells.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "cell-sizes")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    unbounded = asked.where("cell < 0").join(sizes, ["d", "cell"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "d", "cell", every, "block")
    left = runtime.written(route(asked.where("cell >= 0"), own, pivots, reach, k).unionByName(unbounded), "routed-queries")
    # A block of a cell is sent where a query asks for it, and nowhere else.
    wanted = runtime.reread(left).select("d", "cell", "part", "block").distinct()
    dealt = runtime.reread(cells).join(runtime.reread(sizes), ["d", "cell"]).select("vec_id", "v", "d", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    right = dealt.join(wanted, ["d", "cell", "part"])
    key = ["d", "cell", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join(runtime.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op7_voronoi_topk": op7_voronoi_topk}
ORACLE_SQL = {
    "op7_voronoi_topk": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
      WHERE q.vec_id % 100 = 0
    ), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
}
