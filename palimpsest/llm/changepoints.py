"""Penalised change points of daily series, by best-first search over a tree of starts.

A series is cut into segments of at least ``min_days`` days so that the sum of the
segments' costs and of ``penalty`` for each cut is least. The program goes over end
days; for each, the starts of the last segment are the leaves of a tree of blocks. A
block cannot cost less than its least prefix and the cost of its shortest segment's sum
of squared errors spread over its longest one, since that sum only grows with a segment.
Blocks are opened in the order of their bounds until none is as good as the best start;
a bound is loose by what a block's days cost, so noisy series (days dearer than a cut
each) have most blocks opened.
Many series go side by side, so a step is a few numpy operations.

Sums of a day are made before anything is gathered by series, so a task holds a series'
days and never its rows.

Rows: those without a quantity or time are left out; without a key they are one series
of their own. Repeated rows count each time. Days between without rows count 0. An empty
table gives an empty result. Other columns play no part. Integers are exact: series
whose products pass 63 bits are computed with Python's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

MIN_DAYS, PENALTY = 14, 40_000
#: Children of a node, and leaves of the lowest ones (a power of two, and its exponent).
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: A cost and a number of segments share 63 bits.
SEGMENT_BITS = 20
NONE = np.int64(1 << 62)
#: Days of all series that are solved side by side.
CELLS = 1 << 18


def spread(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 + floor of the variance of n values with sum s and sum of squares q."""
    return 1 + (n * q - s * s) // (n * n)


def cost(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.asarray(n, np.int64) * np.floor(1000 * np.log(np.asarray(v, np.float64))).astype(np.int64)


class Search:
    """Series side by side, one row each, padded with zeros; ``days`` (descending) are their lengths."""

    def __init__(self, values: np.ndarray, days: np.ndarray, min_days: int, penalty: int) -> None:
        rows, width = values.shape
        self.days, self.min_days, self.penalty = days, min_days, penalty
        exact = object if width * float((values.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) >= 2**62 or float(np.abs(values.astype(np.float64)).sum(axis=1).max(initial=0)) >= 2**31 else np.int64
        padded = np.zeros((rows, width + 1), exact)
        padded[:, 1:] = values
        self.sums, self.squares = np.cumsum(padded, axis=1), np.cumsum(padded * padded, axis=1)
        self.best = np.full((rows, width), NONE)  # of the series up to a day: its cost and segments
        self.start = np.zeros((rows, width), np.int64)  # of its last segment
        self.levels = [np.full((rows, -(-width // FAN) * FAN), NONE)]  # least prefix of a start, of a block of starts, ...
        while self.levels[-1].shape[1] > FAN:
            blocks = self.levels[-1].shape[1] // FAN
            self.levels.append(np.full((rows, -(-blocks // FAN) * FAN), NONE))
        self.opened = 0

    def ready(self, k: int, i: int) -> None:
        """Segments of the first k series may start at day i from now on."""
        prefix = np.zeros(k, np.int64) if i == 0 else self.best[:k, i - 1] + (self.penalty << SEGMENT_BITS)
        for level in self.levels:
            np.minimum(level[:k, i], prefix, out=level[:k, i])
            i >>= FAN_BITS

    def segment(self, row: np.ndarray, a: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Days, sum and sum of squares from day a to day e."""
        row = row[:, None] if a.ndim > 1 else row
        return e - a + 1, self.sums[row, e + 1] - self.sums[row, a], self.squares[row, e + 1] - self.squares[row, a]

    def bounds(self, row: np.ndarray, depth: int, node: np.ndarray, last: int, e: int) -> np.ndarray:
        """What no start of these nodes can go below; of single starts (depth 0) the very costs."""
        least = self.levels[depth][row[:, None], node]
        low = np.minimum(node << (depth * FAN_BITS), last)
        high = np.minimum(((node + 1) << (depth * FAN_BITS)) - 1, last)
        n, s, q = self.segment(row, high, e)
        v = 1 + (n * q - s * s) // (n * (e - low + 1))
        return np.where(least < NONE, least + (cost(n, v) << SEGMENT_BITS) + 1, NONE)

    def end(self, k: int, e: int, last: int) -> None:
        """The best last segment that ends at day e, of the first k series; the least start of equally good ones."""
        depth = len(self.levels) - 1
        rows = np.arange(k)
        best, start = np.full(k, NONE), np.full(k, last + 1)
        used = 1 + (last >> (depth * FAN_BITS))
        first = np.broadcast_to(np.arange(used), (k, used))
        frontier, code = self.bounds(rows, depth, first, last, e), (first << 6) | depth  # bounds; numbers of nodes, and their depths
        if depth == 0:
            start = frontier.argmin(axis=1)
            best = frontier[rows, start]
        while depth:
            at = frontier.argmin(axis=1)
            least = frontier[np.arange(len(rows)), at]
            go = (least <= best[rows]) & (least < NONE)
            if not go.any():
                break
            rows, frontier, code, at = rows[go], frontier[go], code[go], at[go]
            each = np.arange(len(rows))
            top = code[each, at]
            frontier[each, at] = NONE
            self.opened += len(rows)
            down, node = (top & 63) - 1, top >> 6
            child = (node[:, None] << FAN_BITS) + np.arange(FAN)
            for d in np.unique(down):
                mine = np.flatnonzero(down == d)
                r, c = rows[mine], child[mine]
                held = np.minimum(c, last >> (int(d) * FAN_BITS))  # children beyond the last start are none
                found = np.where(held == c, self.bounds(r, int(d), held, last, e), NONE)
                if d:
                    frontier, code = _put(frontier, code, mine, found, (c << 6) | d)
                    continue
                i = found.argmin(axis=1)
                value, begin = found[np.arange(len(r)), i], c[np.arange(len(r)), i]
                better = (value < best[r]) | ((value == best[r]) & (begin < start[r]))
                best[r], start[r] = np.where(better, value, best[r]), np.where(better, begin, start[r])
        self.best[:k, e], self.start[:k, e] = best, start

    def run(self) -> None:
        least = self.min_days
        for e in range(int(self.days[0])):
            k = int(np.searchsorted(-self.days, -e, "left"))  # series that have a day e
            last = e - least + 1
            if last < 0:
                k0 = int(np.searchsorted(-self.days, -(e + 1), "left"))  # those before k that end here are one short segment
                if k0 < k:
                    n, s, q = self.segment(np.arange(k0, k), np.zeros(k - k0, np.int64), e)
                    self.best[k0:k, e] = (cost(n, spread(n, s, q)) << SEGMENT_BITS) + 1
                continue
            if last == 0 or last >= least:
                self.ready(k, last)
            self.end(k, e, last)


def _put(frontier: np.ndarray, code: np.ndarray, mine: np.ndarray, found: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children in the frontiers of their series, in places that are free there, or in new ones."""
    order = np.argsort(frontier[mine] < NONE, axis=1, kind="stable")  # free places first
    if (missing := FAN - int((frontier[mine] == NONE).sum(axis=1).min())) > 0:
        frontier = np.concatenate([frontier, np.full((len(frontier), max(missing, FAN)), NONE)], axis=1)
        code = np.concatenate([code, np.zeros((len(code), max(missing, FAN)), np.int64)], axis=1)
        order = np.argsort(frontier[mine] < NONE, axis=1, kind="stable")
    places = order[:, :FAN]
    frontier[mine[:, None], places] = found
    code[mine[:, None], places] = codes
    return frontier, code


def solve(values: list[np.ndarray], min_days: int = MIN_DAYS, penalty: int = PENALTY) -> list[list[tuple[int, int, int, int, int, int]]]:
    """For each series (ascending days, no gaps) its segments: first and number of days, sum, spread, cost; and the whole cost."""
    if not values:
        return []
    days = np.array([len(v) for v in values])
    order = np.argsort(-days, kind="stable")
    padded = np.zeros((len(values), int(days.max())), np.int64)
    for r, i in enumerate(order):
        padded[r, : days[i]] = values[i]
    search = Search(padded, days[order], min_days, penalty)
    search.run()
    out: list = [None] * len(values)
    for r, i in enumerate(order):
        e, segments = int(days[i]) - 1, []
        whole = int(search.best[r, e]) >> SEGMENT_BITS
        while e >= 0:
            a = int(search.start[r, e]) if days[i] >= min_days else 0
            n, s, q = e - a + 1, int(search.sums[r, e + 1] - search.sums[r, a]), int(search.squares[r, e + 1] - search.squares[r, a])
            v = 1 + (n * q - s * s) // (n * n)
            segments.append((a, n, s, v, int(cost(n, v)), whole))
            e = a - 1
        out[i] = segments[::-1]
    return out


SCHEMA = pa.schema([("segment_no", pa.int32())] + [(c, pa.int64()) for c in ("first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")])


def segments(rows: DataFrame, key: str, value: Column, day: Column, min_days: int = MIN_DAYS, penalty: int = PENALTY) -> DataFrame:
    """``key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost`` of every series.

    ``value`` is an integer, ``day`` a number of days; rows where either is null take no part.
    """
    spark = rows.sparkSession
    runtime.arrow_limits(spark)
    daily = rows.select(F.col(key).alias("key"), day.cast("long").alias("day"), value.cast("long").alias("value")).where("day IS NOT NULL AND value IS NOT NULL")
    daily = daily.groupBy("key", "day").agg(F.sum("value").alias("value"))
    series = daily.groupBy("key").agg(F.collect_list(F.struct("day", "value")).alias("s")).select("key", "s.day", "s.value")

    def solved(batch: pa.RecordBatch, picked: list[int], held: list[np.ndarray], firsts: list[int]) -> pa.RecordBatch:
        found = solve(held, min_days, penalty)
        keys = batch["key"].take(pa.array(np.repeat(picked, [len(x) for x in found])))
        flat = [(j + 1, f + a, n, s, v, c, len(x), whole) for f, x in zip(firsts, found, strict=True) for j, (a, n, s, v, c, whole) in enumerate(x)]
        return pa.RecordBatch.from_arrays([keys, *[pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), SCHEMA, strict=True)]], schema=pa.schema([pa.field("key", keys.type), *SCHEMA]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days, values = batch["day"], batch["value"]
            at = days.offsets.to_numpy()
            all_days, all_values = days.values.to_numpy(), values.values.to_numpy()
            cells, picked, held, firsts = 0, [], [], []
            for i in range(len(batch)):
                d, v = all_days[at[i] : at[i + 1]], all_values[at[i] : at[i + 1]]
                first = int(d.min())
                dense = np.zeros(int(d.max()) - first + 1, np.int64)
                dense[d - first] = v
                if held and (cells := cells + len(dense)) > CELLS:
                    yield solved(batch, picked, held, firsts)
                    cells, picked, held, firsts = len(dense), [], [], []
                picked.append(i)
                held.append(dense)
                firsts.append(first)
            if held:
                yield solved(batch, picked, held, firsts)

    kind = daily.schema["key"].dataType.simpleString()
    types = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in SCHEMA)
    return series.mapInArrow(runtime.lean(run), f"key {kind}, {types}").withColumnRenamed("key", key)


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(runtime.table(spark, sf_dir, "sale_lines"), "vendor_id", F.col("quantity"), F.unix_date(F.to_date("shipped_at")))


QUERIES = {"op11_change_points": op11_change_points}
#: The plain program: every start of every day, one day after the other, then back from the last day.
ORACLE_SQL = {
    "op11_change_points": """
    WITH RECURSIVE daily AS (
      SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS BIGINT) AS v
      FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
    ), span AS (
      SELECT vendor_id, min(day) AS first, max(day) AS last FROM daily GROUP BY vendor_id
    ), dense AS (
      SELECT s.vendor_id, s.first, x.day - s.first AS i, coalesce(d.v, 0) AS v
      FROM (SELECT vendor_id, first, unnest(range(first, last + 1)) AS day FROM span s) x
      JOIN span s ON s.vendor_id IS NOT DISTINCT FROM x.vendor_id
      LEFT JOIN daily d ON d.vendor_id IS NOT DISTINCT FROM x.vendor_id AND d.day = x.day
    ), sums AS (
      SELECT vendor_id, first, i, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM dense
      WINDOW w AS (PARTITION BY vendor_id ORDER BY i)
    ), series AS (
      SELECT vendor_id, any_value(first) AS first, CAST(count(*) AS BIGINT) AS n,
        list_prepend(0::HUGEINT, list(CAST(s AS HUGEINT) ORDER BY i)) AS s, list_prepend(0::HUGEINT, list(CAST(q AS HUGEINT) ORDER BY i)) AS q
      FROM sums GROUP BY vendor_id
    ), steps AS (
      SELECT vendor_id, n, s, q, CAST(0 AS BIGINT) AS e, CAST([] AS STRUCT(c BIGINT, k BIGINT, a BIGINT)[]) AS best FROM series
      UNION ALL
      SELECT vendor_id, n, s, q, e + 1, list_append(best, list_sort(list_transform(
          list_filter(range(e + 1), lambda a: (e - a >= 13 AND (a = 0 OR a >= 14)) OR (a = 0 AND n < 14)),
          lambda a: {'c': (CASE WHEN a = 0 THEN 0 ELSE best[a].c + 40000 END) + (e - a + 1) * CAST(floor(1000 * ln(CAST(
              1 + ((e - a + 1) * (q[e + 2] - q[a + 1]) - (s[e + 2] - s[a + 1]) * (s[e + 2] - s[a + 1])) // ((e - a + 1) * (e - a + 1)) AS DOUBLE))) AS BIGINT),
            'k': CASE WHEN a = 0 THEN 1 ELSE best[a].k + 1 END, 'a': a}))[1])
      FROM steps WHERE e < n
    ), done AS (
      SELECT d.vendor_id, first, d.n, d.s, d.q, best FROM steps d JOIN series x ON x.vendor_id IS NOT DISTINCT FROM d.vendor_id WHERE e = d.n
    ), back AS (
      SELECT vendor_id, first, s, q, best, best[n].k AS no, best[n].k AS segs, best[n].c AS whole, best[n].a AS a, n - 1 AS e FROM done
      UNION ALL
      SELECT vendor_id, first, s, q, best, no - 1, segs, whole, best[a].a, a - 1 FROM back WHERE a > 0
    ), cut AS (
      SELECT *, e - a + 1 AS n, s[e + 2] - s[a + 1] AS t, q[e + 2] - q[a + 1] AS u FROM back
    )
    SELECT vendor_id, CAST(no AS INTEGER) AS segment_no, CAST(first + a AS BIGINT) AS first_day, CAST(n AS BIGINT) AS n_days, CAST(t AS BIGINT) AS total,
      CAST(1 + (n * u - t * t) // (n * n) AS BIGINT) AS spread,
      CAST(n * floor(1000 * ln(CAST(1 + (n * u - t * t) // (n * n) AS DOUBLE))) AS BIGINT) AS cost, CAST(segs AS BIGINT) AS n_segments, whole AS best_cost
    FROM cut
    """
}
