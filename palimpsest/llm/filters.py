"""A one-hash filter of bounded size: which of many 64-bit keys may be in a set.

It never misses a key of the set and lets some others pass. Its size follows the
input's within bounds, so it may be broadcast; what passes it is decided exactly
afterwards.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Bits of a filter: 2**20 are 128 KB, 2**30 are 128 MB; bits of a page.
LEAST_BITS, MOST_BITS, PAGE = 20, 30, 16
#: Bytes of a table for each bit of a filter, as a power of 2: of its shingles, its phrases' anchors, its rows.
SHINGLES, ANCHORS, ROWS = 1, 3, 6


def bits_for(table: DataFrame, each: int) -> int:
    """Bits for keys from a table, by its size, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (runtime.size_hint(table) >> each).bit_length()))


def build(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter of a column of longs, made page by page on the executors.

    Batches are large here; callers set their own limit again.
    """
    runtime.arrow_limits(keys.sparkSession, 1 << 16)
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(bit.alias("bit")).where("bit is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            at = b["bit"].to_numpy()
            page = at >> PAGE
            order = np.argsort(page, kind="stable")
            at, page = at[order], page[order]
            cut = np.flatnonzero(np.diff(page, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(at)], strict=True):
                pages.setdefault(int(page[lo]), np.zeros(1 << PAGE, bool))[at[lo:hi] & ((1 << PAGE) - 1)] = True
        for p, flags in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["page", "flags"])

    dealt = rows.repartition(F.shiftright("bit", PAGE))
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PAGE - 3)
    for r in dealt.mapInArrow(runtime.lean(run), "page int, flags binary").collect():  # as large as the filter
        out[r["page"] * size : (r["page"] + 1) * size] = np.frombuffer(r["flags"], np.uint8)
    return out


def may_hold(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key, whether it passes the filter."""
    at = keys.astype(np.uint64) & np.uint64(8 * len(flags) - 1)
    return (flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def passes(shared: Broadcast, column: str) -> Column:
    """Whether a column of longs passes a broadcast filter; other columns of the rows stay in the JVM."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in parts:
            yield pa.array(may_hold(shared.value, keys.to_numpy()))

    # The annotations of the wrapped function tell Spark what it takes and gives.
    whole = functools.wraps(run)(runtime.lean(run, shared=(shared,)))
    return F.arrow_udf(whole, "boolean")(column)
