"""Turns into windows, chunks and observation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings


def check_windows(size: int | str, overlap: int = 0) -> tuple[int | None, int]:
    """Size (None: all turns) and overlap, or an error."""
    if size == "all":
        return None, 0
    if not str(size).isdigit() or int(size) < 1:
        raise ValueError(f"granularity is 'all' or a positive number, not {size!r}")
    if not 0 <= overlap < int(size):
        raise ValueError("the overlap is less than the granularity and not negative")
    return int(size), overlap


def turn_windows(turns: DataFrame, key: str, order: str, size: int | str, overlap: int = 0) -> DataFrame:
    """Each turn once for every window that holds it: adds ``pos``, ``start``.

    Windows start at every multiple of size - overlap below the number of turns,
    so the last ones may lie within the one before. A turn knows its windows from
    its own place, so turns are shuffled once, by key, and never joined.
    """
    n, o = check_windows(size, overlap)
    placed = turns.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)
    if n is None:
        return placed.withColumn("start", F.lit(0))
    stride = n - o
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - n + 1) / stride)).cast("int")
    last = F.floor(F.col("pos") / stride).cast("int")
    return placed.withColumn("start", F.explode(F.transform(F.sequence(first, last), lambda k: k * stride)))


def transcript(rows_in_order: Column, bold: bool) -> Column:
    """Lines of structs (role, text): with bold roles and blank lines between, or plain."""
    line = (lambda r: F.concat(F.lit("**"), r["role"], F.lit("**: "), r["text"])) if bold else (lambda r: F.concat(r["role"], F.lit(": "), r["text"]))
    said = F.filter(rows_in_order, lambda r: r["text"] != "")
    return F.array_join(F.transform(said, line), "\n\n" if bold else "\n")


def chunks(turns: DataFrame, key: str, order: str, size: int | str, overlap: int = 0) -> DataFrame:
    """``key, chunk_index, start, end, n_turns, transcript`` with chunks numbered from 0."""
    rows = turn_windows(turns, key, order, size, overlap)
    line = F.struct("pos", strings.role(F.col("role")).alias("role"), F.trim("text").alias("text"))
    got = rows.groupBy(key, "start").agg(F.max("pos").alias("end"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(line)).alias("lines"))
    number = F.row_number().over(W.partitionBy(key).orderBy("start")) - 1
    return got.select(key, number.alias("chunk_index"), "start", "end", "n_turns", transcript(F.col("lines"), bold=True).alias("transcript"))


def observation(session: Column, date: Column, first: Column, last: Column, text: Column) -> Column:
    """A chunk's transcript under its header."""
    head = F.format_string("=== Session %d (%s) turns %d-%d ===", session, date, first, last)
    return F.concat_ws("\n", head, text)


def merged_passes(*passes: Column) -> Column:
    """Facts of several passes over a chunk: trimmed, blanks dropped, the first of equal ones kept."""
    facts = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in passes]))
    return F.array_distinct(F.filter(F.transform(facts, lambda x: F.trim(x)), lambda x: x != ""))
