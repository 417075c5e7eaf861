"""The offline rule of operations (``folds.first_words``) over tables: no task holds a history.

A fact is an UPDATE of the one memory with its first three words, or NONE if that memory has its text,
or else an ADD. So what a fact does depends only on the fact with these words before it,
and a memory's number on how many were added before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings

#: Numbers of facts (``seq``) that are counted in one task.
SPAN = 65_536


def _operations(facts: DataFrame, kept: Column) -> DataFrame:
    """Facts that are not blank, each with its operation; ``kept`` of the trimmed text goes on as ``text``, the rest as a hash."""
    rows = facts.withColumn("text", F.trim("text")).where("text <> ''")
    head = F.array_join(F.slice(strings.tokens(F.col("text")), 1, 3), " ")
    rows = rows.select("history_name", "seq", "time", F.sha2(head, 256).alias("head"), F.sha2("text", 256).alias("hash"), kept.alias("text"))
    before = F.lag("hash").over(W.partitionBy("history_name", "head").orderBy("seq", "hash"))
    return rows.withColumn("op", F.when(before.isNull(), "ADD").when(before == F.col("hash"), "NONE").otherwise("UPDATE"))


def _added(rows: DataFrame, add: Column) -> DataFrame:
    """``held``: how many rows of the history with ``add`` are not after each row by ``seq``; a task counts ``SPAN`` numbers."""
    span = F.floor(F.col("seq") / SPAN).alias("_span")
    sums = rows.groupBy("history_name", span).agg(F.sum(add.cast("long")).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("history_name").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("history_name", "_span", before.alias("_before"))
    within = F.sum(add.cast("long")).over(W.partitionBy("history_name", "_span").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("_span", span).withColumn("_within", within)
    same = F.col("a.history_name").eqNullSafe(F.col("b.history_name")) & (F.col("a._span") == F.col("b._span"))
    return placed.alias("a").join(starts.alias("b"), same).select("a.*", (F.col("_before") + F.col("_within")).alias("held")).drop("_span", "_within")


def log(facts: DataFrame) -> DataFrame:
    """``history_name, seq, op, held``: the rows of ``folds.operate``. ``facts``: history_name, seq, text, time."""
    rows = _operations(facts, F.lit(None).cast("string")).select("history_name", "seq", "op")
    return _added(rows, F.col("op") == "ADD").select("history_name", "seq", "op", "held")


def left(facts: DataFrame, kept: Column | None = None) -> DataFrame:
    """``history_name, memory_id, seq, text, time, source``: the rows of ``folds.operated``; ``kept`` may stand for the text."""
    rows = _operations(facts, F.col("text") if kept is None else kept).where("op <> 'NONE'")
    last = F.max(F.struct("seq", "hash", "text", "time"))
    held = rows.groupBy("history_name", "head").agg(F.min("seq").alias("seq"), last.alias("l"), F.count("*").alias("n"))
    told = held.select("history_name", "seq", "l.text", F.coalesce("l.time", F.lit("")).alias("time"), F.when(F.col("n") > 1, "updated").otherwise("added").alias("source"))
    return _added(told, F.lit(True)).select("history_name", (F.col("held") - 1).alias("memory_id"), "seq", "text", "time", "source")
