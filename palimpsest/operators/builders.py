"""Dataset construction: selection, distractors, lowering, statistics, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings


def hybrid_selected(status: Column, correct: Column, lowered: Column, original: Column) -> Column:
    """The lowered facts of partly lowered items that are still answered, else the original ones."""
    return F.when((status == "partial") & F.coalesce(correct, F.lit(False)), lowered).otherwise(original)


def lowered(candidates: DataFrame, key: str) -> DataFrame:
    """Of rewrites (text, sim) that still give the answer, the least similar one for each fact; facts without one are left out."""
    return candidates.where("ok").groupBy(key).agg(F.min_by("text", F.struct("sim", "text")).alias("text"), F.min("sim").alias("min_sim"))


def distractors(candidates: DataFrame, key: str, count: int = 8) -> DataFrame:
    """Exactly ``count`` distinct texts for each item, above its least lowered similarity; items with fewer have none.

    ``candidates``: key, seq, text, sim, min_sim, answer. A text as similar as the
    least one does not pass, nor one that gives the answer away.
    """
    passed = candidates.where((F.col("sim") > F.col("min_sim")) & ~strings.leaks(F.col("text"), F.col("answer")))
    once = passed.withColumn("_n", F.row_number().over(W.partitionBy(key, "text").orderBy("seq"))).where("_n = 1")
    first = once.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("seq"))).where(F.col("place") <= count)
    full = F.count("*").over(W.partitionBy(key))
    return first.withColumn("_full", full).where(F.col("_full") == count).drop("_n", "_full")


def prefix(items: Column, n: int) -> Column:
    """The first n entries."""
    return F.slice(items, 1, n)


def overview(items: DataFrame, type_column: str) -> DataFrame:
    """Items and facts of each type, and of all (``ALL``)."""
    got = items.groupingSets([[type_column], []], type_column).agg(F.count("*").alias("items"), F.sum("facts").alias("facts"), F.max("facts").alias("most"), F.grouping(type_column).alias("g"))
    return got.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(type_column)).alias(type_column), "items", "facts", "most")


def histogram(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("items"))


def build_stats(items: DataFrame, by: list[str]) -> DataFrame:
    """Success rate, mean drop of similarity and mean similarity, by group."""
    return items.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.avg(F.when(F.col("ok"), F.col("before") - F.col("after"))).alias("mean_drop"), F.avg(F.when(F.col("ok"), F.col("after"))).alias("mean_after"))


def similarity_stats(sims: DataFrame, by: list[str]) -> DataFrame:
    return sims.groupBy(*by).agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.median("sim").alias("median"), F.min("sim").alias("least"), F.max("sim").alias("most"))


def ingest_stats(log: DataFrame) -> DataFrame:
    """Facts submitted, operations, admitted and rejected, by history."""
    return log.groupBy("history_name").agg(F.count("*").alias("submitted"), F.count_if("row_op").alias("row_ops"), F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))


def chain_summary(chains: DataFrame, by: str) -> DataFrame:
    """Chains, their mean length and how many relations of each kind, by type."""
    return chains.groupBy(by).agg(F.count_distinct("chain").alias("chains"), F.count("*").alias("steps"), (F.count("*") / F.count_distinct("chain")).alias("mean_steps"), *[F.count_if(F.col("label") == x).alias(x.lower()) for x in strings.LABELS])
