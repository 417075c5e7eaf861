"""Logical joins of the experiment: resume, gates, filters, date matching, sampling, sweeps."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pending(all_rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return all_rows.join(done.select(*key), key, "left_anti")


def ready(rows: DataFrame, markers: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose marker matches in every field."""
    return rows.join(markers.select(*key), key, "left_semi")


def question_types(given: str | None) -> list[str]:
    """A comma list; empty: no filter."""
    return list(dict.fromkeys(x.strip() for x in (given or "").split(",") if x.strip()))


def of_types(questions: DataFrame, types: list[str]) -> DataFrame:
    return questions.where(F.col("question_type").isin(*types)) if types else questions


def histories_of_types(histories: DataFrame, questions: DataFrame, types: list[str]) -> DataFrame:
    """Histories with a question of the types."""
    return histories.join(of_types(questions, types).select("history_name"), "history_name", "left_semi")


def without_sessions(chunks: DataFrame, answer_sessions: DataFrame, key: list[str]) -> DataFrame:
    """Chunks of other sessions than those that hold the answer."""
    return chunks.join(answer_sessions.select(*key), key, "left_anti")


def matched_by_date(chunks: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Facts put into the first chunk of their date, or into new chunks after the last.

    ``chunks``: key, chunk_index, date. ``extra``: key, date, fact. New chunks
    are numbered by date.
    """
    dates = extra.select(key, "date").distinct()
    met = chunks.join(dates.select(key).distinct(), key, "left_semi")
    first = met.groupBy(key, "date").agg(F.min("chunk_index").alias("chunk_index"))
    top = met.groupBy(key).agg(F.max("chunk_index").alias("_top"))
    both = dates.join(first, [key, "date"], "left").join(top, key, "left")
    # Only the different dates are numbered, so no task sorts the facts of a key.
    new = F.dense_rank().over(W.partitionBy(key, F.col("chunk_index").isNull()).orderBy("date"))
    index = F.coalesce(F.col("chunk_index"), F.coalesce("_top", F.lit(-1)) + new)
    placed = both.select(F.col(key).alias("_key"), F.col("date").alias("_date"), index.alias("chunk_index"), F.col("chunk_index").isNull().alias("is_new"))
    return extra.join(placed, F.col(key).eqNullSafe(F.col("_key")) & F.col("date").eqNullSafe(F.col("_date"))).drop("_key", "_date")


def older_pairs(facts: DataFrame, key: str, pos: str, date: str, text: str) -> DataFrame:
    """Every unordered pair of facts of a question, the older as ``old``; ties by place."""
    a = facts.select(key, F.col(pos).alias("pa"), F.col(date).alias("da"), F.col(text).alias("ta"))
    b = facts.select(key, F.col(pos).alias("pb"), F.col(date).alias("db"), F.col(text).alias("tb"))
    pairs = a.join(b, key).where("pa < pb")
    old = F.col("da") <= F.col("db")
    pick = lambda x, y: F.when(old, F.col(x)).otherwise(F.col(y))
    return pairs.select(key, pick("pa", "pb").alias("old_pos"), pick("pb", "pa").alias("new_pos"), pick("ta", "tb").alias("old"), pick("tb", "ta").alias("new"))


def consecutive(facts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each fact with the one before it."""
    return facts.withColumn("old", F.lag(text).over(W.partitionBy(key).orderBy(order))).where("old is not null")


def quotas(counts: DataFrame, n: int) -> DataFrame:
    """``question_type, size, quota``: largest remainders, ties by name; all rows if n is not below them or not positive."""
    total = F.sum("size").over(W.partitionBy())
    ideal = n * F.col("size") / total
    rows = counts.withColumns({"total": total, "floor": F.floor(ideal).cast("long"), "frac": ideal - F.floor(ideal)})
    rows = rows.withColumn("left", n - F.sum("floor").over(W.partitionBy()))
    place = F.row_number().over(W.orderBy(F.desc(F.round("frac", 9)), "question_type"))
    quota = F.when((F.lit(n) <= 0) | (F.col("total") <= n), F.col("size")).otherwise(F.col("floor") + F.when(place <= F.col("left"), 1).otherwise(0))
    return rows.select("question_type", "size", quota.cast("long").alias("quota"))


def stratified(items: DataFrame, n: int, seed: int) -> DataFrame:
    """``history_name, question_id, question_type``: a sample of n keys with the pool's shares of types.

    Types have quotas; within a type the keys with the least seeded hash are taken.
    Only the number of types reaches a single task.
    """
    keys = items.groupBy("history_name", "question_id").agg(F.min(F.coalesce(F.nullif("question_type", F.lit("")), F.lit("unknown"))).alias("question_type"))
    quota = quotas(keys.groupBy("question_type").agg(F.count("*").alias("size")), n)
    place = F.row_number().over(W.partitionBy("question_type").orderBy(F.xxhash64(F.lit(seed), "history_name", "question_id"), "history_name", "question_id"))
    return keys.withColumn("place", place).join(F.broadcast(quota), "question_type").where("place <= quota").select("history_name", "question_id", "question_type")


def stratified_local(items: list[tuple[tuple[str, str], str | None]], n: int, seed: int) -> set[tuple[str, str]]:
    """The same on the driver, for lists that fit, with Python's generator instead of hashes."""
    first = dict(reversed([(k, t or "unknown") for k, t in items]))
    if n <= 0 or len(first) <= n:
        return set(first)
    pools: dict[str, list[tuple[str, str]]] = {}
    for k, t in sorted(first.items()):
        pools.setdefault(t, []).append(k)
    ideal = {t: n * len(p) / len(first) for t, p in sorted(pools.items())}
    quota = {t: int(x) for t, x in ideal.items()}
    for t in sorted(ideal, key=lambda t: (quota[t] - ideal[t], t))[: n - sum(quota.values())]:
        quota[t] += 1
    draw = random.Random(seed)
    return {k for t in quota for k in draw.sample(pools[t], quota[t])}


def variants(spark: SparkSession, limits: list[int], repeats: int, seeds: list[int] | None = None, base: int = 0) -> DataFrame:
    """Token limits (outer) times repeats (inner), with ids."""
    if any(x <= 0 for x in limits) or repeats < 1 or (seeds and len(seeds) != repeats):
        raise ValueError("limits are positive, there is a repeat, and a seed for each if seeds are given")
    a = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(limits))], "outer int, token_limit int")
    return swept(a, "outer", seeds or [base + j for j in range(repeats)])


def swept(limits: DataFrame, order: str, seeds: list[int]) -> DataFrame:
    """Each ``token_limit`` of a table, in order, with each seed."""
    rows = limits.select(order, "token_limit", F.posexplode(F.array(*map(F.lit, seeds))).alias("repeat", "seed"))
    place = F.row_number().over(W.orderBy(order, "repeat"))
    return rows.select(place.alias("place"), F.format_string("tl%d-r%02d-s%d", "token_limit", "repeat", "seed").alias("variant_id"), "token_limit", "repeat", "seed")


def renumbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Dense temporary ids from 0 within groups."""
    return rows.withColumn("temp_id", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
