"""Queries of readers and builders: documents made from the tables, read as the engine reads files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair, rouge, strings
from ..operators import golden
from ..sources import episodes, store
from .derived import table


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw document for each conversation: a session for each turn, dates in several forms, one date missing."""
    t = table(spark, sf_dir, "conversations")
    k = F.col("turn") * 5 % 7
    date = F.when(F.col("turn") % 3 == 0, F.format_string("2023/%02d/%02d (Mon) 10:00", k + 1, k + 2)).when(F.col("turn") % 3 == 1, F.format_string("2023-%02d-%02d 09:30", k + 1, k + 3)).otherwise("some time")
    turn = F.struct(F.col("role"), F.col("text").alias("content"), (F.col("turn") % 2 == 0).alias("has_answer"))
    got = t.withColumn("x", F.struct("turn", date.alias("d"), F.array(turn).alias("s"))).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("l"))
    ids = F.transform("l", lambda x: F.concat(F.lit("s"), (x["turn"] % 4).cast("string")))
    return got.select(
        F.col("conv_id").cast("string").alias("question_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("t").alias("question_type"), F.lit("").alias("question_date"),
        F.slice(F.transform("l", lambda x: x["d"]), F.lit(1), F.size("l") - 1).alias("haystack_dates"), F.transform("l", lambda x: x["s"]).alias("haystack_sessions"),
        ids.alias("haystack_session_ids"), F.array(F.lit("s3"), F.lit("s1"), F.lit("none")).alias("answer_session_ids"),
    )


def raw_to_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = episodes.sessions_of_raw(_raw(spark, sf_dir))
    return got.select("history_name", F.col("session_no").cast("long").alias("session_no"), "session_date", F.md5(F.col("turns")[0]["content"]).alias("text_md5"))


def canonical_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = episodes.sessions_of_raw(_raw(spark, sf_dir))
    docs = s.groupBy(F.col("history_name").alias("history_id")).agg(F.map_from_entries(F.collect_list(F.struct("session_key", "session_date"))).alias("chat_time"), F.map_from_entries(F.collect_list(F.struct("session_key", "turns"))).alias("chat_history"))
    docs = docs.withColumns({"history_name": F.lit(""), "question_id": F.lit("")})
    got = episodes.turns(episodes.sessions_of_canonical(docs))
    return got.select("history_name", F.col("session_no").cast("long").alias("session_no"), F.col("turn").cast("long").alias("turn"), "role", F.md5("text").alias("text_md5"), "has_answer")


def evidence_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.evidence_sessions(_raw(spark, sf_dir)).select("question_id", "session_id", F.col("position").cast("long").alias("position"))


def candidate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    chunk = F.struct(
        (7 - F.col("turn")).cast("int").alias("chunk_index"), (F.col("turn") % 2).cast("int").alias("session_index"), F.lit(None).cast("int").alias("turn_start"), F.lit(None).cast("int").alias("turn_end"),
        F.lit("2023/05/20 (Sat) 05:03").alias("session_date"), F.split("text", r"\.").alias("candidate_memories"))
    docs = t.groupBy(F.col("conv_id").cast("string").alias("history_name")).agg(F.collect_list(chunk).alias("chunks"))
    got = episodes.facts(docs)
    return got.select("history_name", F.col("seq").cast("long").alias("seq"), "chunk_index", "session_index", F.md5("text").alias("text_md5"))


def aligned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("history_name")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    lists = t.select("history_name", F.transform("l", lambda x: x["turn"]).alias("ids"), F.slice(F.transform("l", lambda x: x["text"]), F.lit(1), F.size("l") - 1).alias("texts"), F.array(F.lit("session_1")).alias("source_indices"), F.lit(None).cast("array<string>").alias("times"))
    got = store.aligned(lists)
    return got.select("history_name", "memory_id", F.col("seq").cast("long").alias("seq"), F.md5("text").alias("text_md5"), "source_index", "time")


def rouge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return t.select("conv_id", "turn", F.round(rouge.best_f(F.col("text"), strings.lines(F.col("before"))), 6).alias("confidence"))


def json_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", "")).otherwise(F.concat(F.lit("so "), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", strings.json_value(repair.repaired(cut), "$.k").cast("long").alias("k"))


_S = """
  s AS (
    SELECT CAST(conv_id AS VARCHAR) AS h, turn, role, text, turn * 5 % 7 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
  ), d AS (
    SELECT *, CASE WHEN p = n THEN '' WHEN turn % 3 = 0 THEN printf('2023/%02d/%02d (Mon) 10:00', k + 1, k + 2) WHEN turn % 3 = 1 THEN printf('2023-%02d-%02d 09:30', k + 1, k + 3) ELSE 'some time' END AS date,
      CASE WHEN p = n OR turn % 3 = 2 THEN TIMESTAMP '9999-12-31 23:59:59' WHEN turn % 3 = 0 THEN make_timestamp(2023, k + 1, k + 2, 10, 0, 0) ELSE make_timestamp(2023, k + 1, k + 3, 9, 30, 0) END AS moment FROM s
  ), o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY moment, p) AS session_no FROM d)"""

QUERIES = {f.__name__: f for f in (raw_to_canonical, canonical_turns, evidence_sessions, candidate_facts, aligned_lists, rouge_confidence, json_repaired)}
ORACLE_SQL = {
    "raw_to_canonical": f"WITH {_S} SELECT h AS history_name, session_no, date AS session_date, md5(text) AS text_md5 FROM o",
    "canonical_turns": f"WITH {_S} SELECT h AS history_name, session_no, CAST(0 AS BIGINT) AS turn, role, md5(text) AS text_md5, turn % 2 = 0 AS has_answer FROM o",
    "evidence_sessions": "SELECT CAST(conv_id AS VARCHAR) AS question_id, 's' || (turn % 4) AS session_id, min(p) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE turn % 4 IN (1, 3) GROUP BY 1, 2",
    "candidate_facts": r"""
    WITH f AS (SELECT conv_id, turn, trim(unnest(string_split(text, '.')), ' ') AS x, generate_subscripts(string_split(text, '.'), 1) AS i FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS history_name, row_number() OVER (PARTITION BY conv_id ORDER BY 7 - turn, i) - 1 AS seq, CAST(7 - turn AS INTEGER) AS chunk_index, CAST(1 AS INTEGER) AS session_index, md5(x) AS text_md5 FROM f WHERE x <> ''
    """,
    "aligned_lists": """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS history_name, turn AS memory_id, p - 1 AS seq, md5(CASE WHEN p = n THEN '' ELSE text END) AS text_md5, CASE WHEN p = 1 THEN 'session_1' ELSE 'unknown' END AS source_index, 'unknown_time' AS time FROM s
    """,
    "json_repaired": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
