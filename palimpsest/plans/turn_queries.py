"""Queries over conversations: windows, chunks, sessions, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, strings
from ..operators import windows
from .derived import table


def _windows(spark: SparkSession, sf_dir: str, size, overlap: int) -> DataFrame:
    rows = windows.turn_windows(table(spark, sf_dir, "conversations"), "conv_id", "turn", size, overlap)
    return rows.groupBy("conv_id", "start").agg(F.max("pos").cast("long").alias("end_pos"), F.count("*").alias("n_turns")).select("conv_id", F.col("start").cast("long").alias("start_pos"), "end_pos", "n_turns")


def turn_windows_g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 4, 0)


def turn_windows_g4_o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 4, 2)


def turn_windows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "all", 0)


def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3)
    return got.select("conv_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start_pos"), "n_turns")


def observation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", 4)
    text = windows.observation(F.col("conv_id"), F.lit("2023/05/20"), F.col("start"), F.col("end"), F.col("transcript"))
    return got.select("conv_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length(text).cast("long").alias("chars"), F.md5(text).alias("text_md5"))


def plain_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("turn", strings.role(F.col("role")).alias("role"), F.trim("text").alias("text"))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = windows.transcript(F.col("lines"), bold=False)
    return got.select("conv_id", F.length(text).cast("long").alias("chars"), F.md5(text).alias("text_md5"))


def session_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format("d", "yyyy/MM/dd (E) HH:mm")).when(k == 1, F.date_format("d", "yyyy/MM/dd HH:mm")).when(k == 2, F.date_format("d", "yyyy-MM-dd HH:mm")).otherwise("some day")
    rows = o.withColumn("at", dates.chat_time_or_last(said))
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("at", "o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", place.cast("long").alias("session_no"), F.date_format("at", "yyyy-MM-dd HH:mm").alias("parsed"))


def fact_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    got = d.select("doc_id", windows.merged_passes(lines, F.reverse(lines)).alias("facts"))
    return got.select("doc_id", F.size("facts").cast("long").alias("n_facts"), F.md5(F.array_join("facts", "\n")).alias("facts_md5"))


def filler_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("has_answer", F.length("text") % 7 == 0)
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.bool_or("has_answer").alias("any")).where("not any").select("conv_id", "n_turns")


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    mark = F.when(strings.role(F.col("role")) == "user", ">> ").otherwise("   ")
    got = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(mark, F.lit("["), F.col("role"), F.lit("] "), F.col("text")).alias("x")))).alias("l"))
    text = F.array_join(F.transform("l", lambda s: s["x"]), "\n")
    return got.select("conv_id", F.md5(text).alias("text_md5"))


def observation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(strings.lines(F.col("text")))).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("col")).cast("long").alias("longest"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("seen "), F.date_format("ts", "yyyy/MM/dd"), F.lit(" then")))
        .when(k == 1, F.concat(F.lit("it was on "), F.date_format("ts", "MMMM d, yyyy")))
        .when(k == 2, F.concat(F.lit("it was in "), F.date_format("ts", "MMMM yyyy")))
        .when(k == 3, F.concat(F.lit("it was in "), F.date_format("ts", "yyyy"))).otherwise("never")
    )
    return e.select("event_id", dates.date_from_text(text).alias("found"))


def consecutive_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import joins

    t = table(spark, sf_dir, "conversations")
    pairs = joins.consecutive(t, "conv_id", "turn", "text")
    return pairs.select("conv_id", "turn", F.round(strings.word_f1(F.col("old"), F.col("text")), 6).alias("f1"))


_TURNS = "t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"
_SAID = "CASE WHEN lower(role) IN ('user', 'human') THEN 'user' ELSE 'assistant' END"


def _windows_sql(size: int, stride: int) -> str:
    return f"""
    WITH {_TURNS}, n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
    w AS (SELECT conv_id, unnest(range(0, n, {stride})) AS start_pos FROM n)
    SELECT w.conv_id, w.start_pos, max(t.pos) AS end_pos, count(*) AS n_turns
    FROM w JOIN t ON t.conv_id = w.conv_id AND t.pos >= w.start_pos AND t.pos < w.start_pos + {size} GROUP BY 1, 2
    """


_WORDS = lambda x: rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda x: x <> ''))"

QUERIES = {f.__name__: f for f in (turn_windows_g4, turn_windows_g4_o2, turn_windows_all, chunk_numbering, observation_text, plain_transcript, session_sort, fact_union_distinct, filler_sessions, marked_turns, observation_lines, date_forms, consecutive_turns)}
ORACLE_SQL = {
    "turn_windows_g4": _windows_sql(4, 4),
    "turn_windows_g4_o2": _windows_sql(4, 2),
    "turn_windows_all": "SELECT conv_id, CAST(0 AS BIGINT) AS start_pos, count(*) - 1 AS end_pos, count(*) AS n_turns FROM conversations GROUP BY 1",
    "chunk_numbering": f"WITH {_TURNS} SELECT conv_id, pos // 3 AS chunk_index, (pos // 3) * 3 AS start_pos, count(*) AS n_turns FROM t GROUP BY 1, 2, 3",
    "observation_text": f"""
    WITH {_TURNS}, c AS (
      SELECT conv_id, pos // 4 AS chunk_index, min(pos) AS a, max(pos) AS b,
        coalesce(string_agg('**' || {_SAID} || '**: ' || trim(text), chr(10) || chr(10) ORDER BY pos) FILTER (WHERE trim(text) <> ''), '') AS body
      FROM t GROUP BY 1, 2
    ), o AS (SELECT *, printf('=== Session %d (2023/05/20) turns %d-%d ===', conv_id, a, b) || chr(10) || body AS text FROM c)
    SELECT conv_id, chunk_index, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM o
    """,
    "plain_transcript": f"""
    WITH c AS (SELECT conv_id, coalesce(string_agg({_SAID} || ': ' || trim(text), chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS text FROM conversations GROUP BY 1)
    SELECT conv_id, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM c
    """,
    "session_sort": r"""
    WITH s AS (
      SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d (%a) %H:%M')
        WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') ELSE 'some day' END AS said
      FROM orders
    ), p AS (
      SELECT *, coalesce(try_strptime(trim(regexp_replace(regexp_replace(said, '\([^)]*\)', ' '), '\s+', ' ', 'g')), ['%Y/%m/%d %H:%M', '%Y-%m-%d %H:%M']), TIMESTAMP '9999-12-31 23:59:59') AS moment FROM s
    )
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY moment, o_orderkey) AS session_no, strftime(moment, '%Y-%m-%d %H:%M') AS parsed FROM p
    """,
    "fact_union_distinct": """
    WITH l AS (SELECT doc_id, i, trim(x, ' ') AS x FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
    f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY 1, 2)
    SELECT d.doc_id, count(f.x) AS n_facts, md5(coalesce(string_agg(f.x, chr(10) ORDER BY f.i), '')) AS facts_md5
    FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1
    """,
    "filler_sessions": "SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1 HAVING NOT bool_or(length(text) % 7 = 0)",
    "marked_turns": f"SELECT conv_id, md5(string_agg(CASE WHEN {_SAID} = 'user' THEN '>> ' ELSE '   ' END || '[' || role || '] ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1",
    "observation_lines": """
    WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS x FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, count(*) AS n_lines, CAST(max(length(x)) AS BIGINT) AS longest FROM l WHERE x <> '' GROUP BY 1)
    SELECT doc_id, coalesce(n_lines, 1) AS n_lines, coalesce(longest, CAST(length(text) AS BIGINT)) AS longest
    FROM documents LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL
    """,
    "date_forms": """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y/%m/%d') WHEN 1 THEN strftime(ts, '%B %-d, %Y')
      WHEN 2 THEN strftime(ts, '%B %Y') WHEN 3 THEN strftime(ts, '%Y') END AS found FROM events
    """,
    "consecutive_turns": f"""
    WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
    s AS (SELECT conv_id, turn, {_WORDS("old")} AS a, {_WORDS("text")} AS b FROM p WHERE old IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM s
    """,
}
