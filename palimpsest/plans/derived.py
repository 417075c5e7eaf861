"""The engine's inputs, derived from the given tables; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors make a history; of seven in turn two are plain primaries, one is a covered primary with three
    pieces of evidence in a chain, and one is the answer row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    i, p = F.col("vec_id"), (F.col("vec_id") % 50) % 7
    return e.join(d, "vec_id").select(
        F.concat(F.lit("h"), F.floor(i / 50).cast("string")).alias("history_name"),
        i.alias("memory_id"), i.alias("seq"), "text",
        F.concat(F.lit("session_"), (F.floor((i % 50) / 10) + 1).cast("string")).alias("source_index"),
        F.format_string("2023/%02d/%02d (Mon) %02d:%02d", i % 12 + 1, i % 28 + 1, i % 24, i % 60).alias("time"),
        F.when(p.isin(3, 4, 5), "evidence").when(p == 6, "answer").when(p == 0, F.lit(None)).otherwise("primary").alias("memory_role"),
        F.when(p.isin(3, 4, 5), i - 1).alias("parent_primary"),
        F.when(p == 3, "EQUIV").when(p == 4, "ATTACH").when(p == 5, "UPDATE").alias("edge"),
        (p == 2).alias("answer_hidden"),
        F.when(p == 2, i + 4).alias("answer_id"),
        F.lit(False).alias("stale"),
        (F.floor((i % 50) / 10) + 1).cast("int").alias("session_index"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


MEMORIES = """
  memories AS (
    SELECT 'h' || CAST(e.vec_id // 50 AS VARCHAR) AS history_name, e.vec_id AS memory_id, e.vec_id AS seq, d.text AS text,
      'session_' || CAST((e.vec_id % 50) // 10 + 1 AS VARCHAR) AS source_index,
      printf('2023/%02d/%02d (Mon) %02d:%02d', e.vec_id % 12 + 1, e.vec_id % 28 + 1, e.vec_id % 24, e.vec_id % 60) AS time,
      CASE WHEN (e.vec_id % 50) % 7 IN (3, 4, 5) THEN 'evidence' WHEN (e.vec_id % 50) % 7 = 6 THEN 'answer'
           WHEN (e.vec_id % 50) % 7 = 0 THEN NULL ELSE 'primary' END AS memory_role,
      CASE WHEN (e.vec_id % 50) % 7 IN (3, 4, 5) THEN e.vec_id - 1 END AS parent_primary,
      CASE (e.vec_id % 50) % 7 WHEN 3 THEN 'EQUIV' WHEN 4 THEN 'ATTACH' WHEN 5 THEN 'UPDATE' END AS edge,
      (e.vec_id % 50) % 7 = 2 AS answer_hidden,
      CASE WHEN (e.vec_id % 50) % 7 = 2 THEN e.vec_id + 4 END AS answer_id,
      FALSE AS stale,
      CAST((e.vec_id % 50) // 10 + 1 AS INTEGER) AS session_index,
      CAST(e.embedding AS DOUBLE[]) AS embedding
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
  )"""

#: Conditions of visibility in SQL.
PRIMARY_SQL = "coalesce(memory_role, 'primary') NOT IN ('evidence', 'answer')"
VISIBLE_SQL = "(NOT stale AND (coalesce(memory_role, 'primary') = 'answer' OR (coalesce(memory_role, 'primary') <> 'evidence' AND NOT answer_hidden)))"


def questions(memories: DataFrame) -> DataFrame:
    """Every memory asks its history, with its vector and its whole text."""
    return memories.select("history_name", F.col("memory_id").alias("query_id"), F.col("embedding").alias("query"), F.col("text").alias("query_text"))


#: Scores of every question with every memory of its history.
SCORED = """
  unit AS (
    SELECT *, list_transform(embedding, lambda x: x / n) AS v
    FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM memories)
  ),
  scored AS (
    SELECT q.history_name, q.memory_id AS query_id, m.memory_id, m.seq, list_inner_product(q.v, m.v) AS score,
      m.memory_role, m.answer_hidden, m.stale, m.text, m.time, m.session_index
    FROM unit q JOIN unit m ON m.history_name = q.history_name
  )"""


def fact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``new_id, old_id, rank, old, new``: each document's text made into a new fact, against three documents of its block.

    By id modulo five the new fact repeats its document, is its first half, adds
    words, replaces a quarter of the words, or is another document.
    """
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    half, quarter = F.floor((F.size("w") + 1) / 2).cast("int"), F.floor(F.size("w") / 4).cast("int")
    other = F.array(*[F.lit(f"other{k}") for k in range(3)])
    i = F.col("doc_id") % 5
    new = F.array_join(
        F.when(i == 0, F.col("w")).when(i == 1, F.slice("w", 1, half)).when(i == 2, F.concat(F.col("w"), F.array(F.lit("moreover"), F.lit("indeed"))))
        .when(i == 3, F.concat(F.slice("w", F.lit(1), F.size("w") - quarter), F.array(F.lit("instead")))).otherwise(other), " ")
    # Texts are dealt by blocks, once; what is made of pairs afterwards stays where they are.
    d = d.withColumn("block", F.floor(F.col("doc_id") / 50)).repartition("block")
    facts = d.withColumn("w", words).where(F.size("w") > 0).select("block", F.col("doc_id").alias("new_id"), new.alias("new"))
    olds = d.select("block", F.col("doc_id").alias("old_id"), F.trim("text").alias("old"))
    rank = F.col("new_id") - F.col("old_id") + 1
    return facts.hint("merge").join(olds, "block").where(rank.between(1, 3)).select("block", "new_id", "old_id", rank.cast("int").alias("rank"), "old", "new")


PAIRS = r"""
  words AS (
    SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  ),
  facts AS (
    SELECT doc_id AS new_id, array_to_string(CASE doc_id % 5
      WHEN 0 THEN w WHEN 1 THEN w[1:(len(w) + 1) // 2] WHEN 2 THEN list_concat(w, ['moreover', 'indeed'])
      WHEN 3 THEN list_concat(w[1:len(w) - len(w) // 4], ['instead']) ELSE ['other0', 'other1', 'other2'] END, ' ') AS new
    FROM words WHERE len(w) > 0
  ),
  pairs AS (
    SELECT new_id, o.doc_id AS old_id, r.rank, trim(o.text) AS old, new
    FROM facts CROSS JOIN (SELECT unnest([1, 2, 3]) AS rank) r
    JOIN documents o ON o.doc_id = new_id - r.rank + 1 AND o.doc_id // 50 = new_id // 50 AND o.text IS NOT NULL
  ),
  sets AS (
    SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(old), '\s+'), lambda x: x <> '')) AS a,
      list_distinct(list_filter(regexp_split_to_array(lower(new), '\s+'), lambda x: x <> '')) AS b
    FROM pairs
  ),
  counted AS (SELECT *, len(list_intersect(a, b)) AS k FROM sets),
  labelled AS (
    SELECT *, CASE WHEN k = len(a) AND k = len(b) THEN 'EQV' WHEN k = len(a) THEN 'OSN' WHEN k = len(b) THEN 'NSO'
      WHEN k / (len(a) + len(b) - k) >= 0.5 THEN 'CON' ELSE 'IND' END AS label
    FROM counted
  )"""


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import relations

    return relations.labelled(fact_pairs(spark, sf_dir))
