"""Queries of evaluation, sampling, resume and dataset construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings, vectors
from ..operators import builders, joins, metrics
from . import construction
from .derived import PAIRS, labelled_pairs, table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    return j.select(F.col("source").alias("history_name"), F.col("doc_id").cast("string").alias("question_id"), F.col("lang").alias("question_type"), (F.col("quality") == 1).alias("is_correct"), (F.col("toxic") == 1).alias("judge_api_failed"))


def _gold_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lang = table(spark, sf_dir, "labels").join(d, "doc_id")
    pred = F.when(F.col("quality") == 0, "en").when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("lang"))
    return lang.select("doc_id", F.col("lang").alias("gold"), pred.alias("pred"))


def judge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judge_metrics(_judged(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def judge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.select(F.col("source").alias("history_name"), F.col("doc_id").cast("string").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, True).alias("is_correct"), F.lit(None).cast("boolean").alias("judge_api_failed"))
    new = _judged(spark, sf_dir).withColumn("is_correct", F.when(~F.col("judge_api_failed"), F.col("is_correct")))
    return metrics.merged(old, new).select("history_name", "question_id", "is_correct", "judge_api_failed")


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    tail = F.when(k == 0, "\nFinal answer: yes").when(k == 1, "\nAnswer - NO.").when(k == 2, "\nYes.").when(k == 3, "\nno !").when(k == 4, "<think>Final answer: yes</think>\nperhaps")
    said = F.concat(F.coalesce("text", F.lit("")), F.coalesce(tail, F.lit("")))
    said = F.when(k == 5, F.concat(F.lit("yes, because "), said)).otherwise(said)
    return table(spark, sf_dir, "documents").select("doc_id", strings.verdict(said).alias("correct"))


def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    said = F.when(k == 0, F.concat(F.lit("<think> a plan </think> "), t)).when(k == 1, F.concat(F.lit("<Thinking>one</Thinking> mid <think>two</think> "), t)).when(k == 2, F.concat(F.lit("<think> </think> "), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", strings.thinking(said).alias("thinking"), F.md5(strings.after_thinking(said)).alias("rest_md5"))


def relation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    label = F.element_at(F.array(*[F.lit(x) for x in strings.LABELS]), (F.col("event_id") % 5 + 1).cast("int"))
    said = (
        F.when(k == 0, F.concat(F.lit('{"relation": "'), label, F.lit('"}'))).when(k == 1, F.concat(F.lit('```json\n{"relation": " '), F.lower(label), F.lit(' "}\n```')))
        .when(k == 2, F.concat(F.lit("it is "), label, F.lit(" here"))).when(k == 3, F.concat(F.lit('so {"relation": "'), label, F.lit('"} then')))
        .when(k == 4, '{"relation": "maybe"}').otherwise("nothing said")
    )
    return table(spark, sf_dir, "events").select("event_id", strings.relation_strict(said).alias("strict"), strings.relation_loose(said).alias("loose"), strings.relation_word(said).alias("word"))


def json_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 1, F.concat(F.lit("well: "), F.col("props"), F.lit(" ok"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", strings.json_value(said, "$.k").cast("long").alias("k"))


def repeat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = metrics.judge_metrics(_judged(spark, sf_dir).withColumn("question_type", F.col("history_name"))).where("question_type <> 'ALL'")
    runs = j.withColumn("grp", F.when(F.length("question_type") > 4, "long").otherwise("short"))
    got = metrics.repeats(runs, ["grp"])
    return got.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sample_std", "judged_mean", "failed_mean")], "judged_sum", "failed_sum")


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.report(_gold_pred(spark, sf_dir))
    return got.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_gold_pred(spark, sf_dir), ["de", "en", "es", "fr", "it"])


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").select(F.col("quality").alias("gold"), F.col("toxic").alias("pred"))
    return metrics.kappa(pairs).select("n", *[F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")])


def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    named = [o.select(F.col("o_orderkey").alias("item"), F.lit(m).alias("model"), x.alias("label")) for m, x in (("a", F.col("o_orderstatus")), ("b", F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus"))), ("c", F.when(F.col("o_custkey") % 3 == 0, "O").otherwise(F.col("o_orderstatus"))))]
    got = metrics.agreement(named[0].unionByName(named[1]).unionByName(named[2]), "item", "model", "label")
    return got.select("model_a", "model_b", "n", F.round("po", 6).alias("po"), F.round("kappa", 6).alias("kappa"))


def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.errors(_gold_pred(spark, sf_dir))
    return got.select("gold", "pred", "n", F.col("place").cast("long").alias("place"), "wrong")


def cot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _gold_pred(spark, sf_dir)
    cot = base.withColumn("pred", F.when(F.col("doc_id") % 2 == 0, F.col("gold")).otherwise(F.col("pred")))
    f1 = lambda df, n: metrics.report(df).where("length(class) = 2").select("class", F.col("f1").alias(n))
    return f1(base, "plain").join(f1(cot, "cot"), "class").select("class", F.round(F.col("cot") - F.col("plain"), 6).alias("delta"))


def pairwise_relations_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("rank") == 1, "same").otherwise("near")
    return metrics.distribution(labelled_pairs(spark, sf_dir).withColumn("kind", kind), "kind", "label").select("kind", "label", "n", "ratio")


def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_pairs(spark, sf_dir).withColumns({"chain": F.floor(F.col("new_id") / 50), "kind": F.when(F.col("rank") == 1, "same").otherwise("near")})
    got = builders.chain_summary(rows, "kind")
    return got.withColumn("mean_steps", F.round("mean_steps", 6))


def older_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("at", F.col("turn") * 7 % 5)
    got = joins.older_pairs(t, "conv_id", "turn", "at", "text")
    return got.select("conv_id", "old_pos", "new_pos", F.length("old").cast("long").alias("old_chars"), F.length("new").cast("long").alias("new_chars"))


def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("lang", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("facts"))
    return builders.overview(items, "lang")


def golden_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("facts"))
    return builders.histogram(items, "facts")


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", (F.col("quality") == 1).alias("ok"), (F.col("n_chars") / 1000).alias("before"), (F.col("n_chars") / 2000).alias("after"))
    got = builders.build_stats(rows, ["lang"])
    return got.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("success_rate", "mean_drop", "mean_after")])


def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", vectors.cosine(F.col("embedding").cast("array<double>"), F.reverse(F.col("embedding").cast("array<double>"))).alias("sim"))
    got = builders.similarity_stats(e, ["label"])
    return got.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")])


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("history_name"), (F.col("event_type") != "view").alias("row_op"), (F.coalesce("value", F.lit(0.0)) >= 50).alias("admitted"))
    return builders.ingest_stats(log)


def hybrid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    status = F.when(F.col("doc_id") % 2 == 0, "partial").otherwise("full")
    picked = builders.hybrid_selected(status, F.col("quality") == 1, F.concat(F.lit("low: "), "lang"), F.col("lang"))
    return rows.select("doc_id", picked.alias("picked"))


def lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("text"), F.col("l_discount").alias("sim"), (F.col("l_returnflag") != "R").alias("ok"))
    got = builders.lowered(rows, "fact")
    return got


def distractor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("item"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
        F.col("l_discount").alias("sim"), F.lit(0.04).alias("min_sim"), F.lit("part 1").alias("answer"))
    got = builders.distractors(rows, "item", 8)
    return got.select("item", F.col("place").cast("long").alias("place"), "text")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def ready_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"))
    return joins.ready(table(spark, sf_dir, "orders"), mark, ["o_orderkey", "o_orderstatus"]).select("o_orderkey", "o_orderstatus")


def question_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("history_name"), F.col("lang").alias("question_type"), "doc_id")
    got = joins.histories_of_types(d.select("history_name").distinct(), d, joins.question_types(" es , fr,es"))
    return joins.of_types(d, ["es", "fr"]).join(got, "history_name", "left_semi").select("history_name", "doc_id")


def filler_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    answers = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4 + 1).cast("int").alias("l_linenumber"))
    return joins.without_sessions(chunks, answers, ["l_orderkey", "l_linenumber"])


def date_match_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("chunk_index"), F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    extra = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), F.date_format("l_shipdate", "yyyy-MM").alias("date"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact"))
    got = joins.matched_by_date(chunks, extra, "k")
    return got.select("k", "date", "fact", F.col("chunk_index").cast("long").alias("chunk_index"), "is_new")


def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("question_type")).agg(F.count("*").alias("size"))
    return joins.quotas(counts, 101)


def stratified_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("history_name"), F.col("doc_id").cast("string").alias("question_id"), F.col("lang").alias("question_type"))
    return joins.stratified(items, 101, 42)


def variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over the sizes that parts have."""
    limits = table(spark, sf_dir, "part").select((F.col("p_size") * 16).cast("int").alias("token_limit")).where("token_limit > 0").distinct()
    got = joins.swept(limits, "token_limit", [7, 8, 9])
    return got.select(F.col("place").cast("long").alias("place"), "variant_id", "token_limit", "repeat", "seed")


def name_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    named = F.concat(F.when(F.col("page_id") % 2 == 0, "gpt4_").otherwise(""), F.coalesce("url", F.lit("")))
    return p.select("page_id", strings.slug(F.coalesce("url", F.lit(""))).alias("slug"), strings.file_name(strings.question_file(named)).alias("file_name"))


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    answer = F.element_at(strings.tokens(F.col("text")), 1)
    return d.select("doc_id", F.coalesce(strings.leaks(F.col("text"), F.concat(F.col("lang"), F.lit(" "))), F.lit(False)).alias("by_lang"), F.coalesce(strings.leaks(F.col("text"), answer), F.lit(False)).alias("by_first"), strings.about_user(F.concat(F.when(F.col("doc_id") % 2 == 0, "The user ").otherwise("A "), F.col("text"))).alias("subject"))


_J = "j AS (SELECT d.source AS history_name, CAST(d.doc_id AS VARCHAR) AS question_id, d.lang AS question_type, quality = 1 AS is_correct, toxic = 1 AS judge_api_failed FROM labels l JOIN documents d USING (doc_id))"
_G = "g AS (SELECT d.doc_id, lang AS gold, CASE WHEN quality = 0 THEN 'en' WHEN toxic = 1 THEN NULL ELSE lang END AS pred FROM labels l JOIN documents d USING (doc_id))"


def _report(src: str) -> str:
    return f"""
      k AS (SELECT gold AS class FROM {src} UNION SELECT pred FROM {src} WHERE pred IS NOT NULL),
      c AS (SELECT class, (SELECT count(*) FROM {src} WHERE gold = class) AS s, (SELECT count(*) FROM {src} WHERE pred = class) AS p, (SELECT count(*) FROM {src} WHERE gold = class AND pred = class) AS tp FROM k),
      q AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS recall FROM c),
      f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM q)"""


def response_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model said, bare or in an object of one of three keys."""
    t = table(spark, sf_dir, "conversations")
    key = lambda name, more="": F.to_json(F.struct(*([F.lit(more).alias("text")] if more else []), F.col("text").alias(name)))
    said = F.when(F.col("turn") % 4 == 0, F.col("text")).when(F.col("turn") % 4 == 1, key("response")).when(F.col("turn") % 4 == 2, key("content", " ")).otherwise('{"other": 1}')
    return t.select("conv_id", "turn", F.md5(strings.response_text(said)).alias("said_md5"))


def extraction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an extraction's answer is refused."""
    t = table(spark, sf_dir, "conversations").where("text is not null")
    listed = F.to_json(F.struct(F.array("text").alias("memories")))
    answers = [listed, F.concat(F.lit("```json\n"), listed, F.lit("\n```")), F.to_json(F.struct(F.array("text").alias("memories"), F.lit(1).alias("more"))), F.to_json(F.struct(F.col("text").alias("memories"))), F.lit('{"memories": [1]}'), F.lit("{}"), F.lit("no JSON")]
    said = F.element_at(F.array(*answers), (F.col("turn") % len(answers) + 1).cast("int"))
    return t.select("conv_id", "turn", strings.only_memories(said).alias("error"))


def filler_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 0, 2, 4, 6 and 8 distractors of each item."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    got = construction.filler_sets(d.select(F.col("source").alias("question_id"), place.alias("place"), "text"))
    return got.select(F.col("n").cast("long").alias("n"), "question_id", F.col("place").cast("long").alias("place"), F.md5("text").alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        response_pick, extraction_check, filler_sets,
        judge_metrics, judge_merge, verdict_parse, thinking_split, relation_parse, json_loose, repeat_stats, classification_report, confusion_matrix, cohen_kappa, model_agreement, error_breakdown, cot_delta,
        pairwise_relations_dist, chain_summary, older_pairs, dataset_overview, golden_histogram, build_stats, similarity_stats, ingest_stats, hybrid_select, lowering, distractor_gate, resume_pending, ready_gate,
        question_type_filter, filler_chunks, date_match_merge, stratified_quota, stratified_sample_hash, variant_matrix, name_safety, leak_check,
    )
}
ORACLE_SQL = {
    "response_pick": "SELECT conv_id, turn, CASE WHEN turn % 4 < 3 AND text IS NOT NULL AND (turn % 4 = 0 OR trim(text, ' ') <> '') THEN md5(trim(text, ' ')) END AS said_md5 FROM conversations",
    "extraction_check": """
    SELECT conv_id, turn, CASE turn % 7 WHEN 2 THEN 'keys other than memories' WHEN 3 THEN 'memories is not a list of strings' WHEN 4 THEN 'memories is not a list of strings'
      WHEN 5 THEN 'no memories' WHEN 6 THEN 'not a JSON object' END AS error FROM conversations WHERE text IS NOT NULL
    """,
    "filler_sets": """
    WITH d AS (SELECT source AS question_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, text FROM documents WHERE source IS NOT NULL),
    n AS (SELECT unnest([2, 4, 6, 8]) AS n)
    SELECT CAST(n AS BIGINT) AS n, question_id, place, md5(text) AS text_md5 FROM d JOIN n ON place <= n
    UNION ALL SELECT DISTINCT CAST(0 AS BIGINT), question_id, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM d
    """,
    "judge_metrics": f"""
    WITH {_J} SELECT coalesce(question_type, 'ALL') AS question_type, count(*) FILTER (WHERE NOT judge_api_failed AND is_correct) AS correct, count(*) FILTER (WHERE NOT judge_api_failed) AS judged,
      count(*) FILTER (WHERE judge_api_failed) AS api_failed, round(coalesce(count(*) FILTER (WHERE NOT judge_api_failed AND is_correct) / nullif(count(*) FILTER (WHERE NOT judge_api_failed), 0), 0.0), 6) AS accuracy
    FROM j GROUP BY GROUPING SETS ((question_type), ())
    """,
    "judge_merge": f"""
    WITH {_J} SELECT d.source AS history_name, CAST(d.doc_id AS VARCHAR) AS question_id,
      CASE WHEN j.question_id IS NOT NULL THEN CASE WHEN NOT j.judge_api_failed THEN j.is_correct END ELSE CASE WHEN d.doc_id % 3 = 0 THEN TRUE END END AS is_correct, j.judge_api_failed
    FROM documents d LEFT JOIN j ON j.history_name = d.source AND j.question_id = CAST(d.doc_id AS VARCHAR)
    """,
    "verdict_parse": r"""
    WITH s AS (
      SELECT doc_id, lower(regexp_replace(CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'Final answer: yes' WHEN 1 THEN text || chr(10) || 'Answer - NO.' WHEN 2 THEN text || chr(10) || 'Yes.'
        WHEN 3 THEN text || chr(10) || 'no !' WHEN 4 THEN 'perhaps' ELSE 'yes, because ' || text END, '^\s+|\s+$', '', 'g')) AS t FROM documents
    )
    SELECT doc_id, CASE WHEN regexp_extract(t, '(final answer|answer)\s*[:\-]\s*(yes|no)\b', 2) <> '' THEN regexp_extract(t, '(final answer|answer)\s*[:\-]\s*(yes|no)\b', 2) = 'yes'
      WHEN regexp_extract(t, '(^|\n)[ \t]*(yes|no)[.!\s]*$', 2) <> '' THEN regexp_extract(t, '(^|\n)[ \t]*(yes|no)[.!\s]*$', 2) = 'yes' ELSE starts_with(t, 'yes') END AS correct FROM s
    """,
    "thinking_split": r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a plan' WHEN 1 THEN 'one' || chr(10) || chr(10) || 'two' ELSE '' END AS thinking,
      md5(CASE WHEN doc_id % 4 = 2 THEN trim('<think> </think> ' || t) ELSE t END) AS rest_md5 FROM t
    """,
    "relation_parse": """
    WITH l AS (SELECT event_id, event_id % 6 AS k, (['IND', 'EQV', 'NSO', 'OSN', 'CON'])[event_id % 5 + 1] AS label FROM events)
    SELECT event_id, CASE WHEN k IN (0, 1, 3) THEN label ELSE 'IND' END AS strict, CASE WHEN k IN (0, 1, 2, 3) THEN label ELSE 'IND' END AS loose,
      CASE WHEN k IN (0, 1, 2, 3) THEN label ELSE 'PARSE_FAIL' END AS word FROM l
    """,
    "json_loose": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "repeat_stats": f"""
    WITH {_J}, r AS (
      SELECT history_name AS t, coalesce(count(*) FILTER (WHERE NOT judge_api_failed AND is_correct) / nullif(count(*) FILTER (WHERE NOT judge_api_failed), 0), 0.0) AS accuracy,
        count(*) FILTER (WHERE NOT judge_api_failed) AS judged, count(*) FILTER (WHERE judge_api_failed) AS api_failed FROM j GROUP BY 1
    )
    SELECT CASE WHEN length(t) > 4 THEN 'long' ELSE 'short' END AS grp, count(*) AS n, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sample_std,
      round(avg(judged), 6) AS judged_mean, round(avg(api_failed), 6) AS failed_mean, CAST(sum(judged) AS BIGINT) AS judged_sum, CAST(sum(api_failed) AS BIGINT) AS failed_sum FROM r GROUP BY 1
    """,
    "classification_report": f"""
    WITH {_G}, {_report("g")}
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, s AS support FROM f
    UNION ALL SELECT 'MACRO', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(s) AS BIGINT) FROM f
    UNION ALL SELECT 'WEIGHTED', round(sum(precision * s) / sum(s), 6), round(sum(recall * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f
    UNION ALL SELECT 'MICRO', round(sum(tp) / sum(p), 6), round(sum(tp) / sum(s), 6), round(2 * sum(tp) / (sum(p) + sum(s)), 6), CAST(sum(s) AS BIGINT) FROM f
    """,
    "confusion_matrix": f"""
    WITH {_G}, l AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS gold), p AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it', 'NONE']) AS pred)
    SELECT l.gold, p.pred, count(g.gold) AS n FROM l CROSS JOIN p LEFT JOIN g ON g.gold = l.gold AND coalesce(g.pred, 'NONE') = p.pred GROUP BY 1, 2
    """,
    "cohen_kappa": """
    WITH n AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po FROM labels),
    e AS (SELECT sum(a * b) AS ab FROM (SELECT quality AS c, CAST(count(*) AS DOUBLE) AS a FROM labels GROUP BY 1) x JOIN (SELECT toxic AS c, CAST(count(*) AS DOUBLE) AS b FROM labels GROUP BY 1) y USING (c))
    SELECT n, round(po, 6) AS po, round(ab / (CAST(n AS DOUBLE) * n), 6) AS pe, round((po - ab / (CAST(n AS DOUBLE) * n)) / (1 - ab / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM n, e
    """,
    "model_agreement": """
    WITH m AS (SELECT o_orderkey AS item, o_orderstatus AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS b, CASE WHEN o_custkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS c FROM orders),
    p AS (SELECT 'a' AS model_a, 'b' AS model_b, a AS x, b AS y FROM m UNION ALL SELECT 'a', 'c', a, c FROM m UNION ALL SELECT 'b', 'c', b, c FROM m),
    n AS (SELECT model_a, model_b, count(*) AS n, avg(CAST(x = y AS INT)) AS po FROM p GROUP BY 1, 2),
    e AS (SELECT i.model_a, i.model_b, sum(i.k * j.k) AS ab FROM (SELECT model_a, model_b, x AS l, CAST(count(*) AS DOUBLE) AS k FROM p GROUP BY 1, 2, 3) i
      JOIN (SELECT model_a, model_b, y AS l, CAST(count(*) AS DOUBLE) AS k FROM p GROUP BY 1, 2, 3) j ON i.model_a = j.model_a AND i.model_b = j.model_b AND i.l = j.l GROUP BY 1, 2)
    SELECT n.model_a, n.model_b, n, round(po, 6) AS po, round((po - ab / (CAST(n AS DOUBLE) * n)) / (1 - ab / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM n JOIN e ON e.model_a = n.model_a AND e.model_b = n.model_b
    """,
    "error_breakdown": f"""
    WITH {_G}, w AS (SELECT gold, coalesce(pred, 'NONE') AS pred, count(*) AS n FROM g WHERE gold IS DISTINCT FROM pred GROUP BY 1, 2)
    SELECT gold, pred, n, row_number() OVER (PARTITION BY gold ORDER BY n DESC, pred) AS place, CAST(sum(n) OVER (PARTITION BY gold) AS BIGINT) AS wrong FROM w
    """,
    "cot_delta": f"""
    WITH {_G}, h AS (SELECT gold, CASE WHEN doc_id % 2 = 0 THEN gold ELSE pred END AS pred FROM g),
    x AS (WITH {_report("g")} SELECT class, f1 FROM f), y AS (WITH {_report("h")} SELECT class, f1 FROM f)
    SELECT x.class, round(y.f1 - x.f1, 6) AS delta FROM x JOIN y ON x.class = y.class
    """,
    "pairwise_relations_dist": f"""
    WITH {PAIRS}, k AS (SELECT CASE WHEN rank = 1 THEN 'same' ELSE 'near' END AS kind, label FROM labelled),
    n AS (SELECT coalesce(kind, 'ALL') AS kind, label, count(*) AS n FROM k GROUP BY GROUPING SETS ((kind, label), (label)))
    SELECT kind, label, n, round(n / sum(n) OVER (PARTITION BY kind), 4) AS ratio FROM n
    """,
    "chain_summary": f"""
    WITH {PAIRS}, k AS (SELECT CASE WHEN rank = 1 THEN 'same' ELSE 'near' END AS kind, new_id // 50 AS chain, label FROM labelled)
    SELECT kind, count(DISTINCT chain) AS chains, count(*) AS steps, round(count(*) / count(DISTINCT chain), 6) AS mean_steps, count(*) FILTER (WHERE label = 'IND') AS ind, count(*) FILTER (WHERE label = 'EQV') AS eqv,
      count(*) FILTER (WHERE label = 'NSO') AS nso, count(*) FILTER (WHERE label = 'OSN') AS osn, count(*) FILTER (WHERE label = 'CON') AS con FROM k GROUP BY 1
    """,
    "older_pairs": """
    WITH t AS (SELECT conv_id, turn, turn * 7 % 5 AS at, length(text) AS c FROM conversations)
    SELECT a.conv_id, CASE WHEN a.at <= b.at THEN a.turn ELSE b.turn END AS old_pos, CASE WHEN a.at <= b.at THEN b.turn ELSE a.turn END AS new_pos,
      CASE WHEN a.at <= b.at THEN a.c ELSE b.c END AS old_chars, CASE WHEN a.at <= b.at THEN b.c ELSE a.c END AS new_chars FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn
    """,
    "dataset_overview": "SELECT coalesce(lang, 'ALL') AS lang, count(*) AS items, CAST(sum(f) AS BIGINT) AS facts, max(f) AS most FROM (SELECT lang, len(string_split(coalesce(text, ''), chr(10))) AS f FROM documents) GROUP BY GROUPING SETS ((lang), ())",
    "golden_histogram": "SELECT len(string_split(coalesce(text, ''), chr(10))) AS facts, count(*) AS items FROM documents GROUP BY 1",
    "build_stats": """
    SELECT lang, count(*) AS n, round(avg(CAST(quality = 1 AS INT)), 6) AS success_rate, round(avg(CASE WHEN quality = 1 THEN n_chars / 1000 - n_chars / 2000 END), 6) AS mean_drop,
      round(avg(CASE WHEN quality = 1 THEN n_chars / 2000 END), 6) AS mean_after FROM labels JOIN documents USING (doc_id) GROUP BY 1
    """,
    "similarity_stats": """
    WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT label, list_inner_product(v, list_reverse(v)) / list_inner_product(v, v) AS sim FROM e)
    SELECT label, count(*) AS n, round(avg(sim), 6) AS mean, round(median(sim), 6) AS median, round(min(sim), 6) AS least, round(max(sim), 6) AS most FROM s GROUP BY 1
    """,
    "ingest_stats": "SELECT CAST(user_id AS VARCHAR) AS history_name, count(*) AS submitted, count(*) FILTER (WHERE event_type <> 'view') AS row_ops, count(*) FILTER (WHERE coalesce(value, 0) >= 50) AS admitted, count(*) FILTER (WHERE coalesce(value, 0) < 50) AS rejected FROM events GROUP BY 1",
    "hybrid_select": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND quality = 1 THEN 'low: ' || lang ELSE lang END AS picked FROM labels JOIN documents USING (doc_id)",
    "lowering": """
    WITH k AS (SELECT l_orderkey AS fact, l_partkey || '-' || l_linenumber AS text, l_discount AS sim FROM lineitem WHERE l_returnflag <> 'R')
    SELECT fact, text, sim AS min_sim FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY sim, text) AS n FROM k) WHERE n = 1
    """,
    "distractor_gate": """
    WITH c AS (SELECT l_suppkey AS item, l_orderkey * 8 + l_linenumber AS seq, 'part ' || l_partkey AS text FROM lineitem WHERE l_discount > CAST(0.04 AS DOUBLE) AND NOT contains('part ' || l_partkey, 'part 1')),
    o AS (SELECT item, text, min(seq) AS seq FROM c GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS place FROM o),
    f AS (SELECT *, count(*) OVER (PARTITION BY item) AS k FROM p WHERE place <= 8)
    SELECT item, place, text FROM f WHERE k = 8
    """,
    "resume_pending": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "ready_gate": "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus)",
    "question_type_filter": "SELECT source AS history_name, doc_id FROM documents WHERE lang IN ('es', 'fr')",
    "filler_chunks": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O' AND o_custkey % 4 + 1 = l_linenumber)",
    "date_match_merge": """
    WITH c AS (SELECT o_custkey AS k, o_orderkey AS i, strftime(o_orderdate, '%Y-%m') AS date FROM orders), f AS (SELECT k, date, min(i) AS i FROM c GROUP BY 1, 2), t AS (SELECT k, max(i) AS top FROM c GROUP BY 1),
    e AS (SELECT l_suppkey % 50 AS k, strftime(l_shipdate, '%Y-%m') AS date, l_orderkey || '-' || l_linenumber AS fact FROM lineitem),
    b AS (SELECT e.*, f.i, t.top FROM e LEFT JOIN f ON f.k = e.k AND f.date = e.date LEFT JOIN t ON t.k = e.k)
    SELECT k, date, fact, coalesce(i, coalesce(top, -1) + dense_rank() OVER (PARTITION BY k, i IS NULL ORDER BY date)) AS chunk_index, i IS NULL AS is_new FROM b
    """,
    "stratified_quota": """
    WITH c AS (SELECT lang AS question_type, count(*) AS size FROM documents GROUP BY 1), i AS (SELECT *, 101 * size / sum(size) OVER () AS ideal, sum(size) OVER () AS total FROM c),
    r AS (SELECT *, CAST(floor(ideal) AS BIGINT) AS fl, row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, question_type) AS place FROM i)
    SELECT question_type, size, CASE WHEN total <= 101 THEN size ELSE fl + CASE WHEN place <= 101 - CAST(sum(fl) OVER () AS BIGINT) THEN 1 ELSE 0 END END AS quota FROM r
    """,
    "variant_matrix": """
    WITH l AS (SELECT DISTINCT CAST(p_size * 16 AS INTEGER) AS token_limit FROM part WHERE p_size > 0), r AS (SELECT * FROM (VALUES (0, 7), (1, 8), (2, 9)) t(repeat, seed))
    SELECT row_number() OVER (ORDER BY token_limit, repeat) AS place, printf('tl%d-r%02d-s%d', token_limit, repeat, seed) AS variant_id, token_limit, repeat, seed FROM l CROSS JOIN r
    """,
    "name_safety": r"""
    WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '[^a-z0-9_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug, coalesce(url, '') AS url FROM pages)
    SELECT page_id, CASE WHEN slug = '' THEN 'x' ELSE slug END AS slug, regexp_replace(CASE WHEN page_id % 2 = 0 THEN 'gp_4_' ELSE '' END || url, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM s
    """,
    "leak_check": r"""
    WITH d AS (SELECT doc_id, text, lang, (list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))[1] AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, FALSE AS by_lang, coalesce(length(w) > 3 AND contains(lower(text), w), FALSE) AS by_first,
      CASE WHEN doc_id % 2 = 0 THEN length('The user ' || text) >= 12 ELSE FALSE END AS subject FROM d
    """,
}
