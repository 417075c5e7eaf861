"""Queries over the memory table: visibility, ingest, trees, fusion, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import admission, folds, memory, neighbours, operations, trees
from .derived import MEMORIES, PRIMARY_SQL, VISIBLE_SQL, memories, table


def answer_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(memory.answer_visible()).select("history_name", "memory_id", memory.role().alias("role"))


def searchable_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(memory.searchable_primary()).select("history_name", "memory_id", "answer_hidden")


def list_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.listed(memories(spark, sf_dir)).select("history_name", "memory_id", F.col("place").cast("long").alias("place"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts: the history is the source, the time follows the id."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("history_name"), i.alias("seq"), "text",
        F.format_string("2023/%02d/%02d (Mon) %02d:%02d", i % 12 + 1, i % 28 + 1, i % 24, i % 60).alias("time"),
        F.when(i % 3 == 0, "evidence").alias("memory_role"),
    )


def ingest_add_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    return memory.add_all(facts).select("history_name", "seq", F.length("text").cast("long").alias("chars"))


def dedup_identical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.deduplicated(_facts(spark, sf_dir)).select("history_name", "seq", memory.role().alias("role"))


def evidence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = memory.descendants(memories(spark, sf_dir)).where("depth > 0")
    return got.select("history_name", "root_id", "memory_id", F.col("depth").cast("long").alias("depth"))


def bundle_fusion_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = memory.fused_bundles(memories(spark, sf_dir))
    return got.select("history_name", "root_id", "members", "time", F.md5("text").alias("text_md5"))


def depth_one_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.depth_one_packages(memories(spark, sf_dir))


def mem0_apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    store = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("history_name"), F.floor(F.col("o_orderkey") / 4).alias("memory_id"), "o_orderkey", "o_orderpriority")
    store = store.groupBy("history_name", "memory_id").agg(F.min("o_orderkey").alias("seq"), F.min_by("o_orderpriority", "o_orderkey").alias("text")).withColumn("time", F.lit("before"))
    op = F.when(F.col("o_orderstatus") == "F", "DELETE").when(F.col("o_orderstatus") == "P", "UPDATE").otherwise("ADD")
    ops = o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").cast("string").alias("history_name"), F.floor(F.col("o_orderkey") / 4).alias("memory_id"), op.alias("op"), F.col("o_orderpriority").alias("text"), F.lit("after").alias("time"), F.col("o_orderkey").alias("op_seq"))
    # Operations come on ids of the same customer's neighbours, so keys are made to meet.
    meet = lambda df: df.withColumn("history_name", (F.col("history_name").cast("long") % 10).cast("string")).withColumn("memory_id", F.col("memory_id") % 500)
    store = meet(store).groupBy("history_name", "memory_id").agg(F.min("seq").alias("seq"), F.min_by("text", "seq").alias("text"), F.min("time").alias("time"))
    return memory.applied(store, meet(ops))


def evermemos_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "label"), "memory_id")
    got = memory.clusters_finalized(m.withColumn("cluster", F.concat(F.lit("c"), F.col("label").cast("string"))))
    return got.select("history_name", "cluster", "memory_role", "members", F.md5("text").alias("text_md5"))


def edge_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.format_string("value %.2f", "value").alias("fact"))
    held = memory.validity(e, ["user_id", "event_type"], "ts", "event_id")
    return memory.valid_edges(held).select("event_id", "user_id", "event_type")


def edge_export_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    done = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("event_id"))
    return memory.not_exported(e, done, "event_id").select("event_id", "event_type")


def pronoun_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    said = F.concat(F.when(F.col("turn") % 2 == 0, "The user told the assistant: ").otherwise("the user heard The assistant: "), F.col("text"))
    return t.select("conv_id", "turn", F.md5(strings.aliased(said, F.col("conv_id").cast("string"))).alias("text_md5"))


def _amac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of conversations: turns, with the turn before as their context."""
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"ord": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy("conv_id")), "before": F.lag("text").over(order)})
    return t.select(
        F.col("conv_id").cast("string").alias("history_name"), F.col("turn").alias("seq"), "text",
        admission.confidence(F.col("text"), F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast("array<string>"))).alias("confidence"),
        admission.recency(F.col("ord"), F.col("n")).alias("recency"), admission.type_of(F.col("text")).alias("kind"), admission.type_prior(F.col("text")).alias("type_prior"),
    )


def amac_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amac(spark, sf_dir).select("history_name", "seq", F.round("confidence", 6).alias("confidence"), F.round("recency", 6).alias("recency"), "kind", "type_prior")


def amac_admit_setwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    n = admission.novelty_setwise(m.withColumn("prior", admission.type_prior(F.col("text"))), "prior")
    s = admission.score(F.lit(admission.NO_UTILITY), F.lit(0.0), F.col("novelty"), F.lit(1.0), F.col("prior"))
    return n.select("history_name", "seq", F.round("novelty", 6).alias("novelty"), F.round(s, 6).alias("score"), (F.round(s, 9) >= admission.THRESHOLD).alias("admitted"))


def amac_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _admitted(spark, sf_dir)
    return got.select("history_name", "seq", F.round("novelty", 6).alias("novelty"), F.round("score", 6).alias("score"), "admitted")


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("history_name", "seq", "embedding", F.lit(admission.NO_UTILITY).alias("utility"), F.lit(0.0).alias("confidence"), F.lit(1.0).alias("recency"), admission.type_prior(F.col("text")).alias("type_prior"))
    return folds.folded(m, folds.admit, folds.ADMIT)


def evermemos_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import partial

    from ..functions import dates

    m = memories(spark, sf_dir).select("history_name", "seq", "embedding", dates.parse_chat_time(F.col("time")).cast("double").alias("at"))
    return folds.folded(m, partial(folds.cluster, threshold=0.15, gap_days=60.0), folds.CLUSTER)


def relation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import partial

    m = memories(spark, sf_dir).select("history_name", "seq", "text", "time", "embedding")
    return folds.folded(m, partial(folds.relate, threshold=0.15), folds.RELATE)


def relation_fold_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``relation_fold``, with similarities made by many tasks."""
    from functools import partial

    m = memories(spark, sf_dir).select("history_name", "seq", "text", "time", "embedding")
    return folds.joined(m, partial(folds.relate, threshold=0.15), folds.RELATE, 0.15)


def near_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a history that are near, which relation decisions walk over."""
    near = neighbours.edges(memories(spark, sf_dir).select("history_name", "seq", "embedding"), 0.15)
    return near.select("history_name", "a", "b", F.round("score", 6).alias("score"))


def mem0_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.log(_facts(spark, sf_dir).select("history_name", "seq", "text", "time"))


def mem0_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operations leave of each history."""
    left = operations.left(_facts(spark, sf_dir).select("history_name", "seq", "text", "time"), F.md5("text"))
    return left.select("history_name", "memory_id", "seq", F.col("text").alias("text_md5"), "time", "source")


def relation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What relation decisions met, planned and wrote."""
    from functools import partial

    m = memories(spark, sf_dir).select("history_name", "seq", "text", "time", "embedding")
    got = folds.folded(m, partial(folds.decisions, threshold=0.15), folds.DECISIONS)
    return got.select("history_name", "seq", "event", F.md5("detail").alias("detail_md5"))


def fused_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = memory.fused_store(memories(spark, sf_dir))
    return got.select("history_name", "memory_id", memory.role().alias("role"), "parent_primary", "fused_member_count", "time", F.md5("text").alias("text_md5"))


def packages_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of fusion's packages of two and more, ancestors first."""
    return _packages(trees.wave(memories(spark, sf_dir)))


def disjoint_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packages of depth one, single rows too, in pre-order."""
    return _packages(trees.packages(memories(spark, sf_dir)))


def _packages(rows: DataFrame) -> DataFrame:
    members = F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ",")
    return rows.select("history_name", F.col("place").cast("long").alias("place"), "center_id", "depth", members.alias("members"))


def tree_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, size and pre-order of every row below a root."""
    return trees.placed(memories(spark, sf_dir)).select("history_name", "memory_id", "root_id", "depth", "size", "place")


def graph_valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the graph method that still hold."""
    t = table(spark, sf_dir, "conversations")
    said = F.concat(F.element_at(F.array(F.lit("the user wants "), F.lit("the assistant says "), F.lit("The user was told ")), (F.col("turn") % 3 + 1).cast("int")), F.col("text"))
    facts = t.select(F.col("conv_id").cast("string").alias("history_name"), F.col("turn").alias("seq"), said.alias("text"))
    return memory.valid_edges(memory.graph_edges(facts)).select("history_name", "seq", F.md5("fact").alias("fact_md5"))


_TREE = f"""
    WITH RECURSIVE {MEMORIES}, tree(history_name, root_id, memory_id, seq, depth) AS (
      SELECT history_name, memory_id, memory_id, seq, CAST(0 AS BIGINT) FROM memories WHERE {PRIMARY_SQL} AND parent_primary IS NULL
      UNION ALL
      SELECT c.history_name, t.root_id, c.memory_id, c.seq, t.depth + 1 FROM tree t JOIN memories c
      ON c.history_name = t.history_name AND c.parent_primary = t.memory_id WHERE NOT ({PRIMARY_SQL.replace('memory_role', 'c.memory_role')})
    )"""
#: Rows below roots with the ids on the way to them, which sort in pre-order, and packages of depth one.
_PATHS = f"""
    WITH RECURSIVE {MEMORIES}, paths(history_name, memory_id, path) AS (
      SELECT history_name, memory_id, [memory_id] FROM memories WHERE {PRIMARY_SQL} AND parent_primary IS NULL
      UNION ALL SELECT c.history_name, c.memory_id, list_append(p.path, c.memory_id) FROM paths p JOIN memories c ON c.history_name = p.history_name AND c.parent_primary = p.memory_id
    )"""
_PACKAGES = f"""{_PATHS},
    kids AS (SELECT history_name, parent_primary AS center_id, memory_id, memory_id IN (SELECT parent_primary FROM memories WHERE parent_primary IS NOT NULL) AS inner_row FROM memories WHERE parent_primary IS NOT NULL),
    packages AS (
      SELECT p.history_name, p.memory_id AS center_id, CAST(len(path) - 1 AS BIGINT) AS depth, path,
        array_to_string(list_prepend(p.memory_id, coalesce(list(k.memory_id ORDER BY k.memory_id) FILTER (WHERE NOT k.inner_row), [])), ',') AS members
      FROM paths p LEFT JOIN kids k ON k.history_name = p.history_name AND k.center_id = p.memory_id GROUP BY p.history_name, p.memory_id, path
      HAVING len(path) = 1 OR count(k.memory_id) > 0
    )"""
_TIME = "printf('2023/%02d/%02d (Mon) %02d:%02d', doc_id % 12 + 1, doc_id % 28 + 1, doc_id % 24, doc_id % 60)"
_FACTS = f"f AS (SELECT source AS history_name, doc_id AS seq, text, {_TIME} AS time, CASE WHEN doc_id % 3 = 0 THEN 'evidence' END AS memory_role FROM documents)"


def _patterns_sql() -> str:
    esc = lambda x: x.replace("'", "''")
    by_pattern = " ".join(f"WHEN regexp_matches(text, '(?i){esc(p)}') THEN '{t}'" for t, p in admission.TYPE_PATTERNS)
    counts = {t: " + ".join(f"(contains(lower(text), '{esc(k)}'))::INT" for k in keys) for t, keys in admission.TYPE_KEYWORDS.items()}
    best = f"greatest({', '.join(counts.values())})"
    by_keyword = " ".join(f"WHEN {best} > 0 AND ({c}) = {best} THEN '{t}'" for t, c in counts.items())
    return f"CASE {by_pattern} {by_keyword} ELSE 'unknown' END"


_PRIOR = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in admission.TYPE_PRIORS.items()) + " END"
_SET = lambda x: rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda x: x <> ''))"

#: Facts of a history in order, and the fold over them as a recursive step; states are lists.
_MEM0 = f"""
    WITH RECURSIVE {_FACTS},
    o AS (SELECT history_name, seq, trim(text, ' ') AS text, time, row_number() OVER (PARTITION BY history_name ORDER BY seq) AS k FROM f WHERE trim(coalesce(text, ''), ' ') <> ''),
    q AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:3], ' ') AS head, md5(text) AS h FROM o),
    s(history_name, k, seq, op, hs, heads, ids, times, sources) AS (
      SELECT history_name, k, seq, 'ADD', [h], [head], [seq], [time], ['added'] FROM q WHERE k = 1
      UNION ALL
      SELECT history_name, k, seq, op,
        CASE op WHEN 'ADD' THEN list_append(hs, h) WHEN 'UPDATE' THEN list_concat(hs[:i - 1], [h], hs[i + 1:]) ELSE hs END,
        CASE op WHEN 'ADD' THEN list_append(heads, head) ELSE heads END,
        CASE op WHEN 'ADD' THEN list_append(ids, seq) ELSE ids END,
        CASE op WHEN 'ADD' THEN list_append(times, time) WHEN 'UPDATE' THEN list_concat(times[:i - 1], [time], times[i + 1:]) ELSE times END,
        CASE op WHEN 'ADD' THEN list_append(sources, 'added') WHEN 'UPDATE' THEN list_concat(sources[:i - 1], ['updated'], sources[i + 1:]) ELSE sources END
      FROM (SELECT s.hs, s.heads, s.ids, s.times, s.sources, q.*, list_position(s.heads, q.head) AS i,
              CASE WHEN list_contains(s.hs, q.h) THEN 'NONE' WHEN list_contains(s.heads, q.head) THEN 'UPDATE' ELSE 'ADD' END AS op
            FROM s JOIN q ON q.history_name = s.history_name AND q.k = s.k + 1)
    )"""
_UNIT = "u AS (SELECT history_name, seq, row_number() OVER (PARTITION BY history_name ORDER BY seq) AS k, embedding, time, text, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS v FROM memories)"

QUERIES = {f.__name__: f for f in (answer_visible, searchable_primary, list_memories, ingest_add_all, dedup_identical_text, evidence_tree, bundle_fusion_fallback, depth_one_partition, mem0_apply_batch, evermemos_finalize, edge_validity, edge_export_incremental, pronoun_alias, amac_features, amac_admit_setwise, amac_fold, evermemos_clusters, relation_fold, relation_fold_joined, near_points, relation_log, mem0_fold, mem0_store, fused_store, packages_by_depth, disjoint_packages, tree_places, graph_valid_facts)}
ORACLE_SQL = {
    "answer_visible": f"WITH {MEMORIES} SELECT history_name, memory_id, coalesce(memory_role, 'primary') AS role FROM memories WHERE {VISIBLE_SQL}",
    "searchable_primary": f"WITH {MEMORIES} SELECT history_name, memory_id, answer_hidden FROM memories WHERE {PRIMARY_SQL} AND NOT stale",
    "list_memories": f"WITH {MEMORIES} SELECT history_name, memory_id, row_number() OVER (PARTITION BY history_name ORDER BY time, seq) AS place FROM memories",
    "ingest_add_all": f"""
    WITH {_FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY history_name, trim(text, ' ') ORDER BY time, seq) AS n FROM f WHERE trim(coalesce(text, ''), ' ') <> '')
    SELECT history_name, seq, CAST(length(trim(text, ' ')) AS BIGINT) AS chars FROM k WHERE n = 1
    """,
    "dedup_identical_text": f"""
    WITH {_FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY history_name, trim(text, ' '), coalesce(memory_role, 'primary') ORDER BY time, seq) AS n FROM f)
    SELECT history_name, seq, coalesce(memory_role, 'primary') AS role FROM k WHERE n = 1 OR trim(coalesce(text, ''), ' ') = ''
    """,
    "evidence_tree": f"{_TREE} SELECT history_name, root_id, memory_id, depth FROM tree WHERE depth > 0",
    "bundle_fusion_fallback": f"""{_TREE}
    SELECT t.history_name, root_id, count(*) AS members, max(m.time) AS time, md5(string_agg(m.text, chr(10) ORDER BY t.depth, t.seq)) AS text_md5
    FROM tree t JOIN memories m ON m.history_name = t.history_name AND m.memory_id = t.memory_id GROUP BY 1, 2
    """,
    "depth_one_partition": f"""
    WITH {MEMORIES}, c AS (SELECT history_name, parent_primary AS center_id, memory_id FROM memories WHERE parent_primary IS NOT NULL)
    SELECT history_name, center_id, count(*) AS leaves, min(memory_id) AS first_leaf FROM c
    WHERE NOT EXISTS (SELECT 1 FROM c AS i WHERE i.history_name = c.history_name AND i.center_id = c.memory_id) GROUP BY 1, 2
    """,
    "mem0_apply_batch": """
    WITH s0 AS (SELECT o_custkey % 10 AS h, o_custkey, o_orderkey // 4 AS m0, o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0),
    s1 AS (SELECT h, o_custkey, m0 % 500 AS m, min(o_orderkey) AS seq, arg_min(o_orderpriority, o_orderkey) AS text FROM s0 GROUP BY h, o_custkey, m0),
    s AS (SELECT CAST(h AS VARCHAR) AS history_name, m AS memory_id, min(seq) AS seq, arg_min(text, seq) AS text FROM s1 GROUP BY 1, 2),
    o AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS history_name, (o_orderkey // 4) % 500 AS memory_id,
      CASE o_orderstatus WHEN 'F' THEN 'DELETE' WHEN 'P' THEN 'UPDATE' ELSE 'ADD' END AS op, o_orderpriority AS text, o_orderkey AS op_seq FROM orders WHERE o_orderkey % 2 = 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY history_name, memory_id ORDER BY op_seq DESC) AS n FROM o WHERE op <> 'UPDATE' OR trim(text) <> '')
    SELECT coalesce(s.history_name, l.history_name) AS history_name, coalesce(s.memory_id, l.memory_id) AS memory_id, coalesce(l.text, s.text) AS text,
      CASE WHEN l.op IS NULL THEN 'before' ELSE 'after' END AS time, coalesce(l.op, 'KEEP') AS last_op
    FROM s FULL JOIN (SELECT * FROM l WHERE n = 1) l ON s.history_name = l.history_name AND s.memory_id = l.memory_id
    WHERE (l.op IS NULL OR l.op <> 'DELETE') AND (s.seq IS NOT NULL OR l.op = 'ADD')
    """,
    "evermemos_finalize": f"""
    WITH {MEMORIES}, c AS (SELECT m.history_name, 'c' || CAST(e.label AS VARCHAR) AS cluster, m.seq, m.text FROM memories m JOIN embeddings e ON e.vec_id = m.memory_id),
    g AS (SELECT history_name, cluster, count(*) AS members, string_agg(text, ' ' ORDER BY seq) AS text FROM c GROUP BY 1, 2)
    SELECT history_name, cluster, 'primary' AS memory_role, members, md5(text) AS text_md5 FROM g
    UNION ALL SELECT c.history_name, c.cluster, 'evidence', g.members, md5(c.text) FROM c JOIN g ON g.history_name = c.history_name AND g.cluster = c.cluster WHERE g.members > 1
    """,
    "edge_validity": """
    WITH v AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at FROM events)
    SELECT event_id, user_id, event_type FROM v WHERE invalid_at IS NULL AND value IS NOT NULL
    """,
    "edge_export_incremental": "SELECT event_id, event_type FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey * 2 = event_id)",
    "pronoun_alias": """
    WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'The user told the assistant: ' ELSE 'the user heard The assistant: ' END || text AS t FROM conversations)
    SELECT conv_id, turn, md5(replace(replace(replace(replace(t, 'the user', 'User_' || conv_id), 'the assistant', 'Asst_' || conv_id), 'The user', 'User_' || conv_id), 'The assistant', 'Asst_' || conv_id)) AS text_md5 FROM s
    """,
    "amac_features": f"""
    WITH t AS (SELECT conv_id, turn, text, row_number() OVER w - 1 AS ord, count(*) OVER (PARTITION BY conv_id) AS n, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, {_SET("text")} AS a, {_SET("coalesce(before, '')")} AS b, {_patterns_sql()} AS kind FROM t)
    SELECT CAST(conv_id AS VARCHAR) AS history_name, turn AS seq,
      round(CASE WHEN before IS NULL OR len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS confidence,
      round(greatest(0.0, least(1.0, exp(-0.12 * (n - 1 - ord)))), 6) AS recency, kind, CAST({_PRIOR} AS DOUBLE) AS type_prior FROM s
    """,
    "amac_admit_setwise": f"""
    WITH {MEMORIES}, u AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS v FROM memories),
    m AS (SELECT a.history_name, a.seq, max(list_inner_product(a.v, b.v)) AS m FROM u a JOIN u b ON a.history_name = b.history_name AND b.seq < a.seq AND b.seq >= a.seq - 64 GROUP BY 1, 2),
    n AS (SELECT u.history_name, u.seq, {_patterns_sql()} AS kind, coalesce(greatest(0.0, least(1.0, 1 - m)), 1.0) AS novelty FROM u LEFT JOIN m ON m.history_name = u.history_name AND m.seq = u.seq),
    s AS (SELECT *, 0.1 * 0.5 + 0.1 * 0.0 + 0.1 * novelty + 0.1 * 1.0 + 0.6 * CAST({_PRIOR} AS DOUBLE) AS score FROM n)
    SELECT history_name, seq, round(novelty, 6) AS novelty, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(score AS DOUBLE), 9) >= 0.55 AS admitted FROM s
    """,
    "amac_fold": f"""
    WITH RECURSIVE {MEMORIES}, {_UNIT}, p AS (SELECT *, CAST({_PRIOR} AS DOUBLE) AS prior FROM (SELECT *, {_patterns_sql()} AS kind FROM u)),
    s(history_name, seq, k, kept, novelty, score, admitted) AS (
      SELECT history_name, seq, CAST(0 AS BIGINT), CAST([] AS DOUBLE[][]), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), FALSE FROM p WHERE k = 1
      UNION ALL
      SELECT history_name, seq, k, CASE WHEN score >= 0.55 THEN list_append(kept, v)[-64:] ELSE kept END, novelty, score, score >= 0.55
      FROM (SELECT *, CAST(0.1 * 0.5 + 0.1 * 0.0 + 0.1 * novelty + 0.1 * 1.0 + 0.6 * prior AS DOUBLE) AS score
            FROM (SELECT p.*, s.kept, CASE WHEN len(s.kept) = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - list_max(list_transform(s.kept, lambda w: list_inner_product(w, p.v))))) END AS novelty
                  FROM s JOIN p ON p.history_name = s.history_name AND p.k = s.k + 1))
    )
    SELECT history_name, seq, round(CAST(novelty AS DOUBLE), 6) AS novelty, round(score, 6) AS score, admitted FROM s WHERE k > 0
    """,
    "evermemos_clusters": f"""
    WITH RECURSIVE {MEMORIES}, {_UNIT}, p AS (
      SELECT history_name, seq, k, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n, CAST(epoch(strptime(regexp_replace(time, ' \\([^)]*\\)', ''), '%Y/%m/%d %H:%M')) AS DOUBLE) AS sec FROM u
    ),
    s(history_name, seq, k, centers, counts, lasts, own) AS (
      SELECT history_name, seq, k, [v], [CAST(1 AS DOUBLE)], [sec], CAST(1 AS BIGINT) FROM p WHERE k = 1
      UNION ALL
      SELECT history_name, seq, k,
        CASE WHEN own > len(centers) THEN list_append(centers, v) ELSE list_concat(centers[:own - 1], [list_transform(range(1, len(v) + 1), lambda j: (centers[own][j] * counts[own] + v[j]) / (counts[own] + 1))], centers[own + 1:]) END,
        CASE WHEN own > len(centers) THEN list_append(counts, 1.0) ELSE list_concat(counts[:own - 1], [counts[own] + 1], counts[own + 1:]) END,
        CASE WHEN own > len(centers) THEN list_append(lasts, sec) ELSE list_concat(lasts[:own - 1], [greatest(lasts[own], sec)], lasts[own + 1:]) END, own
      FROM (SELECT *, CASE WHEN list_max(sims) >= 0.15 THEN list_position(sims, list_max(sims)) ELSE len(centers) + 1 END AS own
            FROM (SELECT p.*, s.centers, s.counts, s.lasts, list_transform(range(1, len(s.centers) + 1), lambda i: CASE WHEN abs(p.sec - s.lasts[i]) > 60 * 86400 THEN -2.0
                    ELSE list_inner_product(s.centers[i], p.v) / ((sqrt(list_inner_product(s.centers[i], s.centers[i])) + 1e-9) * (p.n + 1e-9)) END) AS sims
                  FROM s JOIN p ON p.history_name = s.history_name AND p.k = s.k + 1))
    )
    SELECT history_name, seq, printf('cluster_%04d', own - 1) AS cluster FROM s
    """,
    "near_points": f"""
    WITH {MEMORIES}, {_UNIT}, p AS (SELECT history_name, min(seq) AS seq, any_value(v) AS v FROM u GROUP BY history_name, embedding)
    SELECT x.history_name, x.seq AS a, y.seq AS b, round(list_inner_product(x.v, y.v), 6) AS score
    FROM p x JOIN p y ON y.history_name = x.history_name AND y.seq >= x.seq WHERE list_inner_product(x.v, y.v) >= 0.15
    """,
    "mem0_fold": f"{_MEM0} SELECT history_name, seq, op, CAST(len(hs) AS BIGINT) AS held FROM s",
    "mem0_store": f"""{_MEM0},
    e AS (SELECT history_name, max(k) AS k FROM s GROUP BY 1)
    SELECT history_name, unnest(range(0, len(hs))) AS memory_id, unnest(ids) AS seq, unnest(hs) AS text_md5, unnest(times) AS time, unnest(sources) AS source FROM s JOIN e USING (history_name, k)
    """,
    "fused_store": f"""{_TREE},
    b AS (SELECT history_name, root_id, count(*) AS n FROM tree GROUP BY 1, 2 HAVING count(*) > 1),
    t AS (SELECT history_name, max(memory_id) AS top FROM memories GROUP BY 1),
    n AS (SELECT b.*, t.top + row_number() OVER (PARTITION BY b.history_name ORDER BY root_id) AS fused_id FROM b JOIN t USING (history_name)),
    o AS (SELECT n.history_name, n.fused_id, tree.memory_id, tree.depth, tree.seq FROM n JOIN tree ON tree.history_name = n.history_name AND tree.root_id = n.root_id)
    SELECT m.history_name, m.memory_id, coalesce(m.memory_role, 'primary') AS role, coalesce(p.fused_id, m.parent_primary) AS parent_primary, CAST(1 AS BIGINT) AS fused_member_count, m.time, md5(m.text) AS text_md5
    FROM memories m LEFT JOIN o p ON p.history_name = m.history_name AND p.memory_id = m.parent_primary
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.history_name = m.history_name AND o.memory_id = m.memory_id)
    UNION ALL
    SELECT o.history_name, fused_id, 'primary', NULL, count(*), max(m.time), md5(string_agg(m.text, chr(10) ORDER BY o.depth, o.seq))
    FROM o JOIN memories m ON m.history_name = o.history_name AND m.memory_id = o.memory_id GROUP BY 1, 2
    """,
    "packages_by_depth": f"""{_PACKAGES}
    SELECT history_name, row_number() OVER (PARTITION BY history_name ORDER BY depth, center_id) AS place, center_id, depth, members FROM packages WHERE contains(members, ',')
    """,
    "disjoint_packages": f"""{_PACKAGES}
    SELECT history_name, row_number() OVER (PARTITION BY history_name ORDER BY path) AS place, center_id, depth, members FROM packages
    """,
    "tree_places": f"""{_PATHS}
    SELECT history_name, memory_id, path[1] AS root_id, CAST(len(path) - 1 AS BIGINT) AS depth,
      (SELECT count(*) FROM paths d WHERE d.history_name = p.history_name AND list_contains(d.path, p.memory_id)) AS size,
      row_number() OVER (PARTITION BY history_name ORDER BY path) - 1 AS place FROM paths p
    """,
    "graph_valid_facts": r"""
    WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS h, turn, trim(CASE turn % 3 WHEN 0 THEN 'the user wants ' WHEN 1 THEN 'the assistant says ' ELSE 'The user was told ' END || text, ' ') AS t FROM conversations WHERE text IS NOT NULL),
    a AS (SELECT h, turn, replace(replace(replace(replace(t, 'the user', 'User_' || h), 'the assistant', 'Asst_' || h), 'The user', 'User_' || h), 'The assistant', 'Asst_' || h) AS fact FROM s),
    m AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(fact), '\s+'), lambda x: x <> '')[1:3], ' ') AS matter FROM a),
    v AS (SELECT *, lead(turn) OVER (PARTITION BY h, matter ORDER BY turn, fact) AS invalid_at FROM m)
    SELECT h AS history_name, turn AS seq, md5(fact) AS fact_md5 FROM v WHERE invalid_at IS NULL
    """,
}
