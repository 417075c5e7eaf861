"""Retrieval within a history: dense, BM25, hybrid, with visibility before ranking; context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, strings, vectors

K1, B, EPSILON = 1.5, 0.75, 0.25
#: A pool's rows for each row that is asked for, and the least pool.
POOL_MULT, LEAST_POOL = 4, 50
NOTHING = "No relevant memories found."


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def scored(questions: DataFrame, memories: DataFrame, visible: Column | None = None) -> DataFrame:
    """Every question with every visible memory of its history and their cosine.

    ``questions``: history_name, query_id, query. Vectors are normalised once on
    each side, before the join; the join is on the history, never on everything.
    """
    rows = memories if visible is None else memories.where(visible)
    m = rows.select("history_name", "memory_id", "seq", vectors.normalized(F.col("embedding")).alias("_v"))
    q = questions.select("history_name", "query_id", vectors.normalized(F.col("query")).alias("_q"))
    return q.join(m, "history_name").select("history_name", "query_id", "memory_id", "seq", vectors.dot(F.col("_q"), F.col("_v")).alias("score"))


def dense(questions: DataFrame, memories: DataFrame, k: int, visible: Column | None = None) -> DataFrame:
    """The k visible memories of each question by cosine, ties to the earlier row."""
    return top(scored(questions, memories, visible), ["history_name", "query_id"], [F.desc("score"), F.asc("seq")], k)


def similar(questions: DataFrame, memories: DataFrame, threshold: float, k: int, visible: Column | None = None, earlier: bool = True) -> DataFrame:
    """Candidates of a new fact: at least the threshold, at most k, best first; only rows before it."""
    pairs = scored(questions, memories, visible).where(F.col("score") >= threshold)
    if earlier:
        pairs = pairs.where("memory_id < query_id")
    return top(pairs, ["history_name", "query_id"], [F.desc("score"), F.asc("seq")], k)


def batch_union(questions: DataFrame, memories: DataFrame, k: int, cap: int, batch: Column) -> DataFrame:
    """Neighbours of a batch of facts, each once with the score first met; beyond the cap the best by score.

    Rows keep the order in which they were found; ``temp_id`` numbers them from 0.
    """
    hits = dense(questions, memories, k).withColumn("batch", batch)
    met = hits.groupBy("history_name", "batch", "memory_id").agg(F.min(F.struct("query_id", "rank", "score")).alias("f"))
    flat = met.select("history_name", "batch", "memory_id", "f.*")
    group = ["history_name", "batch"]
    kept = flat.withColumn("_best", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), "query_id", "rank"))).where(F.col("_best") <= cap)
    return kept.withColumn("temp_id", F.row_number().over(W.partitionBy(*group).orderBy("query_id", "rank")) - 1).drop("_best")


def bm25(queries: DataFrame, texts: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """``history_name, query_id, memory_id, seq, bm25`` for memories that share a term with the query.

    Okapi weights over all texts of a history. A term in more than half of them
    gets epsilon times the mean weight of the history's terms. A term counts as
    often as the query has it.
    """
    words = texts.select("history_name", "memory_id", "seq", F.explode(strings.tokens(F.col("text"))).alias("term"))
    tf = words.groupBy("history_name", "memory_id", "seq", "term").agg(F.count("*").alias("tf"))
    size = texts.select("history_name", "memory_id", F.size(strings.tokens(F.col("text"))).alias("dl"))
    total = size.groupBy("history_name").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("history_name", "term").agg(F.count("*").alias("df"))
    raw = df.join(total, "history_name").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("history_name").agg(F.avg("raw").alias("mean"))
    idf = raw.join(mean, "history_name").select("history_name", "term", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("history_name", "query_id", F.explode(strings.tokens(F.col("query_text"))).alias("term")).groupBy("history_name", "query_id", "term").agg(F.count("*").alias("times"))
    hits = asked.join(tf, ["history_name", "term"]).join(size, ["history_name", "memory_id"]).join(idf, ["history_name", "term"])
    weight = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("history_name", "query_id", "memory_id", "seq").agg(F.sum(weight).alias("bm25"))


def hybrid(questions: DataFrame, memories: DataFrame, k: int, dense_weight: float = 0.5, bm25_weight: float = 0.5, pool_mult: int | None = 4, visible: Column | None = None, cut: bool = True) -> DataFrame:
    """Dense and BM25 pools of at least 50 rows each, scaled by their best visible row, weighted and ranked.

    Without ``pool_mult`` the pools are all rows of the history, and all are ranked;
    without ``cut`` all rows of the pools are.

    Rows that are not visible are dropped after the pools are cut. Negative
    weights count as 0; if both are 0, dense counts alone.
    """
    from . import postings

    wd, wb = max(0.0, dense_weight), max(0.0, bm25_weight)
    wd, wb = (1.0, 0.0) if wd + wb == 0 else (wd / (wd + wb), wb / (wd + wb))
    group = ["history_name", "query_id"]
    pooled = lambda rows, order: rows if pool_mult is None else top(rows, group, order, max(k * pool_mult, LEAST_POOL))
    d = pooled(scored(questions, memories), [F.desc("score"), F.asc("seq")]).select(*group, "memory_id", F.col("score").alias("d"))
    words = postings.bm25_top(questions, memories.select("history_name", "memory_id", "seq", "text"), None if pool_mult is None else max(k * pool_mult, LEAST_POOL), nulls=False).drop("rank")
    t = words.select(*group, "memory_id", F.col("bm25").alias("t"))
    flags = memories.select("history_name", "memory_id", (F.lit(True) if visible is None else visible).alias("_v"))
    both = d.join(t, [*group, "memory_id"], "full_outer").join(flags, ["history_name", "memory_id"]).where("_v")
    best = W.partitionBy(*group)
    share = lambda c: F.when(F.max(c).over(best) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.max(c).over(best)).otherwise(0.0)
    parts = both.withColumns({"dense_part": share("d"), "bm25_part": share("t")})
    scores = parts.withColumn("score", wd * F.col("dense_part") + wb * F.col("bm25_part"))
    # Scores are compared at nine places, so that the order does not hang on the last bits.
    order = [F.desc(F.round("score", 9)), F.desc(F.round("bm25_part", 9)), F.desc(F.round("dense_part", 9)), F.asc("memory_id")]
    placed = top(scores, group, order, k) if cut and pool_mult is not None else scores.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return placed.select(*group, "rank", "memory_id", "score")


def retrieve(questions: DataFrame, memories: DataFrame, k: int, visible: Column | None = None, mixed: dict | None = None, fused: DataFrame | None = None) -> DataFrame:
    """``history_name, query_id, rank, memory_id`` by the settings: dense, or ``mixed`` with BM25.

    ``mixed`` holds the weights (``dense_weight``, ``bm25_weight``, ``pool_mult``,
    which with ``full_corpus_pool`` does not count).
    With ``fused`` rows the memories are those before the fusion. A pool of them is
    ranked, evidence and hidden rows too, and each hit counts for the fused row that
    holds it; ``visible`` plays no part there.
    """
    mixed = None if mixed is None else dict(mixed)
    if mixed and mixed.pop("full_corpus_pool", False):
        mixed["pool_mult"] = None
    if fused is None:
        hits = dense(questions, memories, k, visible) if mixed is None else hybrid(questions, memories, k, **mixed, visible=visible, cut=True)
        return top(hits, ["history_name", "query_id"], [F.asc("rank")], k).select("history_name", "query_id", "rank", "memory_id")
    if mixed is None:
        hits = dense(questions, memories, max(k * POOL_MULT, LEAST_POOL))
    else:
        hits = hybrid(questions, memories, k, **mixed, cut=False)
    return through_fused(hits, fused, k).select("history_name", "query_id", "rank", F.col("fused_id").alias("memory_id"))


def through_fused(hits: DataFrame, fused: DataFrame, k: int) -> DataFrame:
    """Hits on members as hits on the fused rows that hold them: the first for each, ranked anew.

    ``fused``: history_name, fused_id, seq, member_ids. A member in several fused
    rows belongs to the last of them.
    """
    owner = fused.select("history_name", "fused_id", "seq", F.explode("member_ids").alias("memory_id")).groupBy("history_name", "memory_id").agg(F.max_by("fused_id", "seq").alias("fused_id"))
    first = hits.select("history_name", "query_id", "rank", "memory_id").join(owner, ["history_name", "memory_id"]).groupBy("history_name", "query_id", "fused_id").agg(F.min("rank").alias("first_rank"))
    return top(first, ["history_name", "query_id"], [F.asc("first_rank")], k)


def within_sessions(hits: DataFrame, cutoff: Column) -> DataFrame:
    """Hits of sessions up to the cutoff, or without a session number; applied after ranking."""
    number = F.col("session_index").try_cast("int")
    return hits.where(number.isNull() | (number <= cutoff))


def trimmed(c: Column, limit: int | None) -> Column:
    """The first ``limit`` words; the text as it is without a limit."""
    if limit is None:
        return c
    return F.array_join(F.slice(F.filter(F.split(c, r"\s+"), lambda x: x != ""), 1, limit), " ")


def context(hits: DataFrame, show_time: bool = True) -> DataFrame:
    """``history_name, query_id, units, context``: numbered memories in rank order, with their time.

    ``hits``: rank, text, time, and optionally fused_member_count (several: no time).
    """
    timed = F.lit(show_time) & F.col("time").isNotNull() & (F.col("time") != "")
    if "fused_member_count" in hits.columns:
        timed &= F.coalesce(F.col("fused_member_count"), F.lit(1)) <= 1
    head = F.when(timed, F.concat(F.lit(" ("), dates.strip_clock(F.col("time")), F.lit(")"))).otherwise("")
    unit = F.concat(F.lit("Memory "), F.col("rank").cast("string"), head, F.lit(":\n"), F.col("text"))
    got = hits.withColumn("unit", unit).groupBy("history_name", "query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "unit"))).alias("u"))
    return got.select("history_name", "query_id", F.size("u").alias("units"), F.array_join(F.transform("u", lambda x: x["unit"]), "\n\n").alias("context"))


def or_nothing(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """A context for every question; a fixed text where nothing was found."""
    key = ["history_name", "query_id"]
    return questions.select(*key).join(contexts, key, "left").select(*key, F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("context", F.lit(NOTHING)).alias("context"))
