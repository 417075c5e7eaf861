"""The experiment: extract, ingest, answer, judge; each stage is a table kept by fingerprint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, rouge, strings
from ..operators import admission, folds, joins, memory, metrics, retrieval, windows
from ..sources import episodes
from . import artifacts, backends, prompts


def extract(turns: DataFrame, size: int | str, overlap: int, language: backends.Language, aspects: list[str] | None = None, aspects_only: bool = False) -> DataFrame:
    """Facts of each chunk of turns; answers that are no JSON list give none.

    Each template is a pass over the chunk: the general one, unless ``aspects_only``,
    and those of ``prompts.ASPECTS`` that are named; of equal facts the first counts.
    """
    templates = ([] if aspects_only else [prompts.EXTRACT]) + [prompts.ASPECTS[x] for x in aspects or []]
    if not templates:
        raise ValueError("no template to extract with")
    rows = turns.withColumn("conv", F.concat_ws("\x1f", "history_name", "session_no")).withColumnsRenamed({"turn": "at"})
    got = windows.chunks(rows, "conv", "at", size, overlap)
    parts = F.split("conv", "\x1f")
    asked = got.select(F.get(parts, F.lit(0)).alias("history_name"), F.get(parts, F.lit(1)).cast("int").alias("session_index"), "chunk_index", "transcript")
    passes = []
    for i, template in enumerate(templates):
        asked = backends.completed(asked.withColumn("prompt", prompts.rendered(template, dialogue=F.col("transcript"))), "prompt", language, f"said_{i}")
        passes.append(F.from_json(strings.json_value(F.col(f"said_{i}"), "$.memories"), "array<string>"))
    return asked.select("history_name", "session_index", "chunk_index", "transcript", windows.merged_passes(*passes).alias("facts"))


def ordered(extracted: DataFrame, dates_of: DataFrame) -> DataFrame:
    """Facts as rows in order, with their session's date, their place in the chunk, and the chunk's transcript."""
    rows = extracted.select("history_name", "session_index", "chunk_index", "transcript", F.size("facts").alias("of"), F.posexplode("facts").alias("pos", "text"))
    seq = F.row_number().over(W.partitionBy("history_name").orderBy("session_index", "chunk_index", "pos")) - 1
    return rows.withColumn("seq", seq).join(dates_of.select("history_name", F.col("session_no").alias("session_index"), F.col("session_date").alias("time")), ["history_name", "session_index"], "left")


# Methods of ingest: functions from embedded facts in order, settings and backends to rows of the memory table.


@dataclass
class Backends:
    """The models of an ingest; without one the offline rule stands in."""

    language: backends.Language | None = None
    embedding: backends.Embedding | None = None


def _add_all(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    return memory.add_all(facts)


def scored(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    """The features of admission that do not depend on what was admitted."""
    lines = strings.lines(F.col("transcript"))
    rows = facts.withColumns({"confidence": rouge.best_f(F.col("text"), lines), "recency": admission.recency(F.col("pos"), F.col("of")), "type_prior": admission.type_prior(F.col("text"))})
    if models.language is None or settings.get("skip_utility"):
        return rows.withColumn("utility", F.lit(admission.NO_UTILITY))
    tail = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - admission.CONTEXT_LINES + 1), F.lit(admission.CONTEXT_LINES)), "\n")
    asked = rows.withColumn("prompt", prompts.rendered(prompts.UTILITY, context=tail, fact=F.col("text")))
    return backends.completed(asked, "prompt", models.language, "said").withColumn("utility", admission.utility(F.col("said"))).drop("prompt", "said")


def _amac(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    weights = admission.parse_weights(settings["weights"]) if settings.get("weights") else admission.WEIGHTS
    admit = partial(folds.admit, weights=weights, threshold=settings.get("threshold", admission.THRESHOLD), chunk="chunk")
    rows = _chunked(scored(facts, settings, models)).select("history_name", "seq", "text", "when", "chunk", "embedding", "utility", "confidence", "recency", "type_prior")
    admitted = folds.folded(rows, admit, folds.ADMIT).where("admitted")
    kept = facts.join(admitted.select("history_name", "seq"), ["history_name", "seq"], "left_semi")
    return memory.deduplicated(kept.withColumn("memory_role", F.lit(None).cast("string")))


def _chunked(facts: DataFrame) -> DataFrame:
    """Facts with the chunk after which equal texts are dropped, and their time in seconds."""
    return facts.withColumns({"chunk": F.concat_ws("/", "session_index", "chunk_index"), "when": dates.parse_chat_time(F.col("time")).cast("double")})


def _evermemos(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    at = facts.select("history_name", "seq", "embedding", dates.parse_chat_time(F.col("time")).cast("double").alias("at"))
    cluster = partial(folds.cluster, threshold=settings.get("threshold", 0.65), gap_days=settings.get("gap_days", 7.0))
    rows = memory.clusters_finalized(facts.join(folds.folded(at, cluster, folds.CLUSTER), ["history_name", "seq"])).withColumnRenamed("seq", "first")
    place = F.row_number().over(W.partitionBy("history_name").orderBy("cluster", F.desc("memory_role"), "first")) - 1
    return rows.withColumn("seq", place.cast("long"))


def relation_settings(settings: dict, models: Backends) -> dict:
    """A relation store's settings: labels and fused texts by the language model if there is one."""
    out = {k: settings[k] for k in ("threshold", "k") if k in settings}
    if "active" in settings:
        out["active"] = tuple(settings["active"])
    if models.language is not None:
        out["label"] = backends.RelationLabels(models.language)
        if not settings.get("no_fusion"):
            out["fuse"] = backends.Fusion(models.language)
    if models.embedding is not None:
        out["embed"] = partial(_embed, models.embedding)
    return out


def _embed(embedding: backends.Embedding, text: str) -> list[float]:
    return embedding.embed([text])[0]


def _relations(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    own = relation_settings(settings, models)
    return folds.joined(_chunked(facts), partial(folds.relate, chunk="chunk", **own), folds.RELATE, own.get("threshold", folds.THRESHOLD)).withColumn("seq", F.col("memory_id"))


def decisions(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    """``history_name, seq, event, detail``: what relation decisions met, planned and wrote."""
    own = relation_settings(settings, models)
    return folds.joined(_chunked(facts), partial(folds.decisions, chunk="chunk", **own), folds.DECISIONS, own.get("threshold", folds.THRESHOLD))


def _operations(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    own = {"allow_delete": settings.get("allow_delete", True), "k": settings.get("k", 5), "cap": settings.get("cap", 50)}
    if models.language is not None:
        own["decide"] = backends.Decisions(models.language)
    embed = partial(_embed, models.embedding) if models.embedding is not None else None
    rows = facts.withColumn("batch", F.concat_ws("/", "session_index", "chunk_index"))
    left = folds.folded(rows, partial(folds.operated, batch="batch", embed=embed, **own), folds.OPERATED)
    return memory.deduplicated(left.withColumn("memory_role", F.lit(None).cast("string")))


def _graph(facts: DataFrame, settings: dict, models: Backends) -> DataFrame:
    edges = memory.valid_edges(memory.graph_edges(facts))
    return edges.withColumn("text", F.col("fact"))


#: Ingest methods by name.
METHODS: dict[str, Callable[[DataFrame, dict, Backends], DataFrame]] = {"add_all": _add_all, "amac": _amac, "relation_decision": _relations, "mem0": _operations, "evermemos": _evermemos, "zep": _graph}
#: Methods whose rows are hidden from answers; those of all others are all searched.
HIDING = ("relation_decision",)


def ingest(facts: DataFrame, method: str, settings: dict, models: Backends | None = None) -> DataFrame:
    """The memory table of one method from embedded facts in order."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(METHODS)}")
    rows = METHODS[method](facts, settings, models or Backends())
    full = {"memory_role": "string", "parent_primary": "long", "answer_hidden": "boolean", "answer_id": "long", "stale": "boolean", "fused_member_count": "long"}
    for name, kind in full.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("memory_id", F.col("seq")) if "memory_id" not in rows.columns else rows
    return rows.select("history_name", "memory_id", "seq", "text", "time", *full)


def fused(memories: DataFrame, language: backends.Language | None = None) -> DataFrame:
    """The store after bundle fusion; bundles' texts by the language model if there is one, else joined."""
    if language is None:
        return memory.fused_store(memories)
    edge = F.col("edge") if "edge" in memories.columns else F.lit(None).cast("string")
    tree = memory.descendants(memories).join(memories.select("history_name", "memory_id", "text", edge.alias("edge"), "parent_primary"), ["history_name", "memory_id"])
    lines = F.sort_array(F.collect_list(F.struct("depth", "seq", "memory_id", "text", "edge", "parent_primary")))
    bundles = tree.groupBy("history_name", "root_id").agg(lines.alias("m"), F.count("*").alias("n")).where("n > 1")
    number = lambda x: F.array_position(F.transform("m", lambda y: y["memory_id"]), x["parent_primary"])
    said = F.transform("m", lambda x: F.struct(x["text"].alias("text"), F.when(x["depth"] > 0, x["edge"]).alias("edge"), number(x).alias("parent")))
    asked = bundles.withColumn("prompt", prompts.rendered(prompts.BUNDLE, lines=prompts.bundle_lines(said)))
    return memory.fused_store(memories, backends.completed(asked, "prompt", language, "text"))


def fuse_copy(spark: SparkSession, stages: artifacts.Stages, source: str, key: str, language: backends.Language | None = None) -> DataFrame:
    """A fused copy of a finished ingest; the source stays, and a copy that is there is not made again."""
    path = stages.path("ingest", source)
    about = {"upstream": source, "model": backends.identity(language)}
    return stages.once("fusion", key, lambda: fused(spark.read.parquet(path), language), **about)


def answer(memories: DataFrame, questions: DataFrame, method: str, k: int, limit: int | None, language: backends.Language, embedding: backends.Embedding, mixed: dict | None = None, fused_rows: DataFrame | None = None, show_time: bool = True, trim: Callable[[Column, int | None], Column] = retrieval.trimmed) -> DataFrame:
    """Predictions: the trimmed context of each question, and the model's answer to it.

    ``mixed`` has the weights of hybrid retrieval. With ``fused_rows`` (a fused copy
    of ``memories``) rows are ranked before the fusion and read after it. ``trim``
    cuts a context to a number of tokens.
    """
    m = backends.embedded(memories, "text", embedding)
    q = backends.embedded(questions, "question", embedding, "query").withColumns({"query_id": F.col("question_id"), "query_text": F.col("question")})
    visible = memory.answer_visible() if method in HIDING else None
    owners = None if fused_rows is None else fused_rows.select("history_name", F.col("memory_id").alias("fused_id"), "seq", F.coalesce("member_ids", F.array("memory_id")).alias("member_ids"))
    hits = retrieval.retrieve(q, m, k, visible, mixed, owners)
    texts = (memories if fused_rows is None else fused_rows).select("history_name", "memory_id", "text", "time", "fused_member_count")
    hits = hits.join(texts, ["history_name", "memory_id"])
    got = retrieval.or_nothing(q, retrieval.context(hits, show_time)).withColumn("context", trim(F.col("context"), limit))
    asked = questions.join(got.withColumnRenamed("query_id", "question_id"), ["history_name", "question_id"])
    return backends.completed(asked.withColumn("prompt", prompts.rendered(prompts.ANSWER, context=F.col("context"), question=F.col("question"))), "prompt", language, "model_answer")


def judge(predictions: DataFrame, language: backends.Language, use_cot: bool = True) -> DataFrame:
    """Verdicts; a call without an answer is a failure and judges nothing."""
    held = lambda c: F.col(c) if c in predictions.columns else F.lit(None).cast("string")
    asked = predictions.withColumn("prompt", prompts.judged_text(held("question"), held("answer"), held("model_answer"), held("hypothesis"), use_cot))
    said = backends.completed(asked, "prompt", language, "verdict")
    failed = F.col("verdict").isNull()
    return said.withColumns({"judge_api_failed": failed, "is_correct": F.when(~failed, strings.verdict(F.col("verdict")))})


@dataclass
class Run:
    """One configuration and method: its models, and the fingerprints of its stages."""

    config: dict
    method: str
    extractor: backends.Language
    answerer: backends.Language
    judging: backends.Language
    embedding: backends.Embedding
    manager: backends.Language | None = None
    nonce: str = ""
    keys: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        models = {
            "candidate": [self.extractor], "ingest": [self.manager, self.embedding], "fusion": [self.manager],
            "answer": [self.answerer, self.embedding], "judge": [self.judging],
        }
        if not self.value("generate.rank_before_fusion", False):
            del models["fusion"]
        upstream = ""
        for stage, used in models.items():
            upstream = self.keys[stage] = artifacts.fingerprint(
                stage, self.config, upstream, "" if stage == "candidate" else self.method,
                artifacts.templates_of(stage), [backends.identity(x) for x in used], self.nonce,
            )

    def value(self, path: str, default=None):
        return artifacts.look_up(self.config, path, default)


def sampled(rows: DataFrame, n: int | None, seed: int) -> DataFrame:
    """Rows of a stratified sample of n questions; all of them without a positive n."""
    if not n or n <= 0:
        return rows
    typed = rows if "question_type" in rows.columns else rows.withColumn("question_type", F.lit(None).cast("string"))
    return rows.join(joins.stratified(typed, n, seed).select("history_name", "question_id"), ["history_name", "question_id"], "left_semi")


def judged(spark: SparkSession, stages: artifacts.Stages, run: Run, sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """All stages of a run; what is there under the same fingerprint is not made again.

    With ``experiment.keep_answers`` what models say is kept below the root, so that a
    task that runs again asks nothing twice.
    """
    key, of = run.keys, run.value
    kept = lambda model: backends.Kept(model, f"{stages.root}/answers") if of("experiment.keep_answers", False) else model
    facts = stages.once("candidate", key["candidate"], lambda: ordered(extract(episodes.turns(sessions), of("extract.granularity", "all"), of("extract.turn_overlap", 0), kept(run.extractor), of("extract.aspect_templates"), of("extract.aspects_only", False)), sessions))
    models = Backends(run.manager, run.embedding)
    held = stages.once("ingest", key["ingest"], lambda: ingest(backends.embedded(facts, "text", run.embedding), run.method, of(f"methods.{run.method}", {}), models), upstream=key["candidate"], method=run.method)
    mixed = of("generate.hybrid") or {}
    weights = {k: v for k, v in mixed.items() if k != "enabled"} if mixed.get("enabled", bool(mixed)) else None
    k, limit, show = of("generate.retrieve_topk", 50), of("generate.memory_token_limit"), of("generate.show_memory_time", True)
    after = fuse_copy(spark, stages, key["ingest"], key["fusion"], run.manager) if "fusion" in key else None
    asked = sampled(questions, of("generate.answer_stratified_sample"), of("generate.answer_sample_seed", 42))
    predicted = stages.once("answer", key["answer"], lambda: answer(held, asked, run.method, k, limit, kept(run.answerer), run.embedding, weights, fused_rows=after, show_time=show), upstream=key.get("fusion", key["ingest"]), method=run.method)
    picked = sampled(predicted, of("evaluate.judge_stratified_sample"), of("evaluate.judge_sample_seed", 42))
    return stages.once("judge", key["judge"], lambda: judge(picked, kept(run.judging), of("evaluate.use_cot", True)), upstream=key["answer"], method=run.method)


def run(spark: SparkSession, root: str, config: dict, sessions: DataFrame, questions: DataFrame, method: str, extractor: backends.Language, answerer: backends.Language, judging: backends.Language, embedding: backends.Embedding, manager: backends.Language | None = None, nonce: str = "") -> DataFrame:
    """The metrics of one configuration and method."""
    own = Run(config, method, extractor, answerer, judging, embedding, manager, nonce)
    return metrics.judge_metrics(judged(spark, artifacts.Stages(spark, root), own, sessions, questions))


def scheduled(runs: list[Run]) -> list[tuple[str, str, str]]:
    """The stages (name, fingerprint, method) of several runs in an order that respects what they need, each once."""
    found: dict[tuple[str, str], str] = {}
    for stage in ("candidate", "ingest", "fusion", "answer", "judge"):
        for r in (r for r in runs if stage in r.keys):
            found.setdefault((stage, r.keys[stage]), "" if stage == "candidate" else r.method)
    return [(stage, key, method) for (stage, key), method in found.items()]


def run_variants(spark: SparkSession, root: str, variants: list[tuple[str, dict]], methods: list[str], sessions: DataFrame, questions: DataFrame, **models) -> DataFrame:
    """The metrics of every variant and method, with ``variant_id`` and ``method``; shared stages are made once."""
    stages, out = artifacts.Stages(spark, root), None
    for name, config in variants:
        for method in methods:
            own = judged(spark, stages, Run(config, method, **models), sessions, questions)
            got = metrics.judge_metrics(own).withColumns({"variant_id": F.lit(name), "method": F.lit(method)})
            out = got if out is None else out.unionByName(got)
    return out
