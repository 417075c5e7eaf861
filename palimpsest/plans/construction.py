"""Building evaluation sets: golden facts, lowered facts, distractors, records, filler sets, configurations.

What a model says is kept in a table before it is used, since it may say something
else when asked again; ``keep`` does that, for a name and the rows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings, vectors
from ..operators import builders, golden, joins, windows
from ..sources import episodes, store
from . import artifacts, backends, prompts

Keep = Callable[[str, DataFrame], DataFrame]

#: Distractors of an item, and rounds in which they are asked for.
COUNT, ROUNDS = 8, 12
#: Distractors in the sets that are built.
SIZES = (0, 2, 4, 6, 8)


def kept_in(spark: SparkSession, folder: str) -> Keep:
    """Keeps tables below a folder; one that is finished is read, not made again."""
    stages = artifacts.Stages(spark, folder)
    return lambda name, rows: stages.once("built", name, lambda: rows)


def _memories(said: Column) -> Column:
    return windows.merged_passes(F.from_json(strings.json_value(said, "$.memories"), "array<string>"))


def session_texts(raw: DataFrame) -> DataFrame:
    """``question_id, position, date, session``: each session's transcript, by its place from 0."""
    zipped = F.arrays_zip(F.col("haystack_sessions").alias("turns"), F.col("haystack_dates").alias("date"))
    rows = raw.select("question_id", F.posexplode(zipped).alias("position", "x"))
    turns = F.transform(F.col("x.turns"), lambda t: F.struct(strings.role(t["role"]).alias("role"), F.trim(t["content"]).alias("text")))
    return rows.select("question_id", "position", F.coalesce("x.date", F.lit("")).alias("date"), windows.transcript(turns, bold=True).alias("session"))


def golden_facts(raw: DataFrame, language: backends.Language, keep: Keep, tries: int = 3) -> DataFrame:
    """``question_id, seq, text, date``: what the evidence sessions of each question say, each statement once.

    A session is asked about by itself. Questions for which nothing was found are
    asked again with all their evidence at once, ``tries`` times at most. Questions
    without an answer get a row without text.
    """
    asked = raw.select("question_id", "question", "answer")
    texts = session_texts(raw).join(golden.evidence_sessions(raw).select("question_id", "position").distinct(), ["question_id", "position"])
    texts = texts.join(asked.where(~golden.abstains(F.col("question_id"))), "question_id")
    prompt = lambda rows: rows.withColumn("prompt", prompts.rendered(prompts.GOLDEN, **{c: F.col(c) for c in ("question", "answer", "date", "session")}))
    facts = lambda rows, place: rows.select("question_id", place.alias("position"), "date", F.posexplode(_memories(F.col("response"))).alias("pos", "text"))
    found = keep("golden-0", facts(backends.completed(prompt(texts), "prompt", language), F.col("position")))
    ordered = F.sort_array(F.collect_list(F.struct("position", "date", "session")))
    whole = texts.groupBy("question_id", "question", "answer").agg(ordered.alias("s"))
    whole = whole.select("question_id", "question", "answer", F.get("s", F.lit(0))["date"].alias("date"), F.array_join(F.transform("s", lambda x: x["session"]), "\n\n").alias("session"))
    for k in range(1, tries + 1):
        left = joins.pending(whole, found, ["question_id"])
        if left.isEmpty():
            break
        more = keep(f"golden-{k}", facts(backends.completed(prompt(left), "prompt", language), F.lit(0)))
        found = found.unionByName(more)
    rows = found.withColumn("seq", F.col("position") * 1_000_000 + F.col("pos")).select("question_id", "seq", "text", "date")
    none = asked.where(golden.abstains(F.col("question_id"))).select("question_id", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("text"), F.lit("").alias("date"))
    return golden.dated(golden.consolidated(rows)).unionByName(none)


def _similar(rows: DataFrame, embedding: backends.Embedding) -> DataFrame:
    """Adds ``sim``, the cosine of text and question."""
    both = backends.embedded(backends.embedded(rows, "text", embedding, "_t"), "question", embedding, "_q")
    return both.withColumn("sim", vectors.cosine(F.col("_t"), F.col("_q"))).drop("_t", "_q")


def _answers(rows: DataFrame, judge: backends.Language) -> DataFrame:
    """Adds ``gives``, whether a judge finds the answer in the text."""
    asked = rows.withColumn("_p", prompts.judged_text(F.col("question"), F.col("answer"), F.col("text"), F.lit(None)))
    return backends.completed(asked, "_p", judge, "_said").withColumn("gives", F.coalesce(strings.verdict(F.col("_said")), F.lit(False))).drop("_p", "_said")


def lowered_facts(facts: DataFrame, language: backends.Language, judge: backends.Language, embedding: backends.Embedding, keep: Keep, rounds: int = 3) -> DataFrame:
    """``question_id, seq, text, min_sim``: of ``rounds`` rewrites that still give the answer, the least like the question.

    ``facts``: question_id, seq, question, answer, text. A fact without such a rewrite is left out.
    """
    tried = facts.where("text is not null").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    asked = tried.withColumn("prompt", F.concat(prompts.rendered(prompts.LOWER, **{c: F.col(c) for c in ("question", "answer", "text")}), F.lit("\nRound: "), F.col("round").cast("string")))
    said = backends.completed(asked, "prompt", language).withColumn("text", strings.response_text(F.col("response"))).where("text <> ''").drop("prompt", "response")
    judged = keep("lowered", _answers(_similar(said, embedding), judge))
    key = judged.withColumns({"ok": F.col("gives"), "key": F.struct("question_id", "seq")})
    return builders.lowered(key, "key").select("key.question_id", "key.seq", "text", "min_sim")


def distractor_facts(items: DataFrame, language: backends.Language, judge: backends.Language, embedding: backends.Embedding, keep: Keep, count: int = COUNT, rounds: int = ROUNDS) -> DataFrame:
    """``question_id, place, text``: exactly ``count`` for each item, or none within ``rounds`` rounds.

    ``items``: question_id, question, answer, min_sim. A distractor is about the
    user, more like the question than its least similar lowered fact, and neither
    holds the answer nor, to the judge, gives it.
    """
    found, wanted = None, items
    for k in range(rounds):
        if k:
            full = builders.distractors(found, "question_id", count).select("question_id").distinct()
            wanted = joins.pending(items, full, ["question_id"])
            if wanted.isEmpty():
                break
        asked = wanted.withColumn("prompt", prompts.rendered(prompts.DISTRACT, question=F.col("question"), answer=F.col("answer"), round=F.lit(str(k))))
        said = backends.completed(asked, "prompt", language).select("question_id", "question", "answer", "min_sim", F.posexplode(strings.lines(F.col("response"))).alias("pos", "text"))
        said = said.where(strings.about_user(F.col("text"))).withColumn("seq", F.lit(k * 1_000_000) + F.col("pos"))
        passed = keep(f"distractors-{k}", _answers(_similar(said, embedding), judge).where("not gives"))
        found = passed if found is None else found.unionByName(passed)
    return builders.distractors(found, "question_id", count).select("question_id", "place", "text")


def records(questions: DataFrame, lowered: DataFrame, distractors: DataFrame) -> DataFrame:
    """``question_id, question, answer, facts, distractors``: the parts of each item, distractors a year before its facts.

    ``lowered`` has ``question_id, seq, text, date``. Items without either are left out.
    """
    facts = lowered.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text", "date"))).alias("facts"), F.min_by("date", "seq").alias("_date"))
    facts = facts.withColumn("_date", golden.a_year_before(F.col("_date")))
    others = distractors.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("d"))
    both = questions.join(facts, "question_id").join(others, "question_id")
    dated = F.transform("d", lambda x: F.struct(x["place"].alias("place"), x["text"].alias("text"), F.col("_date").alias("date")))
    return both.select("question_id", "question", "answer", "facts", dated.alias("distractors"))


def filler_sets(distractors: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``n`` and the first n distractors of each item, for every size; a row of no text for n = 0.

    ``distractors``: question_id, place (from 1), text.
    """
    every = distractors.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes if n])))
    some = every.where("place <= n").select("n", "question_id", "place", "text")
    if 0 not in sizes:
        return some
    none = distractors.select(F.lit(0).alias("n"), "question_id", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("text")).distinct()
    return some.unionByName(none)


def configurations(base: dict, axes: dict[str, list]) -> list[tuple[str, dict]]:
    """A name and a configuration for each combination of values of dotted paths, in the paths' order."""
    out = []
    for values in itertools.product(*axes.values()):
        own = json.loads(artifacts.canonical(base))
        for path, value in zip(axes, values, strict=True):
            at = own
            *parents, last = path.split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = value
        out.append(("_".join(f"{p.rpartition('.')[2]}-{v}" for p, v in zip(axes, values, strict=True)) or "base", own))
    return out


def write_configurations(folder: str, given: list[tuple[str, dict]]) -> list[str]:
    """A JSON file for each configuration."""
    paths = [f"{folder.rstrip('/')}/{name}.json" for name, _ in given]
    for path, (_, config) in zip(paths, given, strict=True):
        store.write_json(path, config)
    return paths


def migrated(spark: SparkSession, folder: str, stages: artifacts.Stages, key: str) -> DataFrame:
    """Candidate files of an older layout as the facts of a candidate stage; the files stay."""
    return stages.once("candidate", key, lambda: episodes.facts(episodes.read_candidates(spark, folder)), source=folder)
