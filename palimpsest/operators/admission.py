"""Admission of facts by five weighted features."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import strings, vectors
from ..session import ship

#: Prior of each fact type; an unknown type counts 0.5.
TYPE_PRIORS = {
    "preference": 0.9,
    "identity": 0.9,
    "belief": 0.9,
    "value": 0.9,
    "fact": 0.7,
    "knowledge": 0.7,
    "information": 0.7,
    "plan": 0.5,
    "goal": 0.5,
    "intention": 0.5,
    "task": 0.5,
    "temporary": 0.2,
    "ephemeral": 0.2,
    "transient": 0.2,
    "state": 0.3,
    "unknown": 0.5,
}
#: Patterns tried in this order, in any case; the first that is found names the type.
TYPE_PATTERNS = [
    ("identity", r"\b(my name is|i am|i'm)\s+\w+"),
    ("identity", r"\b(live in|from|based in)\s+[A-Z]\w+"),
    ("preference", r"\b(prefer|like|love|favorite)\s+\w+"),
    ("plan", r"\b(will|going to|planning to)\s+\w+"),
]
#: Substrings counted for each type when no pattern is found.
TYPE_KEYWORDS = {
    "preference": ["prefer", "like", "dislike", "hate", "love", "favorite", "enjoy", "appreciate", "avoid", "want", "wish", "喜欢", "讨厌", "偏好"],
    "identity": ["i am", "i'm", "my name is", "called", "live in", "from", "work as", "job", "profession", "我叫", "我是", "住在"],
    "fact": ["is", "are", "was", "were", "always", "never", "true", "false", "known", "是", "不是", "位于"],
    "plan": ["will", "going to", "plan to", "intend to", "scheduled", "planning", "tomorrow", "next", "打算", "计划", "将要"],
    "goal": ["want to", "hope to", "aim to", "goal", "objective", "target", "希望", "目标"],
    "temporary": ["currently", "right now", "at the moment", "today", "temporarily", "目前", "现在", "正在", "临时"],
}

WEIGHTS, THRESHOLD = (0.1, 0.1, 0.1, 0.1, 0.6), 0.55
DECAY, TAIL, NO_UTILITY = 0.12, 64, 0.5
#: Lines of context that a judge of utility sees, the last ones.
CONTEXT_LINES = 40


def parse_weights(given: str | None) -> tuple[float, ...]:
    """Five weights as CSV or a JSON list, scaled to sum 1; equal ones if blank."""
    if not given or not given.strip():
        return (0.2,) * 5
    raw = json.loads(given) if given.strip().startswith("[") else [x for x in given.split(",") if x.strip()]
    w = [float(x) for x in raw]
    if len(w) != 5 or not all(math.isfinite(x) and x >= 0 for x in w) or sum(w) <= 0:
        raise ValueError("five finite weights, none negative, not all zero")
    return tuple(x / sum(w) for x in w)


def type_of(text: Column) -> Column:
    """The type of a fact: by pattern, else by most keywords (of equal counts the first type), else unknown."""
    by_pattern = F.coalesce(*[F.when(F.regexp_like(text, F.lit("(?i)" + p)), F.lit(t)) for t, p in TYPE_PATTERNS])
    held = lambda low, keys: sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0))
    best = lambda low: F.array_max(F.array(*[F.struct(held(low, keys).alias("n"), F.lit(-i).alias("place"), F.lit(t).alias("kind")) for i, (t, keys) in enumerate(TYPE_KEYWORDS.items())]))
    # Each step over an array of one value, so that the lower-cased text and the counts are made once.
    counts = F.transform(F.array(F.lower(text)), best)
    by_keyword = F.get(F.transform(counts, lambda b: F.when(b["n"] > 0, b["kind"])), F.lit(0))
    return F.coalesce(by_pattern, by_keyword, F.lit("unknown"))


def type_prior(text: Column, given: Column | None = None) -> Column:
    """The prior of a fact's type: a given one (a blank one is unknown), else the one found."""
    t = type_of(text) if given is None else F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), F.when(given.isNotNull(), "unknown"), type_of(text))
    priors = F.create_map(*[F.lit(x) for kv in TYPE_PRIORS.items() for x in kv])
    return F.coalesce(F.try_element_at(priors, t), F.lit(TYPE_PRIORS["unknown"]))


def recency(ordinal: Column, count: Column, decay: float = DECAY) -> Column:
    """How late in its chunk a fact stands: 1 for the last."""
    return vectors.clamp(F.exp(-decay * (count - 1 - ordinal)))


def confidence(fact: Column, context_lines: Column) -> Column:
    """The best word F1 of the fact with a line of its context; 0 without common words."""
    return F.coalesce(F.array_max(F.transform(context_lines, lambda x: strings.word_f1(fact, x))), F.lit(0.0))


def utility(said: Column) -> Column:
    """A model's JSON answer as a number from 0 to 1; 0.5 for anything else."""
    return F.coalesce(vectors.clamp(strings.json_value(said, "$.utility").try_cast("double")), F.lit(NO_UTILITY))


def score(u: Column, c: Column, n: Column, r: Column, t: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    return weights[0] * u + weights[1] * c + weights[2] * n + weights[3] * r + weights[4] * t


def _novelties(rows: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by history and seq, batch by batch; the last ``TAIL`` vectors go on to the next batch."""
    names, tail = np.empty(0, object), np.empty((0, 0))
    for batch in rows:
        own, lists = batch.column("history_name").to_numpy(zero_copy_only=False), batch.column("v")
        v = np.zeros((len(own), max(int(pc.max(pc.list_value_length(lists)).as_py() or 0), tail.shape[1])))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        row = np.repeat(np.arange(len(own)), sizes)
        v[row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]] = np.asarray(pc.cast(lists.flatten(), pa.float64()))
        v[np.asarray(lists.is_null())] = np.nan
        held = np.concatenate([np.pad(tail, ((0, 0), (0, v.shape[1] - tail.shape[1]))), v])
        code = pd.factorize(np.concatenate([names, own]), use_na_sentinel=False)[0]
        old, best = len(tail), np.full(len(own), -np.inf)
        for back in range(1, min(TAIL, len(held) - 1) + 1):
            at = np.arange(max(old, back), len(held))
            at = at[code[at] == code[at - back]]
            if not len(at):  # rows of a history are together
                break
            best[at - old] = np.fmax(best[at - old], np.einsum("ij,ij->i", held[at], held[at - back]))
        novelty = np.where(np.isinf(best), 1.0, np.clip(1 - best, 0.0, 1.0))
        names, tail = np.concatenate([names, own])[-TAIL:], held[-TAIL:]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array(novelty)], schema=schema)


def novelty_setwise(facts: DataFrame, *others: str) -> DataFrame:
    """``history_name, seq, novelty`` and ``others`` of the facts: 1 less the best cosine to the 64 rows before, by place; 1 for the first.

    A task goes over sorted rows and holds a batch and the 64 vectors before it.
    """
    ship(facts.sparkSession)
    v = facts.select("history_name", "seq", *others, vectors.normalized(F.col("embedding")).alias("v"))
    kept = v.drop("v").withColumn("novelty", F.lit(0.0)).schema
    arrow = to_arrow_schema(kept)
    return v.repartition("history_name").sortWithinPartitions("history_name", "seq").mapInArrow(lambda rows: _novelties(rows, arrow), kept).select("history_name", "seq", "novelty", *others)
