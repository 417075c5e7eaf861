"""Folds and windows as streams: facts arrive, histories keep state, edges are exported once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

_OUT = "history_name string, seq long, text string, is_new boolean"
_STATE = "seen boolean"


def _take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Facts of one history and trimmed text: the first of them is new, unless the text is blank."""
    new = not state.exists
    rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
    text = rows["text"].iloc[0]
    state.update((True,))
    yield pd.DataFrame({"history_name": rows["history_name"], "seq": rows["seq"], "text": rows["text"], "is_new": [new and i == 0 and bool(text) for i in range(len(rows))]})


def ingested(facts: DataFrame) -> DataFrame:
    """A stream of facts (history_name, seq, text) with the ones that are new to their history.

    State is a flag for each history and text, so a batch touches only what it brings.
    """
    ship(facts.sparkSession)
    text = F.trim(F.coalesce("text", F.lit("")))
    keyed = facts.select("history_name", "seq", text.alias("text"), F.md5(text).alias("text_md5"))
    return keyed.groupBy("history_name", "text_md5").applyInPandasWithState(_take, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, at: str, key: str, gap: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events of a key that follow each other within a gap, as sessions."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "n")


def exported_once(edges: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Edges whose key was not seen before, within the watermark."""
    return edges.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
