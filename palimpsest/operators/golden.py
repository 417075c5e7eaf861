"""Golden facts: what a question's evidence says, where it stands, and when it was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates


def abstains(question_id: Column) -> Column:
    """Questions that have no answer."""
    return question_id.endswith("_abs")


def answerable(questions: DataFrame, golden: DataFrame) -> DataFrame:
    """Questions with golden facts that do not abstain."""
    return questions.where(~abstains(F.col("question_id"))).join(golden.select("question_id").distinct(), "question_id", "left_semi")


def evidence_sessions(raw: DataFrame) -> DataFrame:
    """``question_id, session_id, position`` of the sessions that hold the answer; the first of equal ids, from 0."""
    place = F.array_position("haystack_session_ids", F.col("s"))
    return raw.select("question_id", "haystack_session_ids", F.explode("answer_session_ids").alias("s")).select("question_id", F.col("s").alias("session_id"), (place - 1).alias("position")).where("position >= 0")


def consolidated(facts: DataFrame) -> DataFrame:
    """Facts of a question once each, in the order found; earlier dates win."""
    once = W.partitionBy("question_id", F.lower(F.trim("text"))).orderBy(dates.chat_time_or_last(F.col("date")), "seq")
    return facts.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def dated(facts: DataFrame) -> DataFrame:
    """Facts with a date: their own, else the one their text names."""
    return facts.withColumn("date", F.coalesce(F.nullif(F.trim("date"), F.lit("")), dates.date_from_text(F.col("text"))))


def a_year_before(date: Column) -> Column:
    """A date moved one year back, in its own form; unreadable ones stay."""
    t = dates.parse_session_date(date)
    moved = F.add_months(t, -12)
    tail = F.regexp_replace(date, r"^\s*\d{4}[/-]\d{1,2}[/-]\d{1,2}", "")
    return F.when(t.isNull(), date).otherwise(F.concat(F.date_format(moved, "yyyy/MM/dd"), tail))


#: Phrases that only say when; a proposal for their removal is checked by hand.
TIME_PHRASES = r"(?i)\s*\b(?:last|this|next)\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\s*\b(?:yesterday|today|tomorrow)\b|\s*\b(?:on|in|since)\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)(?:\s+\d{1,2}(?:st|nd|rd|th)?)?(?:,?\s+\d{4})?\b"


def without_time(text: Column) -> Column:
    """The text without phrases of time."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, TIME_PHRASES, ""), r"\s{2,}", " "))


def edited(rows: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the texts that a review accepted."""
    new = edits.where("accepted").select(*key, F.col("text").alias("_new"))
    return rows.join(new, key, "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
