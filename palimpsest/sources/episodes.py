"""Episodes: raw benchmark documents, the canonical form, candidate files, JSON lines."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates

TURN = "struct<role string, content string, has_answer boolean>"
#: One row for each history, as the benchmark delivers it.
RAW = f"question_id string, question string, answer string, question_type string, question_date string, haystack_dates array<string>, haystack_sessions array<array<{TURN}>>, haystack_session_ids array<string>, answer_session_ids array<string>"
#: The preprocessed form: sessions keyed by ``session_k``; older files have parallel lists.
CANONICAL = f"history_id string, history_name string, question_id string, chat_time map<string,string>, chat_history map<string,array<{TURN}>>"
LEGACY = f"history_id string, history_name string, question_id string, chat_time array<string>, chat_history array<array<{TURN}>>"
CANDIDATES = "history_name string, model string, memory_granularity string, turn_overlap int, dialogue_format string, chunks array<struct<chunk_index int, session_index int, turn_start int, turn_end int, session_date string, candidate_memories array<string>, parse_error string, source string>>"
#: Names of metadata files beside candidate files.
METADATA = ("stage_manifest.json", "extract_progress.state")

_REGISTRY: dict[str, tuple[str, str]] = {}


def register(name: str, path: str, language: str = "en") -> None:
    """Make a dataset known by name."""
    _REGISTRY[name] = (path, language)


def resolve(name: str, override: str | None = None) -> tuple[str, str]:
    """Path and language of a dataset; an override file is English."""
    if override:
        return override, "en"
    if name not in _REGISTRY:
        raise KeyError(f"unknown benchmark {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def raw_or_preprocessed(path: str, spark: SparkSession | None = None) -> tuple[str, bool]:
    """The preprocessed file if it is there, else its raw sibling; and whether it is raw.

    With a session, paths are those of any store that Spark reads.
    """

    def exists(p: str) -> bool:
        if spark is None:
            return os.path.exists(p)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    if exists(path):
        return path, False
    folder, _, name = path.rpartition("/")
    raw = "/".join([folder.rpartition("/")[0], "raw", name])
    if exists(raw):
        return raw, True
    raise FileNotFoundError(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sessions_of_raw(raw: DataFrame) -> DataFrame:
    """``history_name, session_key, session_no, session_date, turns`` in time order.

    Dates and sessions are paired, the shorter list filled up; equal times keep
    their order, unreadable ones come last. A missing id is made from the content.
    """
    name = F.coalesce(F.nullif(F.col("question_id"), F.lit("")), F.sha2(F.concat_ws("|", "question", "answer", "question_date"), 256))
    empty = F.array().cast(f"array<{TURN}>")
    pairs = F.arrays_zip(F.coalesce("haystack_dates", F.array().cast("array<string>")).alias("d"), F.coalesce("haystack_sessions", F.array(empty)).alias("s"))
    rows = raw.select(name.alias("history_name"), F.posexplode(pairs).alias("pos", "x"))
    rows = rows.select("history_name", "pos", F.coalesce("x.0", F.lit("")).alias("session_date"), F.coalesce("x.1", empty).alias("turns")) if "0" in rows.schema["x"].dataType.names else rows.select("history_name", "pos", F.coalesce("x.d", F.lit("")).alias("session_date"), F.coalesce("x.s", empty).alias("turns"))
    place = F.row_number().over(W.partitionBy("history_name").orderBy(dates.chat_time_or_last(F.col("session_date")), "pos"))
    return rows.withColumn("session_no", place).select("history_name", F.concat(F.lit("session_"), place.cast("string")).alias("session_key"), "session_no", "session_date", "turns")


def _name() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("history_id", "history_name", "question_id")], F.lit("unknown_history"))


def sessions_of_canonical(docs: DataFrame) -> DataFrame:
    """The same from the preprocessed form, maps or lists; numbered keys in order, others after them by name."""
    if isinstance(docs.schema["chat_history"].dataType, T.MapType):
        rows = docs.select(_name().alias("history_name"), F.col("chat_time").alias("t"), F.explode("chat_history").alias("session_key", "turns"))
        rows = rows.withColumn("session_date", F.coalesce(F.try_element_at("t", F.col("session_key")), F.lit(""))).drop("t")
    else:
        rows = docs.select(_name().alias("history_name"), F.col("chat_time").alias("t"), F.posexplode("chat_history").alias("i", "turns"))
        rows = rows.select("history_name", F.concat(F.lit("session_"), (F.col("i") + 1).cast("string")).alias("session_key"), "turns", F.coalesce(F.get("t", F.col("i")), F.lit("")).alias("session_date"))
    number = F.regexp_extract("session_key", r"session_(\d+)", 1).try_cast("int")
    place = F.row_number().over(W.partitionBy("history_name").orderBy(number.asc_nulls_last(), "session_key"))
    return rows.withColumn("session_no", place)


def turns(sessions: DataFrame) -> DataFrame:
    """A row for each turn: ``history_name, session_no, session_date, turn, role, text, has_answer``."""
    return sessions.select("history_name", "session_no", "session_date", F.posexplode("turns").alias("turn", "t")).select("history_name", "session_no", "session_date", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate files of a folder, metadata files passed over."""
    rows = spark.read.schema(CANDIDATES).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.where(~F.element_at(F.split(F.input_file_name(), "/"), -1).isin(*METADATA))


def facts(candidates: DataFrame) -> DataFrame:
    """Facts in order: chunks by index (missing: 0), then place; trimmed, blank ones left out; ``seq`` counts them."""
    c = candidates.select("history_name", F.posexplode("chunks").alias("cp", "c"))
    rows = c.select("history_name", "cp", F.coalesce("c.chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce(F.nullif(F.col("c.session_index"), F.lit(0)), F.lit(1)).alias("session_index"), F.coalesce("c.session_date", F.lit("")).alias("time"), F.posexplode("c.candidate_memories").alias("fp", "text"))
    rows = rows.withColumn("text", F.trim("text")).where("text <> ''")
    seq = F.row_number().over(W.partitionBy("history_name").orderBy("chunk_index", "cp", "fp")) - 1
    return rows.select("history_name", seq.alias("seq"), "chunk_index", "session_index", "time", "text")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are passed over, a missing file is an error."""
    return spark.read.schema(schema).json(path).where(" or ".join(f"`{f.name}` is not null" for f in T._parse_datatype_string(schema).fields))
