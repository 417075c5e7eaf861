"""The memory store on disk, and the experiment's logs."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the evaluation CSV, in order.
CSV_COLUMNS = ["timestamp", "benchmark", "method", "judge_model", "answer_model", "input_file", "output_file", "n", "judged_count", "api_failure_count", "overall_accuracy", "per_type", "sampled", "seed", "notes"]


def write(memories: DataFrame, path: str) -> None:
    """One write for a batch of histories; each replaces what the store held of it."""
    memories.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("history_name").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows; a missing time is taken from the metadata's date."""
    rows = spark.read.parquet(path)
    date = F.try_element_at("extra", F.lit("date")) if "extra" in rows.columns else F.lit(None)
    return rows.withColumn("time", F.coalesce(F.nullif("time", F.lit("")), date, F.lit("unknown_time")))


#: Characters that partition folders have as %XX, beside control characters.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def folder(history: str | None) -> str:
    """The folder of a history's partition; it is one step of a path whatever the name."""
    if not history:
        return "history_name=__HIVE_DEFAULT_PARTITION__"
    return "history_name=" + "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in history)


def clear(spark: SparkSession, path: str, history: str | None) -> None:
    """Drop one history's partition."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(None, None, folder(history)))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def get(memories: DataFrame, memory_id) -> DataFrame:
    return memories.where(F.col("memory_id") == F.lit(memory_id))


def aligned(lists: DataFrame) -> DataFrame:
    """Rows from parallel lists (ids, texts, source_indices, times), filled up or cut to the ids."""
    part = lambda c, fill: F.coalesce(F.get(c, F.col("i")), F.lit(fill))
    rows = lists.select("*", F.posexplode("ids").alias("i", "memory_id"))
    return rows.select("history_name", "memory_id", F.col("i").alias("seq"), part("texts", "").alias("text"), part("source_indices", "unknown").alias("source_index"), part("times", "unknown_time").alias("time"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Append rows as CSV in the fixed columns; nested values as JSON, truth values in lower case."""
    cell = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.lower(F.col(f.name).cast("string")) if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast("string")
    held = {f.name: cell(f) for f in rows.schema.fields}
    rows.select(*[held.get(c, F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS]).write.mode("append").option("header", True).csv(path)


def write_json(path: str, value) -> None:
    """A small JSON file on the driver's file system, whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
