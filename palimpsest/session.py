"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def create(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings this engine assumes."""
    b = SparkSession.builder.master(master).appName("palimpsest")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package's source to every executor, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="palimpsest-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def ship_active() -> None:
    """The same for the session in use, where only columns are at hand."""
    if spark := SparkSession.getActiveSession():
        ship(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where all executors can read it: the folder that ``spark.checkpoint.dir`` names.

    Only a local session without the setting gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="palimpsest-checkpoints-"))
    return df.checkpoint()
