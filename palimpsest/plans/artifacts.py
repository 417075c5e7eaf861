"""Stages by fingerprint: what a stage depends on is hashed, and its output is kept under the hash."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prompts

#: Configuration fields that each stage depends on.
STAGE_FIELDS = {
    "candidate": ["experiment.benchmark", "models.extract", "extract.candidate_suffix", "extract.granularity", "extract.turn_overlap", "extract.language", "extract.aspect_templates", "token_limits.extract_max_new_tokens"],
    "ingest": ["models.manager", "models.embedding", "token_limits.ingest_relation_max_new_tokens", "token_limits.ingest_manager_max_new_tokens", "token_limits.fusion_max_new_tokens", "prompts.relation_user_en", "prompts.relation_user_zh"],
    "answer": ["experiment.benchmark", "models.answer", "models.embedding", "generate.retrieve_topk", "generate.memory_token_limit", "generate.answer_stratified_sample", "generate.answer_sample_seed", "generate.show_memory_time", "generate.hybrid"],
    "judge": ["experiment.benchmark", "models.judge", "evaluate.use_cot", "evaluate.judge_stratified_sample", "evaluate.judge_sample_seed", "prompts.judge_template", "token_limits.evaluate_max_new_tokens"],
}
#: Our own settings that stages depend on beside those.
OWN_FIELDS = {"candidate": ["extract.aspects_only"], "fusion": ["token_limits.fusion_max_new_tokens"], "answer": ["generate.rank_before_fusion"]}


def look_up(config: dict, path: str, default=None):
    """A value by dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def canonical(value) -> str:
    """JSON in which equal values are equal texts; non-finite numbers are an error."""

    def check(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("a number is not finite")
        if isinstance(x, dict):
            return {str(k): check(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [check(v) for v in x]
        return x

    return json.dumps(check(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value, size: int = 8) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:size]


#: Templates that each stage's prompts are made from.
STAGE_TEMPLATES = {"candidate": ("EXTRACT", "ASPECTS"), "ingest": ("RELATION", "FUSE", "OPERATIONS", "UTILITY", "BUNDLE"), "fusion": ("BUNDLE",), "answer": ("ANSWER",), "judge": ("JUDGE", "JUDGE_BRIEF")}


def templates_of(stage: str) -> dict[str, str]:
    """A stage's templates by name, as text."""
    return {name: x if isinstance(x := getattr(prompts, name), str) else canonical(x) for name in STAGE_TEMPLATES[stage]}


def fingerprint(stage: str, config: dict, upstream: str = "", method: str = "", templates: dict[str, str] | None = None, models: object = None, nonce: str = "") -> str:
    """The stage's own fields, its method's settings, the contents of its templates, its models, and the stage before.

    A nonce makes a run's stages its own.
    """
    own = {"stage": stage, "fields": {p: look_up(config, p) for p in STAGE_FIELDS.get(stage, []) + OWN_FIELDS.get(stage, [])}, "upstream": upstream}
    if method:
        own |= {"method": method, "settings": look_up(config, f"methods.{method}", {}) if stage == "ingest" else None}
    if templates:
        own["templates"] = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(templates.items())}
    if models is not None:
        own["models"] = models
    if nonce:
        own["nonce"] = nonce
    return digest(own)


def slug(config: dict) -> str:
    """A readable path part: benchmark, suffix, methods in use, token limit."""
    clean = lambda t: re.sub("-{2,}", "-", re.sub("[^a-z0-9_-]+", "-", str(t).strip().lower())).strip("-_") or "x"
    methods = sorted(k for k, v in (look_up(config, "methods") or {}).items() if isinstance(v, dict) and v.get("enabled"))
    limit = look_up(config, "generate.memory_token_limit")
    parts = [clean(x) for x in (look_up(config, "experiment.benchmark"), look_up(config, "experiment.suffix")) if x]
    parts += ["+".join(map(clean, methods))] if methods else []
    parts += [f"tl{limit}"] if limit is not None else []
    return "_".join(parts)[:96].strip("_-") or "run"


class Busy(RuntimeError):
    """Another run is making this stage."""


class Stages:
    """Outputs below a root, by stage and fingerprint; a finished one is read, not made again.

    Whoever makes a stage holds its lock, a file that only one can create, and
    leaves a manifest beside the table. A lock older than ``stale`` seconds is that
    of a run that died.
    """

    def __init__(self, spark: SparkSession, root: str, stale: float = 24 * 3600.0, now: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.stale, self.now = spark, root.rstrip("/"), stale, now
        self.run = uuid.uuid4().hex
        self.made: list[str] = []

    def path(self, stage: str, key: str) -> str:
        return f"{self.root}/stages/{stage}/{key}"

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def finished(self, stage: str, key: str) -> bool:
        store, p = self._file(f"{self.path(stage, key)}/_SUCCESS")
        return store.exists(p)

    def _write(self, path: str, value: dict, overwrite: bool) -> None:
        store, p = self._file(path)
        out = store.create(p, overwrite)
        out.write(canonical(value).encode())
        out.close()

    def read(self, path: str) -> dict:
        """A small JSON object of the store."""
        return json.loads("".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect()))

    def lock(self, stage: str, key: str) -> str:
        """Take the stage's lock or raise ``Busy``."""
        path = f"{self.path(stage, key)}.lock"
        store, p = self._file(path)
        if store.exists(p) and self.now() - store.getFileStatus(p).getModificationTime() / 1000 > self.stale:
            store.delete(p, False)
        try:
            self._write(path, {"run": self.run}, overwrite=False)
        except Exception as e:
            if store.exists(p):
                raise Busy(f"{stage}/{key} is being made; its lock is {path}") from e
            raise
        return path

    def manifest(self, stage: str, key: str) -> dict | None:
        """What a finished stage was made from."""
        store, p = self._file(f"{self.path(stage, key)}.json")
        return self.read(str(p.toString())) if store.exists(p) else None

    def once(self, stage: str, key: str, make: Callable[[], DataFrame], **about) -> DataFrame:
        """The stage's table; a half-written one is replaced. ``about`` goes into its manifest."""
        path = self.path(stage, key)
        if not self.finished(stage, key):
            lock = self.lock(stage, key)
            try:
                if not self.finished(stage, key):
                    make().write.mode("overwrite").parquet(path)
                    self._write(f"{path}.json", {"stage": stage, "fingerprint": key, "run": self.run} | about, overwrite=True)
                    self.made.append(f"{stage}/{key}")
            finally:
                store, p = self._file(lock)
                store.delete(p, False)
        return self.spark.read.parquet(path)


def marked(spark: SparkSession, folder: str, settings: dict, pattern: str = "*.json") -> DataFrame:
    """``path, marker`` of each file of a folder: a hash of its name, time and size and of the settings."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", F.sha2(F.concat_ws("|", name, F.col("modificationTime").cast("double").cast("string"), F.col("length").cast("string"), F.lit(digest(settings, 64))), 256).alias("marker"))


def unmarked(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose marker is not among those done: new or changed ones, or ones under other settings."""
    return files.join(done.select("path", "marker"), ["path", "marker"], "left_anti")
