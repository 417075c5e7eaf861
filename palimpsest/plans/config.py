"""The experiment's configuration: typed sections with defaults, sweeps, repeats, run manifests."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field

from ..sources import store
from . import artifacts


@dataclass
class Experiment:
    benchmark: str = "lme"
    suffix: str = ""


@dataclass
class Models:
    extract: str = ""
    manager: str = ""
    answer: str = ""
    judge: str = ""
    embedding: str = ""


@dataclass
class Extract:
    candidate_suffix: str = ""
    granularity: int | str = "all"
    turn_overlap: int = 0
    language: str = "en"
    aspect_templates: list[str] = field(default_factory=list)


@dataclass
class Generate:
    retrieve_topk: int = 50
    memory_token_limit: int | None = 256
    answer_stratified_sample: int = 0
    answer_sample_seed: int = 42
    show_memory_time: bool = True
    hybrid: dict = field(default_factory=dict)


@dataclass
class Evaluate:
    use_cot: bool = False
    judge_stratified_sample: int = 0
    judge_sample_seed: int = 42


@dataclass
class Sweep:
    memory_token_limits: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if any(not isinstance(x, int) or isinstance(x, bool) or x <= 0 for x in self.memory_token_limits):
            raise ValueError("token limits are positive whole numbers")
        self.memory_token_limits = list(dict.fromkeys(self.memory_token_limits))


@dataclass
class Replication:
    repeats: int = 1
    base_seed: int = 42
    seeds: list[int] | None = None

    def __post_init__(self) -> None:
        if self.repeats < 1 or (self.seeds is not None and len(self.seeds) != self.repeats):
            raise ValueError("at least one repeat, and a seed for each if seeds are given")


@dataclass
class Config:
    experiment: Experiment = field(default_factory=Experiment)
    models: Models = field(default_factory=Models)
    extract: Extract = field(default_factory=Extract)
    generate: Generate = field(default_factory=Generate)
    evaluate: Evaluate = field(default_factory=Evaluate)
    methods: dict = field(default_factory=dict)
    prompts: dict = field(default_factory=dict)
    token_limits: dict = field(default_factory=dict)
    parallel: dict = field(default_factory=dict)
    debug: dict = field(default_factory=dict)
    sweep: Sweep = field(default_factory=Sweep)
    replication: Replication = field(default_factory=Replication)

    @classmethod
    def of(cls, given: dict) -> Config:
        """From nested dictionaries; unknown sections or fields are an error."""
        parts = {}
        for name, value in given.items():
            kind = next((f.default_factory for f in dataclasses.fields(cls) if f.name == name), None)
            if kind is None:
                raise ValueError(f"unknown section {name!r}")
            try:
                parts[name] = kind(**value) if dataclasses.is_dataclass(kind) else value
            except TypeError as e:
                raise ValueError(f"section {name!r}: {e}") from e
        return cls(**parts)

    def resolved(self) -> dict:
        return dataclasses.asdict(self)

    def variants(self) -> list[tuple[str, dict]]:
        """An id and a resolved configuration for each token limit (outer) and repeat (inner)."""
        seeds = self.replication.seeds or [self.replication.base_seed + i for i in range(self.replication.repeats)]
        out = []
        for limit in self.sweep.memory_token_limits or [self.generate.memory_token_limit]:
            for i, seed in enumerate(seeds):
                own = self.resolved()
                own["generate"] |= {"memory_token_limit": limit, "answer_sample_seed": seed}
                own["evaluate"]["judge_sample_seed"] = seed
                out.append((f"tl{limit}-r{i:02d}-s{seed}", own))
        return out


def run_folder(root: str, config: dict) -> str:
    """This configuration's folder, with a manifest that never changes; another configuration there is an error."""
    folder = os.path.join(root, f"{artifacts.slug(config)}-{artifacts.digest(config)}")
    path = os.path.join(folder, "manifest.json")
    manifest = {"config": config, "hash": artifacts.digest(config, 64)}
    if os.path.exists(path):
        import json

        with open(path, encoding="utf-8") as f:
            if json.load(f)["hash"] != manifest["hash"]:
                raise ValueError(f"{folder} belongs to another configuration")
    else:
        store.write_json(path, manifest)
    return folder
