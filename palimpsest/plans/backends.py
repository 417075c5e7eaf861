"""Language and embedding models behind two small protocols, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import folds
from ..session import ship
from . import prompts


class Language(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]: ...


class Embedding(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Retrying:
    """Calls another backend again after errors, waiting longer each time; what still fails is None."""

    def __init__(self, inner: Language, attempts: int = 5, longest: float = 60.0, wait=time.sleep) -> None:
        self.inner, self.attempts, self.longest, self.wait = inner, attempts, longest, wait

    def complete(self, prompts: list[str]) -> list[str | None]:
        for k in range(self.attempts):
            try:
                return self.inner.complete(prompts)
            except Exception:
                if k + 1 < self.attempts:
                    self.wait(min(self.longest, 2.0**k))
        return [None] * len(prompts)


class Concurrent:
    """Sends the prompts of a batch one by one, several at a time; answers keep the prompts' order.

    Each prompt is tried again by itself, so one that fails costs no other its answer.
    """

    def __init__(self, inner: Language, at_once: int = 8, attempts: int = 50, longest: float = 60.0, wait=time.sleep) -> None:
        self.inner, self.at_once, self.attempts, self.longest, self.wait = inner, at_once, attempts, longest, wait

    def complete(self, prompts: list[str]) -> list[str | None]:
        one = Retrying(self.inner, self.attempts, self.longest, self.wait)
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(lambda p: one.complete([p])[0], prompts))


class TooLong(Exception):
    """A backend's answer does not fit the tokens that are left to it."""


class Halving:
    """Asks with half as many tokens when a model's context is too small, three times; then the answer is an empty object.

    ``inner`` has ``complete(prompts, max_tokens)`` and raises ``TooLong``.
    """

    def __init__(self, inner, max_tokens: int = 4096, tries: int = 3) -> None:
        self.inner, self.max_tokens, self.tries = inner, max_tokens, tries

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str | None:
        for k in range(self.tries):
            try:
                return self.inner.complete([prompt], max(1, self.max_tokens >> k))[0]
            except TooLong:
                continue
        return "{}"


class Batched:
    """A classifier in batches: each is tried again as long as it does not give a known label for every prompt.

    What is left after the last try gets the default.
    """

    def __init__(self, inner: Language, labels: tuple[str, ...], default: str, size: int = 10, tries: int = 3) -> None:
        self.inner, self.labels, self.default, self.size, self.tries = inner, labels, default, size, tries

    def complete(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for lo in range(0, len(prompts), self.size):
            part, found = prompts[lo : lo + self.size], [None] * len(prompts[lo : lo + self.size])
            for _ in range(self.tries):
                try:
                    said = self.inner.complete(part)
                except Exception:
                    continue
                found = [f or next((x for x in self.labels if s and s.strip().upper() == x), None) for f, s in zip(found, said, strict=True)]
                if all(found):
                    break
            out += [f or self.default for f in found]
        return out


def request(model: str, prompt: str, max_tokens: int, thinking: bool = False) -> dict:
    """The body of a chat request; models that can think are told whether to."""
    body: dict = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens}
    if re.search("qwen|deepseek|glm", model.lower()):
        body["chat_template_kwargs"] = {"enable_thinking": thinking}
    return body


def said(message: dict) -> str:
    """A chat answer's content, else its reasoning."""
    return next((v for k in ("content", "reasoning_content", "reasoning") if isinstance(v := message.get(k), str) and v.strip()), "")


_MODELS: dict[str, Callable[[], object]] = {}


def register(name: str, make: Callable[[], object]) -> None:
    """Make a language or embedding model known by name."""
    _MODELS[name] = make


def model(name: str):
    """A new backend of a known name."""
    if name not in _MODELS:
        raise KeyError(f"unknown model {name!r}; known: {sorted(_MODELS)}")
    return _MODELS[name]()


def identity(backend) -> object:
    """What a backend is, as plain values: its class and settings, of wrapped ones too; functions count by name."""
    if backend is None or isinstance(backend, (str, int, float, bool)):
        return backend
    if isinstance(backend, (list, tuple)):
        return [identity(x) for x in backend]
    if isinstance(backend, dict):
        return {str(k): identity(v) for k, v in backend.items()}
    if callable(backend) and hasattr(backend, "__qualname__"):
        return f"{backend.__module__}.{backend.__qualname__}"
    kind = type(backend)
    return {"class": f"{kind.__module__}.{kind.__qualname__}", "settings": {k: identity(v) for k, v in sorted(getattr(backend, "__dict__", {}).items()) if not k.startswith("_")}}


class RelationLabels:
    """Relations of two texts by a language model's JSON answer; anything else is IND."""

    def __init__(self, language: Language) -> None:
        self.language = language

    def __call__(self, old: str, new: str) -> str:
        return relation_of(self.language.complete([prompts.relation(old, new)])[0])


def relation_of(answer: str | None) -> str:
    """The label of a JSON answer, in a code fence or with words around it; anything else is IND."""
    t = re.sub(r"(?s)^.*?```[a-zA-Z]*\s*(.*?)\s*```.*$", r"\1", answer or "")
    found = re.search(r"(?s)\{.*\}", t)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        value = None
    label = str(value.get("relation", "")).strip().upper() if isinstance(value, dict) else ""
    return label if label in strings.LABELS else "IND"


class Fusion:
    """One text for two facts by a language model; None if it fails, so that callers join them."""

    def __init__(self, language: Language) -> None:
        self.language = language

    def __call__(self, relation: str, current: str, new: str) -> str | None:
        said = self.language.complete([prompts.fuse(relation, current, new)])[0]
        return said.strip() if said and said.strip() else None


class Decisions:
    """Operations on a store by a language model that is shown it."""

    def __init__(self, language: Language) -> None:
        self.language = language

    def __call__(self, existing: list[str], facts: list[str]) -> list[tuple[str, int, str]]:
        held = json.dumps([{"id": str(i), "text": t} for i, t in enumerate(existing)], ensure_ascii=False) if existing else "none"
        asked = prompts.OPERATIONS.format(existing=held, facts=json.dumps(facts, ensure_ascii=False))
        return folds.operations(self.language.complete([asked])[0], len(existing))


class Containment:
    """An offline judge: yes if the reference stands in the answer of a judge's prompt."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        out = []
        for p in prompts:
            found = re.match(r"(?s)Question: [^\n]*\nReference: ([^\n]*)\nAnswer: (.*)\n[^\n]*$", p)
            reference, answer = found.groups() if found else ("", "")
            same = " ".join(reference.lower().split()) in " ".join(answer.lower().split())
            out.append(f"Final answer: {'yes' if reference.strip() and same else 'no'}")
        return out


class Lines:
    """An offline extractor: the non-blank lines of the prompt's dialogue (or of all of it) as facts."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        dialogues = (p.partition("\nDialogue:\n")[2] or p for p in prompts)
        return [json.dumps({"memories": [x.strip() for x in d.splitlines() if x.strip()]}) for d in dialogues]


class HashedWords:
    """An offline embedding: words hashed with signs into a few dimensions, unit length."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % self.size] += 1.0 if h >> 31 else -1.0
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(n == 0, 1, n)).tolist()


class Kept:
    """A backend whose answers are kept in a folder that all executors share, so none is asked for twice.

    Each answer is a file, named by a hash of model and prompt, that appears whole or
    not at all. A task that is run again, on another executor or in a later run, reads
    what was answered before; only calls that were under way (``size`` prompts) are
    repeated. Failures are not kept.
    """

    def __init__(self, inner: Language, folder: str, size: int = 16) -> None:
        self.inner, self._folder, self._size = inner, folder.rstrip("/"), size

    def _path(self, root: str, prompt: str) -> str:
        name = hashlib.sha256(json.dumps([identity(self.inner), prompt]).encode()).hexdigest()
        return f"{root}/{name[:2]}/{name}.json"

    def complete(self, prompts: list[str]) -> list[str | None]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self._folder)
        paths = {p: self._path(root, p) for p in prompts}
        known: dict[str, str | None] = {}
        there = store.get_file_info(list(paths.values())) if paths else []
        for (p, path), info in zip(paths.items(), there, strict=True):
            if info.type != fs.FileType.NotFound:
                with store.open_input_stream(path) as f:
                    known[p] = json.loads(f.read())["answer"]
        missing = [p for p in paths if p not in known]
        for lo in range(0, len(missing), self._size):
            part = missing[lo : lo + self._size]
            for p, said in zip(part, self.inner.complete(part), strict=True):
                known[p] = said
                if said is not None:
                    store.create_dir(os.path.dirname(paths[p]), recursive=True)
                    whole = f"{paths[p]}.{uuid.uuid4().hex}"
                    with store.open_output_stream(whole) as f:
                        f.write(json.dumps({"prompt": p, "answer": said}).encode())
                    store.move(whole, paths[p])
        return [known[p] for p in prompts]


def answered(rows: DataFrame, prompt: str, backend: Language, folder: str, out: str = "response") -> DataFrame:
    """Adds the backend's answer to each prompt like ``completed``; equal prompts are asked once, and never again."""
    keyed = rows.withColumn("_key", F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256))
    asked = keyed.select("_key", F.col(prompt).alias("_prompt")).dropDuplicates(["_key"])
    said = completed(asked, "_prompt", Kept(backend, folder), out).select("_key", out)
    return keyed.join(said, "_key", "left").drop("_key")


def completed(rows: DataFrame, prompt: str, backend: Language, out: str = "response") -> DataFrame:
    """Adds the backend's answer to each prompt, a batch at a time on the executors."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(backend.complete(p.fillna("").tolist()), dtype=object)

    return rows.withColumn(out, call(F.col(prompt)))


def embedded(rows: DataFrame, text: str, backend: Embedding, out: str = "embedding") -> DataFrame:
    """Adds the embedding of each text, a batch at a time on the executors."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(backend.embed(p.fillna("").tolist()))

    return rows.withColumn(out, call(F.col(text)))
