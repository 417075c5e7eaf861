"""Order-dependent ingest, one history at a time: admission, clustering, relations, operations.

Each fold is a plain function over one history's facts in order, run by
``applyInPandas`` grouped on the history. State is one history's memories, which
bounds a task; histories are independent, so they spread over the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from . import admission, neighbours


def _unit(v) -> np.ndarray:
    return neighbours.units(np.asarray(v, float)[None])[0]


class _Vectors:
    """Unit vectors by number, in one matrix that grows."""

    def __init__(self) -> None:
        self.held, self.used = np.empty((16, 0)), 0

    def put(self, i: int, v: np.ndarray | None) -> None:
        if v is None:
            return
        if not self.held.shape[1]:
            self.held = np.full((16, len(v)), np.nan)
        while i >= len(self.held):
            self.held = np.concatenate([self.held, np.full_like(self.held, np.nan)])
        self.held[i] = v
        self.used = max(self.used, i + 1)

    def known(self, i: int) -> bool:
        return i < self.used and not np.isnan(self.held[i, :1]).any()

    def similar(self, which: list[int], v: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.held[which], v)  # summed as in ``neighbours``

    def all(self) -> np.ndarray:
        return self.held[: self.used]


def _rows(pdf: pd.DataFrame, *names: str) -> Iterator[tuple]:
    """The named columns' values row by row; None for columns that are not there."""
    return zip(*(pdf[n].tolist() if n in pdf else [None] * len(pdf) for n in names), strict=True)


def folded(facts: DataFrame, fold, schema: str) -> DataFrame:
    """``fold`` over each history's rows sorted by ``seq``."""
    ship(facts.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values("seq", kind="stable").reset_index(drop=True))

    return facts.groupBy("history_name").applyInPandas(run, schema)


class Texts:
    """Rows by trimmed text and role, for dropping equal ones at the end of a chunk; only what changed is looked at.

    Of equal rows the earliest by time stays (unknown times last), then the first; blank ones all stay.
    """

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], dict[int, tuple]] = {}
        self.key: dict[int, tuple[str, str]] = {}
        self.changed: dict[int, tuple[str, str, float | None]] = {}

    def put(self, i: int, text: str, role: str = "primary", when: float | None = None) -> None:
        """A row is new, or has another text or role now."""
        self.changed[i] = text.strip(" "), role, when

    def settle(self) -> list[int]:
        """The rows that go."""
        met = set()
        for i, (text, role, when) in self.changed.items():
            if i in self.key:
                self.groups[self.key[i]].pop(i, None)
            self.key[i] = text, role
            if text:
                self.groups.setdefault((text, role), {})[i] = (when is None, when or 0.0, i)
                met.add((text, role))
        self.changed = {}
        gone = []
        for k in met:
            held = self.groups[k]
            if len(held) > 1:
                best = min(held, key=held.get)
                gone += [i for i in held if i != best]
                self.groups[k] = {best: held[best]}
        return sorted(gone)


def _chunk_ends(pdf: pd.DataFrame, chunk: str | None) -> list[bool]:
    """Whether each row is its chunk's last; without a column of chunks none is."""
    if chunk is None or not len(pdf):
        return [False] * len(pdf)
    c = pdf[chunk].tolist()
    return [*(a != b for a, b in zip(c, c[1:], strict=False)), True]


# Admission -------------------------------------------------------------------


class Admission:
    """What one history's admission remembers: the vectors that were admitted last."""

    def __init__(self, weights: tuple[float, ...] = admission.WEIGHTS, threshold: float = admission.THRESHOLD, kept: list | None = None) -> None:
        self.weights, self.threshold = weights, threshold
        self.kept: list[np.ndarray] = [np.asarray(v, float) for v in kept or []]

    def take(self, pdf: pd.DataFrame, chunk: str | None = None) -> pd.DataFrame:
        """Facts with utility, confidence, recency, type_prior and embedding: novelty against what was admitted.

        At the end of each value of a ``chunk`` column, admitted facts with a text that
        another has (``text``, ``when``) are forgotten.
        """
        rows, texts = [], Texts()
        held: list[tuple[int, np.ndarray]] = [(-1, v) for v in self.kept]
        ends = _chunk_ends(pdf, chunk)
        for i, (name, seq, embedding, utility, confidence, recency, prior, text, when) in enumerate(_rows(pdf, "history_name", "seq", "embedding", "utility", "confidence", "recency", "type_prior", "text", "when")):
            v = _unit(embedding)
            novelty = min(1.0, max(0.0, 1.0 - float(np.einsum("ij,j->i", np.array(self.kept), v).max()))) if self.kept else 1.0
            s = float(np.dot(self.weights, (utility, confidence, novelty, recency, prior)))
            ok = s >= self.threshold
            if ok:
                held.append((i, v))
                if chunk is None:
                    held = held[-admission.TAIL :]
                else:
                    texts.put(i, text or "", when=None if pd.isna(when) else float(when))
            if ends[i] and (gone := set(texts.settle())):
                held = [x for x in held if x[0] not in gone]
            self.kept = [x for _, x in held[-admission.TAIL :]]
            rows.append((name, seq, novelty, s, ok))
        return pd.DataFrame(rows, columns=["history_name", "seq", "novelty", "score", "admitted"])


def admit(pdf: pd.DataFrame, weights: tuple[float, ...] = admission.WEIGHTS, threshold: float = admission.THRESHOLD, chunk: str | None = None) -> pd.DataFrame:
    """The facts of one history, whole."""
    return Admission(weights, threshold).take(pdf, chunk)


ADMIT = "history_name string, seq long, novelty double, score double, admitted boolean"


# Clustering ------------------------------------------------------------------


class Clusters:
    """Greedy clusters of one history: the nearest centroid among those near in time, else a new one.

    Times are seconds or NaN, and compared only where both are known. Of equally near
    centroids the older one wins. Numbers are given in the order of founding; clusters
    that are ``open`` again (number, centroid, members, last time) come in that order.
    """

    def __init__(self, threshold: float = 0.65, gap_days: float = 7.0, founded: int = 0, open: list[tuple] | None = None) -> None:  # noqa: A002
        self.threshold, self.gap, self.founded = threshold, gap_days * 86400, founded
        self.centroids, self.lengths, self.last = _Vectors(), np.empty(16), np.empty(16)
        self.numbers: list[int] = []
        self.counts: list[int] = []
        for number, centroid, count, last in open or []:
            self._set(len(self.numbers), np.asarray(centroid, float), last, number, count)

    def _set(self, k: int, centroid: np.ndarray, last: float, number: int, count: int) -> None:
        if k == len(self.last):
            self.last, self.lengths = np.resize(self.last, 2 * k), np.resize(self.lengths, 2 * k)
        if k == len(self.numbers):
            self.numbers.append(number)
            self.counts.append(count)
        self.centroids.put(k, centroid)
        self.lengths[k], self.last[k], self.counts[k] = np.sqrt((centroid * centroid).sum()), last, count

    def place(self, v: np.ndarray, at: float) -> int:
        """Put a vector into a cluster; its place among those held."""
        known = len(self.numbers)
        if known:
            sims = np.einsum("ij,j->i", self.centroids.all(), v) / ((self.lengths[:known] + 1e-9) * (np.sqrt((v * v).sum()) + 1e-9))
            sims[np.abs(at - self.last[:known]) > self.gap] = -np.inf  # false for unknown times
            k = int(sims.argmax())
            if sims[k] >= self.threshold:
                n, last = self.counts[k], self.last[k]
                self._set(k, (self.centroids.held[k] * n + v) / (n + 1), at if np.isnan(last) else last if np.isnan(at) else max(last, at), self.numbers[k], n + 1)
                return k
        self._set(known, v, at, self.founded, 1)
        self.founded += 1
        return known

    def take(self, pdf: pd.DataFrame) -> tuple[pd.DataFrame, set[int]]:
        """The clusters of facts, and which places changed."""
        rows, touched = [], set()
        for name, seq, embedding, when in _rows(pdf, "history_name", "seq", "embedding", "at"):
            k = self.place(np.asarray(embedding, float), np.nan if pd.isna(when) else float(when))
            touched.add(k)
            rows.append((name, seq, f"cluster_{self.numbers[k]:04d}"))
        return pd.DataFrame(rows, columns=["history_name", "seq", "cluster"]), touched


def cluster(pdf: pd.DataFrame, threshold: float = 0.65, gap_days: float = 7.0) -> pd.DataFrame:
    """The clusters of one history's facts, whole."""
    return Clusters(threshold, gap_days).take(pdf)[0]


CLUSTER = "history_name string, seq long, cluster string"


# Relations -------------------------------------------------------------------

#: The least similarity of a candidate.
THRESHOLD = 0.7


@dataclass
class Memory:
    """A row of one history's store while it is folded."""

    id: int
    text: str
    vector: np.ndarray
    time: str = ""
    role: str = "primary"
    parent: int | None = None
    edge: str | None = None
    hidden: bool = False
    answer: int | None = None
    members: list[int] = field(default_factory=list)
    root: int | None = None
    point: int | None = None
    when: float | None = None
    gone: bool = False


def words_label(old: str, new: str, threshold: float = 0.5) -> str:
    """The offline labelling rule on two texts."""
    a, b = set(old.lower().split()), set(new.lower().split())
    if a == b:
        return "EQV"
    if a <= b:
        return "OSN"
    if b <= a:
        return "NSO"
    return "CON" if a | b and len(a & b) / len(a | b) >= threshold else "IND"


class RelationStore:
    """One history under relation decisions.

    ``label(old, new)`` gives a relation; ``fuse(relation, current, new)`` the
    answer memory's text, or None to keep raw texts; ``embed(text)`` a vector.
    """

    def __init__(self, label=words_label, fuse=None, embed=None, threshold: float = THRESHOLD, k: int = 5, active: tuple[str, ...] = ("EQV", "NSO", "OSN", "CON")) -> None:
        self.rows: list[Memory] = []
        self.vectors = _Vectors()
        self.near: neighbours.Near | None = None
        self.points: dict[int, dict[int, None]] = {}  # primaries of each point, the earliest first
        self.texts: Texts | None = None  # where equal texts are dropped
        self.log: list[tuple[str, dict]] = []
        self.label, self.fuse, self.embed, self.threshold, self.k, self.active = label, fuse, embed, threshold, k, active

    def _append(self, **values) -> Memory:
        row = Memory(len(self.rows), **values)
        self.rows.append(row)
        if self.near is None:
            self.vectors.put(row.id, row.vector)
        self._changed(row)
        return row

    def _changed(self, row: Memory) -> None:
        if self.texts is not None:
            self.texts.put(row.id, row.text, row.role, row.when)

    def deduplicate(self) -> int:
        """Drop rows with a text and role that another has; what points to them stays as it is."""
        gone = self.texts.settle()
        for i in gone:
            self.rows[i].gone = True
            self.points.get(self.rows[i].point, {}).pop(i, None)
        return len(gone)

    def candidates(self, vector: np.ndarray, point: int | None = None) -> list[Memory]:
        """The k nearest primaries, the earlier of equally near ones first.

        With ``near`` edges those of the fact's point are walked, else all primaries
        are compared.
        """
        if self.near is not None:
            return self._walked(point)
        primaries = [i for held in self.points.values() for i in held if self.vectors.known(i)]
        if vector is None or not primaries:
            return []
        primaries.sort()
        near = self.vectors.similar(primaries, vector)
        best = np.argsort(-near, kind="stable")[: self.k]
        return [self.rows[primaries[i]] for i in best if near[i] >= self.threshold]

    def _walked(self, point: int | None) -> list[Memory]:
        found: list[int] = []
        tied: list[int] = []
        before = None
        for other, score in zip(*self.near.of(point), strict=True):
            held = self.points.get(other)
            if not held:
                continue
            if score != before:
                found += sorted(tied)
                tied, before = [], score
                if len(found) >= self.k:
                    break
            tied += islice(held, self.k)
        return [self.rows[i] for i in (found + sorted(tied))[: self.k]]

    def add(self, text: str, vector, time: str = "", point: int | None = None, when: float | None = None) -> str:
        """Take in one fact; the outcome."""
        text = text.strip()
        if not text:
            return "blank"
        v = None if vector is None else _unit(vector)
        found: dict[str, list[Memory]] = {}
        near = self.candidates(v, point)
        for m in near:
            x = self.label(m.text, text)
            found.setdefault(x if x in self.active else "IND", []).append(m)
        self.log.append(("candidates", {"text": text, "ids": [m.id for m in near], "labels": {k: [m.id for m in ms] for k, ms in found.items()}}))
        relation = next((x for x in ("CON", "OSN", "NSO", "EQV") if x in found), None)
        olds = found.get(relation, [])
        if relation in ("NSO", "EQV"):
            anchor = max(olds, key=lambda m: len(m.text.strip())) if relation == "NSO" else olds[0]
            new = self._append(text=text, vector=v, time=time, role="evidence", parent=anchor.id, edge="ATTACH" if relation == "NSO" else "EQUIV", when=when)
            hide = anchor
        else:
            new = self._append(text=text, vector=v, time=time, point=point, when=when)
            self.points.setdefault(point, {})[new.id] = None
            for m in olds:
                m.role, m.parent, m.edge = "evidence", new.id, "UPDATE" if relation == "CON" else "ATTACH"
                del self.points[m.point][m.id]
                self._changed(m)
            anchor, hide = (olds[0] if olds else None), new
        outcome = {"CON": "conflict_update", "OSN": "stronger_primary", "NSO": "weaker_evidence", "EQV": "equivalent_evidence", None: "fresh"}[relation]
        self.log.append(("plan", {"outcome": outcome, "new_id": new.id, "old_ids": [m.id for m in olds]}))
        if anchor is not None:
            self._answer(relation, anchor, hide, new, time)
        return outcome

    def _answer(self, relation: str, anchor: Memory, hide: Memory, new: Memory, time: str) -> None:
        """Write or extend the answer memory that the anchor points to; one that was dropped is written anew."""
        held = self.rows[anchor.answer] if anchor.answer is not None and not self.rows[anchor.answer].gone else None
        current = held.text if held else anchor.text
        if self.fuse is None:
            text = new.text if relation in ("OSN", "CON") else anchor.text.strip()
        else:
            text = self.fuse(relation, current, new.text) or f"{current}\n{new.text}"
        if not text:
            return
        vector = _unit(self.embed(text)) if self.embed else new.vector
        if held is None:
            held = self._append(text=text, vector=vector, time=time, role="answer", when=new.when)
        held.text, held.vector, held.time, held.root, held.when = text, vector, time, hide.id, new.when
        self._changed(held)
        if self.near is None:
            self.vectors.put(held.id, vector)
        self.log.append(("answer", {"answer_id": held.id, "hidden_id": hide.id, "relation": relation, "text": text}))
        held.members += [i for i in (anchor.id, new.id) if i not in held.members]
        hide.hidden, hide.answer = True, held.id
        anchor.answer = held.id


def _related(pdf: pd.DataFrame, settings: dict, near: neighbours.Near | None = None, chunk: str | None = None) -> RelationStore:
    store = RelationStore(**settings)
    store.texts = Texts() if chunk else None
    embeddings, seqs = pdf["embedding"].tolist(), pdf["seq"].tolist() if "seq" in pdf else list(range(len(pdf)))
    store.near = neighbours.within(embeddings, seqs, store.threshold) if near is None else near
    points = neighbours.named(embeddings, seqs)
    for (text, time, when), embedding, point, ends in zip(_rows(pdf, "text", "time", "when"), embeddings, points, _chunk_ends(pdf, chunk), strict=True):
        store.add(text or "", embedding, time or "", point, None if pd.isna(when) else float(when))
        if ends:
            store.deduplicate()
    return store


def relate(pdf: pd.DataFrame, near: neighbours.Near | None = None, chunk: str | None = None, **settings) -> pd.DataFrame:
    """One history's facts (seq, text, time, embedding) through a ``RelationStore``; ``near`` edges may be given.

    With a column of chunks equal texts are dropped after each (``when``: seconds).
    """
    store = _related(pdf, settings, near, chunk)
    name = pdf["history_name"].iloc[0] if len(pdf) else None
    rows = [(name, m.id, m.text, m.time, m.role, m.parent, m.edge, m.hidden, m.answer, len(m.members)) for m in store.rows if not m.gone]
    out = pd.DataFrame(rows, columns=["history_name", "memory_id", "text", "time", "memory_role", "parent_primary", "edge", "answer_hidden", "answer_id", "fused_member_count"])
    return out.astype({"parent_primary": "Int64", "answer_id": "Int64"})


def joined(facts: DataFrame, fold, schema: str, threshold: float) -> DataFrame:
    """``fold`` (``relate`` or ``decisions`` with settings) over each history's rows and the edges of ``neighbours``.

    Similarities are made by many tasks, also within one history; what a history's own
    task holds are its facts and their edges above the threshold.
    """
    ship(facts.sparkSession)

    def run(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        near = neighbours.Near(*(edges[c].to_numpy(t) for c, t in (("a", np.int64), ("b", np.int64), ("score", float))))
        return fold(rows.sort_values("seq", kind="stable").reset_index(drop=True), near=near)

    near = neighbours.edges(facts, threshold)
    return facts.groupBy("history_name").cogroup(near.groupBy("history_name")).applyInPandas(run, schema)


def decisions(pdf: pd.DataFrame, near: neighbours.Near | None = None, chunk: str | None = None, **settings) -> pd.DataFrame:
    """The log of the same fold: what each fact met, what was planned, which answer was written."""
    name = pdf["history_name"].iloc[0] if len(pdf) else None
    log = _related(pdf, settings, near, chunk).log
    return pd.DataFrame([(name, i, event, json.dumps(detail, ensure_ascii=False, sort_keys=True, default=str)) for i, (event, detail) in enumerate(log)], columns=["history_name", "seq", "event", "detail"])


DECISIONS = "history_name string, seq long, event string, detail string"
RELATE = "history_name string, memory_id long, text string, time string, memory_role string, parent_primary long, edge string, answer_hidden boolean, answer_id long, fused_member_count long"


# Operations ------------------------------------------------------------------


#: An operation on a store: ADD, UPDATE, DELETE or NONE, the number of the memory that it concerns, a text.
Operation = tuple[str, int, str]


def operations(said: str | None, known: int) -> list[Operation]:
    """The operations of a model's JSON answer (``memory``: objects id, event, text); what is none is dropped.

    An id that is no number below ``known`` counts as -1: such updates and deletions do nothing.
    """
    try:
        value = json.loads(said or "")
    except ValueError:
        return []
    listed = value.get("memory") if isinstance(value, dict) else None
    out = []
    for x in listed if isinstance(listed, list) else []:
        if isinstance(x, dict):
            i = str(x.get("id", "")).strip()
            text = x.get("text")
            out.append((str(x.get("event", "")).strip().upper(), int(i) if i.isdecimal() and int(i) < known else -1, text.strip() if isinstance(text, str) else ""))
    return out


def _head(text: str) -> tuple[str, ...]:
    return tuple(text.lower().split(None, 3)[:3])


def first_words(existing: list[str], facts: list[str]) -> list[Operation]:
    """The offline rule for one fact: a known text is NONE, equal first three words UPDATE, anything else ADD."""
    out: list[Operation] = []
    for fact in facts:
        same = next((i for i, t in enumerate(existing) if t == fact), -1)
        near = next((i for i, t in enumerate(existing) if _head(t) == _head(fact)), -1)
        out.append(("NONE", same, "") if same >= 0 else ("UPDATE", near, fact) if near >= 0 else ("ADD", -1, fact))
    return out


class OperationStore:
    """One history's memories under ADD, UPDATE and DELETE.

    ``decide(existing, facts)`` gives the operations of a batch of facts; numbers
    are places among the texts it was shown. With ``k`` it is shown the union of
    the k nearest memories of each fact only, ``cap`` of them at most, the nearest.
    """

    def __init__(self, decide: Callable[[list[str], list[str]], list[Operation]] = first_words, allow_delete: bool = True, k: int | None = None, cap: int = 50) -> None:
        self.decide, self.allow_delete, self.k, self.cap = decide, allow_delete, k, cap
        self.rows: list[dict | None] = []
        self.vectors = _Vectors()
        self.live = 0
        # The offline rule over all memories deletes nothing, so it can look them up.
        self.indexed = decide is first_words and k is None
        self.texts: dict[str, set[int]] = {}
        self.heads: dict[tuple[str, ...], int] = {}

    def _looked_up(self, facts: list[str]) -> list[Operation]:
        """What ``first_words`` says of all memories; places are rows."""
        out: list[Operation] = []
        for fact in facts:
            same, near = min(self.texts.get(fact, ()), default=-1), self.heads.get(_head(fact), -1)
            out.append(("NONE", same, "") if same >= 0 else ("UPDATE", near, fact) if near >= 0 else ("ADD", -1, fact))
        return out

    def _index(self, i: int, old: str | None, new: str) -> None:
        if self.indexed:
            if old is not None:
                self.texts[old].discard(i)
            self.texts.setdefault(new, set()).add(i)
            self.heads.setdefault(_head(new), i)

    def put(self, i: int, row: dict, vector: np.ndarray) -> None:
        """A row that was held before, at its number."""
        self.rows[i] = row
        self.vectors.put(i, vector)
        self.live += 1
        self._index(i, None, row["text"])

    def shown(self, vectors: list[np.ndarray]) -> list[int]:
        live = [i for i, r in enumerate(self.rows) if r is not None]
        if self.k is None or not live:
            return live
        met: dict[int, float] = {}
        for v in vectors:
            near = self.vectors.similar(live, v)
            for i in np.argsort(-near, kind="stable")[: self.k].tolist():
                met.setdefault(live[i], float(near[i]))
        best = set(sorted(met, key=lambda i: -met[i])[: self.cap])
        return [i for i in met if i in best]

    def batch(self, facts: list[tuple[int, str, object, str]], embed=None) -> Iterator[tuple[int, str, int]]:
        """Take in facts (seq, text, vector, time); each operation's seq, kind, and how many rows are held after it."""
        facts = [(seq, text.strip(), vector, time) for seq, text, vector, time in facts if text and text.strip()]
        if not facts:
            return
        vectors = [_unit(v) if v is not None else np.zeros(1) for _, _, v, _ in facts]
        shown = range(len(self.rows)) if self.indexed else self.shown(vectors)
        by_text = {text: (seq, v, time) for (seq, text, _, time), v in zip(facts, vectors, strict=True)}
        last = facts[-1]
        said = [f[1] for f in facts]
        for op, i, text in self._looked_up(said) if self.indexed else self.decide([self.rows[j]["text"] for j in shown], said):
            seq, v, time = by_text.get(text, (last[0], vectors[-1], last[3]))
            if text and text not in by_text and embed:
                v = _unit(embed(text))
            if op == "ADD" and text:
                self.rows.append({"text": text, "time": time, "source": "added", "seq": seq})
                self.vectors.put(len(self.rows) - 1, v)
                self.live += 1
                self._index(len(self.rows) - 1, None, text)
            elif op == "UPDATE" and text and 0 <= i < len(shown) and self.rows[shown[i]] is not None:
                self._index(shown[i], self.rows[shown[i]]["text"], text)
                self.rows[shown[i]] |= {"text": text, "time": time, "source": "updated"}
                self.vectors.put(shown[i], v)
            elif op == "DELETE" and self.allow_delete and 0 <= i < len(shown):
                self.live -= self.rows[shown[i]] is not None
                self.rows[shown[i]] = None
            else:
                op = "NONE"
            yield seq, op, self.live


def _operated(pdf: pd.DataFrame, batch: str | None, embed, settings: dict) -> tuple[OperationStore, list[tuple]]:
    store = OperationStore(**settings)
    return store, operated_into(store, pdf, batch, embed)


def operated_into(store: OperationStore, pdf: pd.DataFrame, batch: str | None = None, embed=None) -> list[tuple]:
    """Facts of one ``batch`` value are decided together; without a column of batches each alone. The log."""
    log, held, now = [], [], None
    for name, seq, text, vector, time, part in _rows(pdf, "history_name", "seq", "text", "embedding", "time", batch or ""):
        if held and (batch is None or part != now):
            log += [(name, *x) for x in store.batch(held, embed)]
            held = []
        now = part
        held.append((seq, text or "", vector, time or ""))
    if held:
        log += [(name, *x) for x in store.batch(held, embed)]
    return log


def operate(pdf: pd.DataFrame, batch: str | None = None, embed=None, **settings) -> pd.DataFrame:
    """The log of one history's operations."""
    return pd.DataFrame(_operated(pdf, batch, embed, settings)[1], columns=["history_name", "seq", "op", "held"])


OPERATE = "history_name string, seq long, op string, held long"


def operated(pdf: pd.DataFrame, batch: str | None = None, embed=None, **settings) -> pd.DataFrame:
    """The store that one history's operations leave."""
    store, _ = _operated(pdf, batch, embed, settings)
    name = pdf["history_name"].iloc[0] if len(pdf) else None
    rows = [(name, i, r["seq"], r["text"], r["time"], r["source"]) for i, r in enumerate(store.rows) if r is not None]
    return pd.DataFrame(rows, columns=["history_name", "memory_id", "seq", "text", "time", "source"])


OPERATED = "history_name string, memory_id long, seq long, text string, time string, source string"
