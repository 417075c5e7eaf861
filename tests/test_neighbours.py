"""Near vectors as a join against all pairs, and the fold over their edges against the fold that compares."""

from functools import partial

import numpy as np
import pytest

from palimpsest.operators import folds, neighbours

SCHEMA = "history_name string, seq long, text string, time string, embedding array<double>, part string"


def facts(seed=1, n=300, d=8):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, d))
    rows = []
    for name in ("a", "b", None):
        size = n if name == "a" else 20
        v = centers[r.integers(0, 12, size)] + 0.15 * r.normal(size=(size, d))
        v[: size // 3] = v[0]  # a third of the facts has one vector
        v[size // 3] = 0.0
        words = [" ".join(r.choice(list("uvwxyz"), r.integers(1, 5))) for _ in range(size)]
        rows += [(name, 7 * i, "" if i % 17 == 5 else words[i], f"t{i}", v[i].tolist(), "clashing") for i in range(size)]
    return [*rows, ("c", 0, "alone", None, [1.0] * d, "x"), ("d", 0, "without a vector", None, None, "x")]


def all_pairs(rows, threshold):
    out = {}
    for name in {r[0] for r in rows}:
        first = {}
        for _, seq, _, _, v, _ in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            if v is not None:
                first.setdefault(tuple(v), seq)
        held = [(s, np.array(v) / (np.linalg.norm(v) or 1.0)) for v, s in first.items()]
        out |= {(name, a, b): float(x @ y) for a, x in held for b, y in held if a <= b and x @ y >= threshold}
    return out


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("threshold", [0.9, -1.0])
def test_edges_are_all_near_pairs(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = facts(n=120)
    found = neighbours.edges(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold).collect()
    want = all_pairs(rows, threshold)
    assert len(found) == len(want)
    assert all(want[x["history_name"], x["a"], x["b"]] == pytest.approx(x["score"], abs=1e-9) for x in found)


def test_blocks_too_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    turn = np.linspace(0, np.pi, 400)
    rows = [("a", i, "x", None, [float(np.cos(t)), float(np.sin(t))], "x") for i, t in enumerate(turn)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = neighbours.blocked(df).select("part", "sub").distinct().count()
    assert neighbours.tiles(neighbours.blocked(df), 0.99).count() < 0.3 * blocks * (blocks + 1) / 2
    assert neighbours.edges(df, 0.99).count() == len(all_pairs(rows, 0.99))


def by_comparing(rows, **settings):
    """The plain loop: every fact against all primaries of its history."""
    out = []
    for name in {r[0] for r in rows}:
        store = folds.RelationStore(**settings)
        for _, _, text, time, v, _ in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            store.add(text or "", v, time or "")
        out += [(name, m.id, m.text, m.time, m.role, m.parent, m.edge, m.hidden, m.answer, len(m.members)) for m in store.rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{"threshold": 0.6}, {"threshold": 0.2, "k": 2}])
@pytest.mark.parametrize("block", [2048, 16])
def test_the_fold_over_edges(spark, monkeypatch, block, settings):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = facts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_comparing(rows, **settings)
    for got in (folds.joined(df, partial(folds.relate, **settings), folds.RELATE, settings["threshold"]), folds.folded(df, partial(folds.relate, **settings), folds.RELATE)):
        assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_operations_look_memories_up(spark):
    r = np.random.default_rng(5)
    rows = [("h", i, " ".join(r.choice(list("abcd"), r.integers(1, 6))), "t") for i in range(800)]
    pdf = spark.createDataFrame(rows, "history_name string, seq long, text string, time string").toPandas()
    plain = lambda existing, given: folds.first_words(existing, given)  # noqa: E731  shown everything, as a model is
    for batch in (None, "seq"):
        assert folds.operate(pdf, batch).equals(folds.operate(pdf, batch, decide=plain))
        assert folds.operated(pdf, batch).equals(folds.operated(pdf, batch, decide=plain))
    pdf["part"] = pdf["seq"] // 7
    assert folds.operated(pdf, "part").equals(folds.operated(pdf, "part", decide=plain))


def test_equal_texts_go_after_each_chunk(spark):
    """The plain loop: after each chunk all rows of the history are compared by text and role."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(120):
        v = r.normal(size=4)
        rows.append(("h", i, " ".join(r.choice(list("uvw"), r.integers(1, 3))), f"t{i}", v.tolist(), i // 10, None if i % 11 == 0 else float(r.integers(0, 50))))
    df = spark.createDataFrame(rows, "history_name string, seq long, text string, time string, embedding array<double>, chunk int, when double")
    store = folds.RelationStore(threshold=0.4)
    for _, i, text, time, v, chunk, when in rows:
        store.add(text, v, time, None, when)
        if i == len(rows) - 1 or rows[i + 1][5] != chunk:
            best: dict = {}
            for m in store.rows:
                if not m.gone:
                    k, own = (m.text, m.role), (m.when is None, m.when or 0.0, m.id)
                    best[k] = min(own, best.get(k, own))
            for m in store.rows:
                if not m.gone and best[m.text, m.role][2] != m.id:
                    m.gone = True
                    store.points.get(m.point, {}).pop(m.id, None)
    want = [(m.id, m.text, m.role, m.parent, m.answer) for m in store.rows if not m.gone]
    assert any(m.gone for m in store.rows)
    got = folds.joined(df, partial(folds.relate, threshold=0.4, chunk="chunk"), folds.RELATE, 0.4).orderBy("memory_id")
    assert [tuple(x) for x in got.select("memory_id", "text", "memory_role", "parent_primary", "answer_id").collect()] == want


def test_admission_forgets_equal_texts(spark):
    """The plain loop: novelty against the last rows of a store from which equal texts go after each chunk."""
    r = np.random.default_rng(9)
    rows = [("h", i, str(r.choice(list("abcde"))), r.normal(size=3).tolist(), i // 6, float(r.integers(0, 9)), 0.5, 0.5, 0.5, 0.5) for i in range(90)]
    pdf = spark.createDataFrame(rows, "history_name string, seq long, text string, embedding array<double>, chunk int, when double, utility double, confidence double, recency double, type_prior double").toPandas()
    weights, threshold = (0.1, 0.1, 0.6, 0.1, 0.1), 0.35
    store, want = [], []
    for i, (_, _, text, v, chunk, when, *_) in enumerate(rows):
        u = np.array(v) / np.linalg.norm(v)
        novelty = min(1.0, max(0.0, 1 - max(x @ u for *_, x in store[-64:]))) if store else 1.0
        want.append(0.1 * 0.5 * 4 + 0.6 * novelty >= threshold)
        if want[-1]:
            store.append((text, when, i, u))
        if i == len(rows) - 1 or rows[i + 1][4] != chunk:
            store = [x for x in store if (x[1], x[2]) == min((y[1], y[2]) for y in store if y[0] == x[0])]
    got = folds.admit(pdf, weights, threshold, "chunk")["admitted"].tolist()
    assert got == want and 0 < sum(want) < len(want)
    assert got != folds.admit(pdf, weights, threshold)["admitted"].tolist()
