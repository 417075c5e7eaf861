"""The folds against plain loops written for these tests, over the queries' whole tables."""

import json
import math
import os

import pytest

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from palimpsest.functions import rouge  # noqa: E402
from palimpsest.plans import registry  # noqa: E402
from palimpsest.plans.derived import memories  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def by_history(spark):
    out = {}
    for r in sorted(memories(spark, DIR).collect(), key=lambda r: r["seq"]):
        out.setdefault(r["history_name"], []).append(r)
    return out


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def label(old, new):
    a, b = set(old.lower().split()), set(new.lower().split())
    if a == b:
        return "EQV"
    if a < b:
        return "OSN"
    if b < a:
        return "NSO"
    return "CON" if 2 * len(a & b) >= len(a | b) else "IND"


def related(rows):
    """Relation decisions without a language model, row by row, with dictionaries."""
    held, log = [], []
    for r in rows:
        text = (r["text"] or "").strip()
        if not text:
            continue
        v = unit(r["embedding"])
        near = sorted(((-sum(a * b for a, b in zip(m["v"], v)), m["id"]) for m in held if m["role"] == "primary"))
        near = [i for s, i in near if -s >= 0.15 - 1e-12][:5]
        kinds = {i: label(held[i]["text"], text) for i in near}
        kind = next((k for k in ("CON", "OSN", "NSO", "EQV") if k in kinds.values()), None)
        olds = [i for i in near if kinds[i] == kind]
        new = {"id": len(held), "text": text, "v": v, "time": r["time"], "role": "primary", "parent": None, "edge": None, "hidden": False, "answer": None, "members": []}
        held.append(new)
        if kind in ("CON", "OSN"):
            for i in olds:
                held[i] |= {"role": "evidence", "parent": new["id"], "edge": "UPDATE" if kind == "CON" else "ATTACH"}
            anchor, hide, said = held[olds[0]], new, text
        elif kind in ("NSO", "EQV"):
            longest = max(len(held[i]["text"]) for i in olds)
            anchor = held[next(i for i in olds if kind == "EQV" or len(held[i]["text"]) == longest)]
            new |= {"role": "evidence", "parent": anchor["id"], "edge": "ATTACH" if kind == "NSO" else "EQUIV"}
            hide, said = anchor, anchor["text"]
        log.append((kind, new["id"], olds))
        if not kind:
            continue
        if anchor["answer"] is None:
            anchor["answer"] = len(held)
            held.append({"id": len(held), "role": "answer", "parent": None, "edge": None, "hidden": False, "answer": None, "members": [], "text": "", "v": v, "time": ""})
        c = held[anchor["answer"]]
        c |= {"text": said, "v": v, "time": r["time"], "members": c["members"] + [i for i in (anchor["id"], new["id"]) if i not in c["members"]]}
        hide |= {"hidden": True, "answer": c["id"]}
    return held, log


def test_relation_fold_equals_a_plain_loop(spark, by_history):
    want = set()
    for name, rows in by_history.items():
        want |= {(name, m["id"], m["text"], m["time"], m["role"], m["parent"], m["edge"], m["hidden"], m["answer"], len(m["members"])) for m in related(rows)[0]}
    got = {tuple(r) for r in registry.QUERIES["relation_fold"](spark, DIR).collect()}
    assert got == want and len({m[4] for m in want}) >= 1


def test_relation_log_tells_each_plan(spark, by_history):
    from functools import partial

    from palimpsest.operators import folds

    rows = memories(spark, DIR).select("history_name", "seq", "text", "time", "embedding")
    log = {}
    for r in sorted(folds.folded(rows, partial(folds.decisions, threshold=0.15), folds.DECISIONS).collect(), key=lambda r: (r["history_name"], r["seq"])):
        if r["event"] == "plan":
            log.setdefault(r["history_name"], []).append(json.loads(r["detail"]))
    for name, own in by_history.items():
        want = related(own)[1]
        assert [(x["new_id"], x["old_ids"]) for x in log.get(name, [])] == [(i, olds) for _, i, olds in want]
        assert [x["outcome"] == "fresh" for x in log.get(name, [])] == [kind is None for kind, *_ in want]


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_equals_a_plain_table(spark):
    from pyspark.sql import functions as F

    import random

    r = random.Random(2)
    words = "runs running ran cats cat the a happily happy nation national".split()
    given = [(i, " ".join(r.choices(words, k=r.randint(0, 9))), [" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 4))]) for i in range(80)]
    got = {x["i"]: x["f"] for x in spark.createDataFrame(given, "i int, t string, l array<string>").select("i", rouge.best_f(F.col("t"), F.col("l")).alias("f")).collect()}
    for i, t, lines in given:
        best = 0.0
        for x in lines:
            a, b = [rouge.stem(w) for w in t.split()], [rouge.stem(w) for w in x.split()]
            if set(t.split()) & set(x.split()) and a and b:
                n = longest_common(a, b)
                best = max(best, 2 * n / (len(a) + len(b)))
        assert got[i] == pytest.approx(best)


def test_the_sample_takes_the_least_hashes_of_each_type(spark):
    xxhash = pytest.importorskip("xxhash")
    from palimpsest.operators import joins

    rows = [(f"h{i % 7}", f"q{i}", ["a", "b", None, "c"][i % 4 if i % 5 else 0]) for i in range(90)]
    got = {tuple(r) for r in joins.stratified(spark.createDataFrame(rows, "history_name string, question_id string, question_type string"), 20, 9).collect()}
    by = {}
    for h, q, t in rows:
        by.setdefault(t or "unknown", []).append((h, q))
    ideal = {t: 20 * len(x) / 90 for t, x in by.items()}
    quota = {t: int(x) for t, x in ideal.items()}
    for t in sorted(quota, key=lambda t: (-round(ideal[t] - quota[t], 9), t))[: 20 - sum(quota.values())]:
        quota[t] += 1

    def place(h, q):
        x = 42
        for raw in ((9).to_bytes(4, "little"), h.encode(), q.encode()):
            x = xxhash.xxh64(raw, seed=x).intdigest()
        return (x - 2**64 if x >= 2**63 else x, h, q)

    assert got == {(h, q, t) for t, x in by.items() for h, q in sorted(x, key=lambda k: place(*k))[: quota[t]]}
