import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import admission, builders, folds, joins, memory, metrics, postings, relations, retrieval, windows

V = [1.0] + [0.0] * 7


def fold(facts, label, **more):
    store = folds.RelationStore(label=label, threshold=0.0, **more)
    outcomes = [store.add(t, V, "2024-01-01") for t in facts]
    return store, outcomes


def test_conflict_hides_the_new_row_behind_a_fused_answer():
    store, outcomes = fold(["Alice likes blue", "Alice likes red"], lambda a, b: "CON", fuse=lambda r, a, b: f"{a} -> {b}")
    old, new, c = store.rows
    assert outcomes == ["fresh", "conflict_update"]
    assert (old.role, old.edge, old.parent, old.answer) == ("evidence", "UPDATE", new.id, c.id)
    assert (new.role, new.hidden, new.answer) == ("primary", True, c.id)
    assert (c.role, c.text, c.members, c.root) == ("answer", "Alice likes blue -> Alice likes red", [old.id, new.id], new.id)


def test_equivalence_keeps_and_hides_the_old_row():
    store, _ = fold(["Alice works at Google", "Alice is employed by Google"], lambda a, b: "EQV", fuse=lambda *x: "fused")
    old, new, c = store.rows
    assert (old.role, old.hidden, old.answer) == ("primary", True, c.id)
    assert (new.role, new.edge, new.parent) == ("evidence", "EQUIV", old.id)
    assert (c.role, c.root) == ("answer", old.id)


def test_other_plans():
    store, _ = fold(["x"], lambda a, b: "CON")
    assert [(m.role, m.hidden) for m in store.rows] == [("primary", False)]
    store, outcomes = fold(["a", "b", "new"], lambda a, b: "OSN" if b == "new" else "IND")
    assert outcomes[-1] == "stronger_primary"
    assert [(m.role, m.edge) for m in store.rows[:2]] == [("evidence", "ATTACH")] * 2
    store, _ = fold(["short", "the longest of all", "same", "new"], lambda a, b: ("EQV" if a == "same" else "NSO") if b == "new" else "IND")
    assert store.rows[3].parent == 1 and store.rows[3].edge == "ATTACH"
    store, _ = fold(["one", "two", "new"], lambda a, b: {"one": "CON", "two": "OSN"}[a] if b == "new" else "IND")
    assert [m.role for m in store.rows[:2]] == ["evidence", "primary"]
    store, outcomes = fold(["one", "new"], lambda a, b: "CON", active=("EQV",))
    assert outcomes == ["fresh", "fresh"]


def test_raw_texts_stand_in_for_fusion():
    for label, text in (("CON", "new"), ("OSN", "new"), ("NSO", "old"), ("EQV", "old")):
        store, _ = fold(["old ", "new"], lambda a, b, label=label: label)
        assert store.rows[-1].text == text
    store, _ = fold(["a", "b", "c"], lambda a, b: "CON" if b != "b" else "EQV", fuse=lambda r, a, b: None)
    answers = [m for m in store.rows if m.role == "answer"]
    assert answers[0].text.startswith("a\nb")


def test_set_based_plans_agree_with_the_fold(spark):
    rows = [(1, 10, 1, "old text", "NSO"), (1, 11, 2, "much longer old text", "NSO"), (1, 12, 3, "x", "EQV"), (2, 20, 1, "x", "OSN"), (2, 21, 2, "y", "OSN"), (3, 30, 1, "x", "IND"), (4, 40, 2, "x", "CON"), (4, 41, 1, "x", "CON"), (4, 42, 3, "x", "OSN"), (5, 50, 2, "x", "EQV"), (5, 51, 1, "x", "EQV")]
    df = spark.createDataFrame(rows, "new_id int, old_id long, rank int, old string, label string")
    got = {r["new_id"]: r for r in relations.plans(df, ["new_id"]).collect()}
    assert [got[i]["outcome"] for i in range(1, 6)] == ["weaker_evidence", "stronger_primary", "fresh", "conflict_update", "equivalent_evidence"]
    assert (got[1]["parent_id"], got[1]["anchor_id"], got[1]["hide_new"]) == (11, 11, False)
    assert (got[2]["demote_ids"], got[2]["anchor_id"], got[2]["hide_new"]) == ([20, 21], 20, True)
    assert got[3]["anchor_id"] is None and got[3]["hide_new"] is None
    assert got[4]["con_update_ids"] == [41, 40] and got[5]["representative_id"] == 51


def test_visibility(spark):
    rows = [("primary", False, False), ("primary", False, True), ("primary", True, False), ("evidence", False, False), ("answer", False, True), (None, False, False), ("odd", False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, memory_role string, stale boolean, answer_hidden boolean")
    ids = lambda c: [r["i"] for r in df.where(c).orderBy("i").collect()]
    assert ids(memory.searchable_primary()) == [0, 1, 5, 6]
    assert ids(memory.answer_visible()) == [0, 4, 5, 6]


def test_dedup_is_idempotent_and_keeps_dated_copies(spark):
    rows = [("h", 0, "a", "soon", None), ("h", 1, " a ", "2023/05/20 (Sat) 05:03", "primary"), ("h", 2, " ", "", None), ("h", 3, "", "", None), ("h", 4, "a", "2020-01-01 00:00", "evidence"), ("g", 5, "a", "", None)]
    df = spark.createDataFrame(rows, "history_name string, seq long, text string, time string, memory_role string")
    once = memory.deduplicated(df)
    assert sorted(r["seq"] for r in once.collect()) == [1, 2, 3, 4, 5]
    assert once.exceptAll(memory.deduplicated(once)).count() == 0


def test_trees_are_followed_to_their_ends(spark):
    schema = "history_name string, memory_id long, parent_primary long, memory_role string, seq long, text string, time string"
    big = 2**60
    chain = [("h", big + i, big + i - 1 if i else None, "evidence" if i else "primary", i, f"t{i}", "") for i in range(200)]
    # A covered primary and what hangs below it are in no tree; nor is a cycle without a root, or what hangs below nothing.
    apart = [("g", 1, None, None, 1, "a", ""), ("g", 2, 1, "primary", 2, "b", ""), ("g", 3, 2, "evidence", 3, "c", ""), ("g", 4, 5, "evidence", 4, "d", ""), ("g", 5, 4, "evidence", 5, "e", ""), ("g", 6, 99, "evidence", 6, "f", ""), ("g", 7, 1, "answer", 7, "g", "")]
    # Ids that are repeated: once for each way, and never below itself.
    again = [("r", 1, None, "primary", 1, "a", ""), ("r", 2, 1, "evidence", 2, "b", ""), ("r", 2, 1, "evidence", 3, "c", ""), ("r", 3, 2, "evidence", 4, "d", ""), ("r", 1, 3, "evidence", 5, "e", "")]
    none = [(None, 1, None, "primary", 1, "a", ""), (None, 2, 1, "evidence", 2, "b", "")]
    df = spark.createDataFrame(chain + apart + again + none, schema)
    got = sorted((str(r["history_name"]), r["root_id"], r["depth"], r["memory_id"], r["seq"]) for r in memory.descendants(df).collect())
    want = [("h", big, i, big + i, i) for i in range(200)] + [("g", 1, 0, 1, 1), ("g", 1, 1, 7, 7), ("None", 1, 0, 1, 1)]
    want += [("r", 1, 0, 1, 1), ("r", 1, 1, 2, 2), ("r", 1, 1, 2, 3), ("r", 1, 2, 3, 4), ("r", 1, 2, 3, 4)]
    assert got == sorted(want)
    fused = memory.fused_bundles(df.where("history_name = 'h'")).first()
    assert fused["members"] == 200 and fused["text"] == "\n".join(f"t{i}" for i in range(200))
    assert memory.descendants(df.limit(0)).count() == 0


def test_clusters():
    rows = pd.DataFrame({"history_name": "h", "seq": range(5), "embedding": [[1, 0], [0.9, 0.1], [0, 1], [1, 0.05], [1, 0]], "at": [0, None, 0, 3600.0, 30 * 86400.0]})
    assert folds.cluster(rows)["cluster"].str[-1].tolist() == ["0", "0", "1", "0", "2"]
    assert folds.cluster(rows, gap_days=60)["cluster"].str[-1].tolist() == ["0", "0", "1", "0", "0"]


def test_admission(spark):
    assert admission.parse_weights("1,1,1,1,1") == admission.parse_weights(None) == (0.2,) * 5
    with pytest.raises(ValueError):
        admission.parse_weights("1,2,3")
    texts = ["My name is Ann", "I like tea", "they will go", "the sky is blue", "zzz", "happens today"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(admission.type_of(F.col("t")).alias("k"), admission.type_prior(F.col("t")).alias("p"))
    assert [(r["k"], r["p"]) for r in df.collect()] == [("identity", 0.9), ("preference", 0.9), ("plan", 0.5), ("fact", 0.7), ("unknown", 0.5), ("temporary", 0.2)]
    rows = pd.DataFrame({"history_name": "h", "seq": [0, 1, 2], "embedding": [[1, 0], [1, 0], [0, 1]], "utility": 0.5, "confidence": 0.0, "recency": 1.0, "type_prior": 0.5})
    got = folds.admit(rows, (0, 0, 1, 0, 0), 0.5)
    assert got["admitted"].tolist() == [True, False, True] and got["novelty"].tolist() == [1.0, 0.0, 1.0]


def test_operations(spark):
    rows = pd.DataFrame({"history_name": "h", "seq": range(5), "text": ["a b c d", "a b c d", " ", "a b c e", "x"], "time": ""})
    assert folds.operate(rows)["op"].tolist() == ["ADD", "NONE", "UPDATE", "ADD"]
    gone = [("DELETE", 0, "")]
    assert folds.operate(rows, decide=lambda held, facts: gone, allow_delete=False)["op"].tolist() == ["NONE"] * 4
    store = spark.createDataFrame([("h", i, i, f"t{i}", "") for i in range(4)], "history_name string, memory_id long, seq long, text string, time string")
    ops = spark.createDataFrame([("h", 0, "UPDATE", "u", "n", 1), ("h", 1, "DELETE", "", "n", 2), ("h", 2, "UPDATE", " ", "n", 3), ("h", 9, "ADD", "new", "n", 4), ("h", 8, "UPDATE", "z", "n", 5), ("h", 0, "UPDATE", "v", "n", 6)], "history_name string, memory_id long, op string, text string, time string, op_seq long")
    assert sorted((r["memory_id"], r["text"]) for r in memory.applied(store, ops).collect()) == [(0, "v"), (2, "t2"), (3, "t3"), (9, "new")]


def test_windows(spark):
    turns = spark.createDataFrame([("c", i, "user" if i % 2 else "bot", f"t{i}") for i in range(7)], "k string, turn int, role string, text string")
    starts = lambda n, o: sorted({r["start"] for r in windows.turn_windows(turns, "k", "turn", n, o).collect()})
    assert starts(4, 2) == [0, 2, 4, 6] and starts(3, 0) == [0, 3, 6] and starts("all", 0) == [0]
    first = windows.chunks(turns, "k", "turn", 3).orderBy("chunk_index").first()
    assert first["transcript"] == "**assistant**: t0\n\n**user**: t1\n\n**assistant**: t2"
    for bad in (("x", 0), (0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            windows.check_windows(*bad)


def test_bm25_against_the_formula(spark):
    texts = ["a b b c", "a a d", "a e f", "b"]
    m = spark.createDataFrame([("h", i, i, t) for i, t in enumerate(texts)], "history_name string, memory_id long, seq long, text string")
    q = spark.createDataFrame([("h", 1, "b A a zz")], "history_name string, query_id long, query_text string")
    got = {r["memory_id"]: r["bm25"] for r in retrieval.bm25(q, m).collect()}
    docs = [t.split() for t in texts]
    terms = {w for d in docs for w in d}
    raw = {w: np.log(4 - (n := sum(w in d for d in docs)) + 0.5) - np.log(n + 0.5) for w in terms}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    mean = np.mean([len(d) for d in docs])
    for i, d in enumerate(docs):
        want = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in ("b", "a", "a"))
        assert got[i] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block, k", [(8, 3), (64, 5), (1024, 200)])
def test_postings_give_the_rows_of_all_pairs(spark, monkeypatch, block, k):
    r = random.Random(block)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(vocabulary[int(r.random() ** 3 * 60)] for _ in range(r.randint(0, 12)))
    rows = [(h, 1000 * j + i, i, t) for j, (h, n) in enumerate([("big", 300), ("small", 3), ("one", 1)]) for i, t in enumerate(["common W1 w2"] * (n // 10) + [text() for _ in range(n - n // 10)])]
    m = spark.createDataFrame(rows + [("small", 99, 7, None), ("small", 98, 8, "")], "history_name string, memory_id long, seq long, text string")
    asked = [("big", 1, "common w1"), ("big", 2, "w40 w41 w0 w0"), ("big", 3, ""), ("big", 4, None), ("big", 5, "nowhere"), ("small", 6, rows[300][3]), ("one", 7, rows[303][3]), ("none", 8, "w1"), (None, 9, "w1")] + [("big", 10 + i, text()) for i in range(20)]
    q = spark.createDataFrame(asked, "history_name string, query_id long, query_text string")
    monkeypatch.setattr(postings, "FIRST", 1)
    order = [F.desc(F.round("bm25", 9)), F.asc("seq")]
    plain = retrieval.top(retrieval.bm25(q, m.fillna("", ["text"])), ["history_name", "query_id"], order, k)
    rows_of = lambda df: sorted((x["query_id"], x["rank"], x["memory_id"], round(x["bm25"], 9)) for x in df.collect())
    got = rows_of(postings.bm25_top(q, m, k, block))
    assert got == rows_of(plain) and len(got) > 20
    assert postings.bm25_top(q, m.limit(0), k, block).count() == 0 == postings.bm25_top(q.limit(0), m, k, block).count()


def test_an_index_has_a_row_for_each_block(spark):
    """What is shuffled and joined are blocks; terms are rows only where a history has several blocks."""
    m = spark.createDataFrame([(h, i, f"w{i} w{i + 1} {h}") for h, n in (("a", 20), ("b", 8)) for i in range(n)] + [("c", 1, None)], "history_name string, seq long, text string")
    held = postings.index(m, 8)
    assert sorted((r["history_name"], r["block"], r["n"], r["words"], len(r["terms"])) for r in held.collect()) == [("a", 0, 8, 24, 10), ("a", 1, 8, 24, 10), ("a", 2, 4, 12, 6), ("b", 0, 8, 24, 10), ("c", 0, 1, 0, 0)]
    idf = {(r["history_name"], r["block"]): dict(zip(r["terms"], r["idf"], strict=True)) for r in postings.weighted(held).collect()}
    assert idf["a", 0]["w8"] == idf["a", 1]["w8"] == pytest.approx(np.log(18.5) - np.log(2.5)) and len(idf) == 4
    assert postings.index(m, 8, nulls=False).where("history_name = 'c'").first()["sized"] == 0


def test_hybrid_joins_no_terms(spark):
    m = spark.createDataFrame([("h", i, i, f"w{i} same", [1.0, float(i)]) for i in range(9)] + [("h", 9, 9, None, [1.0, 0.5])], "history_name string, memory_id long, seq long, text string, embedding array<double>")
    q = m.select("history_name", F.col("memory_id").alias("query_id"), F.col("text").alias("query_text"), F.col("embedding").alias("query"))
    got = retrieval.hybrid(q, m, 3, 0.0, 1.0)
    assert "explode" not in got._jdf.queryExecution().toString()
    assert {r["query_id"]: r["memory_id"] for r in got.where("rank = 1").collect()} == {i: i if i < 9 else 9 for i in range(10)}


def test_context(spark):
    hits = spark.createDataFrame([("h", 1, 1, "one", "2023/05/20 (Sat) 05:03", 1), ("h", 1, 2, "two", "", 1), ("h", 1, 3, "three", "2023/05/20 (Sat) 05:03", 2)], "history_name string, query_id long, rank int, text string, time string, fused_member_count int")
    asked = spark.createDataFrame([("h", 1), ("h", 2)], "history_name string, query_id long")
    got = {r["query_id"]: r["context"] for r in retrieval.or_nothing(asked, retrieval.context(hits)).collect()}
    assert got[1] == "Memory 1 (2023/05/20 (Sat)):\none\n\nMemory 2:\ntwo\n\nMemory 3:\nthree" and got[2] == retrieval.NOTHING


def test_repeats(spark):
    runs = spark.createDataFrame([(0.1, 90, 1, "b"), (0.2, 100, 2, "b"), (0.3, 110, 3, "b")], "accuracy double, judged long, api_failed long, benchmark string")
    r = metrics.repeats(runs).first()
    assert (r["mean"], r["sample_std"]) == (pytest.approx(0.2), pytest.approx(0.1))
    assert (r["judged_sum"], r["judged_mean"], r["failed_sum"], r["failed_mean"]) == (300, 100, 6, 2)
    assert metrics.repeats(runs.limit(1)).first()["sample_std"] is None
    for bad in (runs.withColumn("accuracy", F.lit(float("nan"))), runs.withColumn("benchmark", F.col("judged").cast("string"))):
        with pytest.raises(Exception, match="accuracy is not|several values"):
            metrics.repeats(bad).collect()


def test_judged_rows_merge(spark):
    old = spark.createDataFrame([("h", "q1", None, None), ("h", "q2", True, None), ("h", "q3", None, None), ("h", None, None, None)], "history_name string, question_id string, is_correct boolean, judge_api_failed boolean")
    new = spark.createDataFrame([("h", "q1", True, False), ("h", "q3", None, True)], "history_name string, question_id string, is_correct boolean, judge_api_failed boolean")
    got = {r["question_id"]: (r["is_correct"], r["judge_api_failed"]) for r in metrics.merged(old, new).collect()}
    assert got == {"q1": (True, False), "q2": (True, None), "q3": (None, True), "h": (None, None)}
    m = metrics.judge_metrics(spark.createDataFrame([("a", True, False), ("a", None, True), ("a", False, False)], "question_type string, is_correct boolean, judge_api_failed boolean")).where("question_type = 'ALL'").first()
    assert (m["judged"], m["correct"], m["accuracy"], m["api_failed"]) == (2, 1, 0.5, 1)


def test_sampling(spark):
    counts = spark.createDataFrame([("A", 7), ("B", 2), ("C", 1)], "question_type string, size long")
    assert {r["question_type"]: r["quota"] for r in joins.quotas(counts, 5).collect()} == {"A": 4, "B": 1, "C": 0}
    items = [((f"h{i}", f"q{i}"), "A" if i < 7 else "B" if i < 9 else None) for i in range(10)]
    for n in (-1, 0, 3, 5, 10, 99):
        got = joins.stratified_local(items, n, 1)
        assert len(got) == (10 if n <= 0 or n > 10 else n) and got == joins.stratified_local(items * 2, n, 1)
        df = spark.createDataFrame([(*k, t) for k, t in items], "history_name string, question_id string, question_type string")
        assert joins.stratified(df, n, 1).count() == len(got)


def test_variants(spark):
    rows = joins.variants(spark, [256, 512], 3).orderBy("place").collect()
    assert [r["token_limit"] for r in rows] == [256] * 3 + [512] * 3 and rows[1]["variant_id"] == "tl256-r01-s1"
    for bad in (([0], 1), ([1], 0)):
        with pytest.raises(ValueError):
            joins.variants(spark, *bad)


def test_distractors_need_exactly_enough_and_strictly_more(spark):
    rows = [(1, i, f"t{i}", 0.5 + 0.01 * i, 0.5, "gold answer") for i in range(10)] + [(2, i, f"t{i}", 0.9, 0.5, "x") for i in range(7)]
    df = spark.createDataFrame(rows, "k int, seq int, text string, sim double, min_sim double, answer string")
    got = builders.distractors(df, "k").orderBy("place").collect()
    assert [r["seq"] for r in got] == list(range(1, 9))


def test_kappa_and_report(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None)], "gold string, pred string")
    r = {x["class"]: x for x in metrics.report(pairs).collect()}
    assert (r["a"]["precision"], r["a"]["recall"], r["b"]["support"], r["MICRO"]["precision"]) == (1.0, 0.5, 2, pytest.approx(2 / 3))
    same = spark.createDataFrame([("a", "a")] * 3, "gold string, pred string")
    assert metrics.kappa(same).first()["kappa"] == 1.0
    assert {(x["gold"], x["pred"]): x["n"] for x in metrics.confusion(pairs, ["a", "b"]).collect()}[("b", "NONE")] == 1
