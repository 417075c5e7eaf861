"""Steps whose tasks must not grow with a key's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import admission, joins
from palimpsest.plans import derived


def test_dates_are_numbered_without_their_facts(spark):
    chunks = spark.createDataFrame([(1, 4, "2023-01"), (1, 2, "2023-01"), (1, 7, "2023-03"), (2, 0, None)], "k long, chunk_index long, date string")
    extra = spark.createDataFrame([(1, "2023-01", "a"), (1, "2023-02", "b"), (1, "2023-02", "b"), (1, "2023-05", "c"), (2, None, "d"), (3, "2023-01", "e"), (None, "2023-01", "f")], "k long, date string, fact string")
    got = joins.matched_by_date(chunks, extra, "k")
    assert sorted((r["fact"], r["chunk_index"], r["is_new"]) for r in got.collect()) == [("a", 2, False), ("b", 8, True), ("b", 8, True), ("c", 9, True), ("d", 1, True), ("e", 0, True), ("f", 0, True)]
    tree = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = lambda what: next(i for i, x in enumerate(tree) if what in x)
    assert first("Join") < first("Window ")  # facts meet what was numbered


def test_novelty_goes_over_batches(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(150, 5))
    rows = [(h, i, v[i + o].tolist()) for h, n, o in (("a", 100, 0), ("b", 30, 100), ("c", 1, 149)) for i in range(n)]
    m = spark.createDataFrame([*rows, ("b", 30, None)], "history_name string, seq long, embedding array<double>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = admission.novelty_setwise(m.withColumn("x", F.col("seq") * 2), "x")
        got = {(r["history_name"], r["seq"]): r["novelty"] for r in df.collect()}
        assert "collect_list" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for h, n, o in (("a", 100, 0), ("b", 30, 100), ("c", 1, 149)):
        for i in range(n):
            want = 1.0 if i == 0 else np.clip(1 - (u[o + max(0, i - 64) : o + i] @ u[o + i]).max(), 0, 1)
            assert got[h, i] == pytest.approx(want, abs=1e-12)
    assert got["b", 30] == 1.0 and len(got) == 132


def test_pairs_of_facts_deal_texts_by_blocks(spark, tmp_path):
    spark.createDataFrame([(i, f"w{i} a b c") for i in range(48, 53)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = derived.fact_pairs(spark, str(tmp_path))
    assert sorted((r["new_id"], r["old_id"], r["rank"]) for r in pairs.collect()) == [(48, 48, 1), (49, 48, 2), (49, 49, 1), (50, 50, 1), (51, 50, 2), (51, 51, 1), (52, 50, 3), (52, 51, 2), (52, 52, 1)]
    plan = pairs._jdf.queryExecution().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(old_id" not in plan
