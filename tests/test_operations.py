"""The offline rule of operations over tables gives the rows of the fold."""

import random

from palimpsest.operators import folds, operations


def test_operations_over_tables_hold_no_history(spark, monkeypatch):
    monkeypatch.setattr(operations, "SPAN", 7)
    r = random.Random(2)
    texts = ["a b c", "A b C d", " a b c e ", "x", "x y", "", None, "  ", "q w e r", "q w e t"]
    rows = [(h, 3 * i, r.choice(texts), f"t{i}") for h, n in (("one", 60), ("two", 9), ("three", 1)) for i in range(n)]
    m = spark.createDataFrame(rows, "history_name string, seq long, text string, time string").repartition(3)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(operations.left(m), folds.folded(m, folds.operated, folds.OPERATED))
    assert same(operations.log(m), folds.folded(m, folds.operate, folds.OPERATE))
    assert operations.left(m).count() > 4


def test_the_query_has_no_task_for_a_whole_history(spark, tmp_path):
    from palimpsest.plans import memory_queries

    spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (memory_queries.mem0_store, memory_queries.mem0_fold):
        assert "Pandas" not in query(spark, str(tmp_path))._jdf.queryExecution().toString()
