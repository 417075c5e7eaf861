import importlib

import pytest

from . import samples

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages_keep_columns_and_act(spark, tmp_path):
    r = samples.words(77, 45)
    rows = samples.documents() + [(700, " ".join(samples.words(71, 30) + r + samples.words(72, 30)), "en", "s", 0)]
    toxic = [(2000 + i, " ".join([*samples.words(3000 + i, 12), *(["vilest"] if i % 2 else [])]), "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows + toxic, samples.DOCUMENTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(r))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
        counts.append(kept.count())
        ids = {x["doc_id"] for x in kept.select("doc_id").collect()}
        if name == "toxicity":
            assert len([i for i in ids if i and i >= 2000 and i % 2]) <= 5 and len([i for i in ids if i and i >= 2000 and i % 2 == 0]) >= 98
        if name == "ngram_jaccard_join":
            assert 10 in ids and not {11, 12, 13} & ids and 34 not in ids
        if name == "benchmark_decontamination":
            assert 700 not in ids and 20 in ids
    assert counts[-1] == counts[-2]
    assert pipeline.run(spark, str(tmp_path)).count() == counts[-1]


def tables(spark, folder, rows, marks, items):
    docs = samples.frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    tables(spark, f"{tmp_path}/none", [], [], [])
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = samples.documents()
    tables(spark, f"{tmp_path}/some", rows, [], [(1, None), (2, "")])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in pipeline.run(spark, f"{tmp_path}/some").collect())
    gone = {11, 12, 13, 32, 34}  # copies and near copies of 10, 31 and 33
    assert got == [(False, i) for i in sorted({r[0] for r in rows if r[0] is not None} - gone - {60})] + [(True, 0)]


def test_registry_names_every_operator():
    registry = importlib.import_module("palimpsest.llm.registry")
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
