import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import repair, rouge
from palimpsest.operators import golden
from palimpsest.plans import config, prompts


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("conflated", "conflat"), ("hopeful", "hope")])
def test_stems(word, stem):
    assert rouge.stem(word) == stem


def brute(a, b):
    if not a or not b:
        return 0
    return 1 + brute(a[:-1], b[:-1]) if a[-1] == b[-1] else max(brute(a[:-1], b), brute(a, b[:-1]))


def test_common_subsequences():
    import random

    r = random.Random(0)
    for _ in range(60):
        a, b = [[r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(2)]
        assert rouge.common(a, b) == brute(a, b)


def test_best_line(spark):
    df = spark.createDataFrame([("the cats sat", ["a dog", "the cat sitting there"]), ("x", ["y"]), (None, None)], "f string, l array<string>")
    got = [r["v"] for r in df.select(rouge.best_f(F.col("f"), F.col("l")).alias("v")).collect()]
    assert got == [pytest.approx(2 * 2 / 7), 0.0, 0.0]


def test_broken_json(spark):
    given = ['{"a": [1, 2, {"b": "x', 'so: {"a": 1} done', '{"a": 1, "b', "none", None, '["x", "y']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r["v"] and json.loads(r["v"]) for r in df.select("i", repair.repaired(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [{"a": [1, 2, {"b": "x"}]}, {"a": 1}, {"a": 1}, None, None, ["x", "y"]]


def test_golden(spark):
    raw = spark.createDataFrame([("q", ["s1", "s2", "s2"], ["s2", "gone"])], "question_id string, haystack_session_ids array<string>, answer_session_ids array<string>")
    assert [tuple(r) for r in golden.evidence_sessions(raw).collect()] == [("q", "s2", 1)]
    facts = spark.createDataFrame([("q", 0, "A", ""), ("q", 1, "a ", "2023/05/20 10:00"), ("q", 2, "in 2019 b", " ")], "question_id string, seq int, text string, date string")
    assert sorted((r["seq"], r["date"]) for r in golden.dated(golden.consolidated(facts)).collect()) == [(1, "2023/05/20 10:00"), (2, "2019")]
    asked = spark.createDataFrame([("q",), ("q_abs",), ("r",)], "question_id string")
    assert [r["question_id"] for r in golden.answerable(asked, facts).collect()] == ["q"]
    d = spark.createDataFrame([("2023/05/20 (Sat) 05:03",), ("soon",)], "d string")
    assert [r[0] for r in d.select(golden.a_year_before(F.col("d"))).collect()] == ["2022/05/20 (Sat) 05:03", "soon"]
    t = spark.createDataFrame([("The user moved last week to Lyon.",), ("It was on May 3rd, 2021 there",)], "t string")
    assert [r[0] for r in t.select(golden.without_time(F.col("t"))).collect()] == ["The user moved to Lyon.", "It was there"]
    edits = spark.createDataFrame([("q", 0, "new", True), ("q", 1, "no", False)], "question_id string, seq int, text string, accepted boolean")
    assert {r["seq"]: r["text"] for r in golden.edited(facts, edits, ["question_id", "seq"]).collect()}[0] == "new"


def test_prompts(spark):
    assert "OLD: a" in prompts.fuse("CON", "a", "b")
    with pytest.raises(ValueError):
        prompts.fuse("IND", "a", "b")
    df = spark.createDataFrame([("x{y}", None)], "a string, b string")
    got = df.select(prompts.rendered('{{"k": {a} }} {b}!', a=F.col("a"), b=F.col("b")), prompts.judged_text(F.col("a"), F.col("a"), F.col("b"), F.lit("h"))).first()
    assert got[0] == '{"k": x{y} } !' and "Answer: h\n" in got[1]
    assert df.select(prompts.bundle_lines(F.array(F.struct(F.lit("t").alias("text"), F.lit(None).cast("string").alias("edge"), F.lit(None).cast("int").alias("parent")), F.struct(F.lit("u").alias("text"), F.lit("EQUIV").alias("edge"), F.lit(1).alias("parent"))))).first()[0] == "1. [PRIMARY] t\n2. [EQUIV of 1] u"


def test_variants_and_manifests(tmp_path):
    c = config.Config.of({"sweep": {"memory_token_limits": [256, 512, 256]}, "replication": {"repeats": 3, "base_seed": 5}})
    v = c.variants()
    assert [i for i, _ in v] == [f"tl{t}-r{r:02d}-s{5 + r}" for t in (256, 512) for r in range(3)]
    assert v[4][1]["generate"] | {"hybrid": {}} == c.resolved()["generate"] | {"memory_token_limit": 512, "answer_sample_seed": 6, "hybrid": {}}
    for bad in ({"x": {}}, {"sweep": {"memory_token_limits": [0]}}, {"replication": {"repeats": 2, "seeds": [1]}}, {"models": {"nope": 1}}):
        with pytest.raises(ValueError):
            config.Config.of(bad)
    folder = config.run_folder(str(tmp_path), v[0][1])
    assert config.run_folder(str(tmp_path), v[0][1]) == folder != config.run_folder(str(tmp_path), v[1][1])
    (tmp_path / folder / "manifest.json").write_text('{"hash": "other"}')
    with pytest.raises(ValueError):
        config.run_folder(str(tmp_path), v[0][1])
