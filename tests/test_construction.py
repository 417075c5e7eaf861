import json

import pytest

from palimpsest.operators import admission
from palimpsest.plans import artifacts, backends, construction
from palimpsest.sources import episodes


class Says:
    """A language model that answers by a function."""

    def __init__(self, rule):
        self.rule = rule

    def complete(self, prompts):
        return [self.rule(p) for p in prompts]


def turn(text):
    return {"role": "user", "content": text, "has_answer": False}


RAW = [
    {"question_id": "q1", "question": "Where?", "answer": "Lyon", "haystack_dates": ["2023/05/20 (Sat) 10:00", "2023/05/21 (Sun) 10:00"], "haystack_sessions": [[turn("I moved to Lyon")], [turn("noise")]], "haystack_session_ids": ["s1", "s2"], "answer_session_ids": ["s1"]},
    {"question_id": "q2", "question": "What?", "answer": "tea", "haystack_dates": ["2023/05/20 (Sat) 10:00", ""], "haystack_sessions": [[turn("hm")], [turn("well")]], "haystack_session_ids": ["s1", "s2"], "answer_session_ids": ["s2", "s1"]},
    {"question_id": "q3_abs", "question": "Who?", "answer": "none", "haystack_dates": [], "haystack_sessions": [], "haystack_session_ids": [], "answer_session_ids": []},
]


def test_golden_facts_with_a_second_look(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW))
    raw = episodes.read_json(spark, str(tmp_path / "raw.json"), episodes.RAW)

    def rule(p):
        if "hm" in p and "well" in p:
            return '{"memories": ["The user drinks tea"]}'
        return '{"memories": ["The user moved to Lyon", "The user moved to Lyon"]}' if "Lyon" in p.split("Session of")[1] else '{"memories": []}'

    got = {(r["question_id"], r["text"], r["date"]) for r in construction.golden_facts(raw, Says(rule), construction.kept_in(spark, str(tmp_path / "kept"))).collect()}
    assert got == {("q1", "The user moved to Lyon", "2023/05/20 (Sat) 10:00"), ("q2", "The user drinks tea", "2023/05/20 (Sat) 10:00"), ("q3_abs", None, "")}


def test_lowered_facts_distractors_and_records(spark, tmp_path):
    keep = construction.kept_in(spark, str(tmp_path / "kept"))
    words = backends.HashedWords()
    facts = spark.createDataFrame([("q1", 0, "where does the user live", "lyon", "the user lives in lyon"), ("q2", 0, "what", "tea", "x"), ("q3_abs", 0, "who", "none", None)], "question_id string, seq int, question string, answer string, text string")
    rewrite = {1: "the user lives in lyon now", 2: "lyon is home", 3: "somewhere else"}
    language = Says(lambda p: "" if "tea" in p else rewrite[int(p[-1])])
    lowered = construction.lowered_facts(facts, language, backends.Containment(), words, keep)
    ((q, seq, text, sim),) = [tuple(r) for r in lowered.collect()]
    assert (q, seq, text) == ("q1", 0, "lyon is home")

    items = spark.createDataFrame([("q1", "where does the user live", "lyon", -1.0), ("q2", "what does the user drink", "tea", -1.0)], "question_id string, question string, answer string, min_sim double")
    said = lambda p: "\n".join(f"The user lives near place {p[-1]}{i}" for i in range(3)) + "\nThe user lives in Lyon\nshort" if "lyon" in p else "The user drinks tea always"
    got = construction.distractor_facts(items, Says(said), backends.Containment(), words, keep, count=5, rounds=4).orderBy("place").collect()
    assert [(r["question_id"], r["text"]) for r in got] == [("q1", f"The user lives near place {k}") for k in ("00", "01", "02", "10", "11")]
    again = construction.distractor_facts(items, Says(lambda p: 1 / 0), backends.Containment(), words, keep, count=5, rounds=2)
    assert again.count() == 5  # what was said is kept
    dated = spark.createDataFrame([("q1", 0, text, "2023/05/20 (Sat) 10:00")], "question_id string, seq int, text string, date string")
    (r,) = construction.records(items.select("question_id", "question", "answer"), dated, again).collect()
    assert [(x["text"], x["date"]) for x in r["facts"]] == [(text, "2023/05/20 (Sat) 10:00")]
    assert [x["date"] for x in r["distractors"]] == ["2022/05/20 (Sat) 10:00"] * 5
    sizes = construction.filler_sets(again, (0, 2, 4)).groupBy("n").count().collect()
    assert {x["n"]: x["count"] for x in sizes} == {0: 1, 2: 2, 4: 4}


def test_configurations_and_migration(spark, tmp_path):
    given = construction.configurations({"generate": {"retrieve_topk": 5}}, {"generate.memory_token_limit": [256, 512], "models.answer": ["a", "b"]})
    assert [n for n, _ in given] == [f"memory_token_limit-{t}_answer-{m}" for t in (256, 512) for m in "ab"]
    assert given[3][1] == {"generate": {"retrieve_topk": 5, "memory_token_limit": 512}, "models": {"answer": "b"}}
    paths = construction.write_configurations(str(tmp_path / "c"), given)
    assert json.loads(open(paths[0]).read()) == given[0][1]
    (tmp_path / "old").mkdir()
    chunk = {"chunk_index": 0, "session_index": 1, "turn_start": 0, "turn_end": 1, "session_date": "d", "candidate_memories": [" a ", ""], "parse_error": None, "source": None}
    (tmp_path / "old" / "h.json").write_text(json.dumps({"history_name": "h", "chunks": [chunk]}))
    stages = artifacts.Stages(spark, str(tmp_path / "new"))
    assert [r["text"] for r in construction.migrated(spark, str(tmp_path / "old"), stages, "k").collect()] == ["a"]
    assert stages.manifest("candidate", "k")["source"].endswith("old")


def test_weights_and_given_types(spark):
    from pyspark.sql import functions as F

    assert admission.parse_weights("1,1,1,1,1,") == (0.2,) * 5
    for bad in ("nan,1,1,1,1", "1,1", "-1,1,1,1,1", "0,0,0,0,0", "[1, 1, 1, 1, Infinity]"):
        with pytest.raises(ValueError):
            admission.parse_weights(bad)
    df = spark.createDataFrame([("my name is Ann", " "), ("my name is Ann", None), ("x", "Plan"), ("x", "odd")], "t string, g string")
    assert [r[0] for r in df.select(admission.type_prior(F.col("t"), F.col("g"))).collect()] == [0.5, 0.9, 0.5, 0.5]
