import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval
from palimpsest.plans import artifacts, backends, construction, experiment
from palimpsest.sources import episodes, store
from palimpsest.streaming import histories

RAW = [{"question_id": "h1", "question": "Where?", "answer": "Lyon", "question_type": "knowledge-update", "question_date": "d", "haystack_dates": ["2023/05/20 (Sat) 05:03", "2023/04/01 (Sat) 10:00"], "haystack_sessions": [[{"role": "user", "content": "I moved to Lyon", "has_answer": True}], [{"role": "user", "content": "I live in Nice"}, {"role": "assistant", "content": "ok"}], [{"role": "user", "content": "late"}]]}]


def test_raw_documents(spark, tmp_path):
    p = tmp_path / "raw.json"
    p.write_text(json.dumps(RAW))
    got = episodes.sessions_of_raw(episodes.read_json(spark, str(p), episodes.RAW)).orderBy("session_no").collect()
    assert [(r["session_key"], r["session_date"][:7], len(r["turns"])) for r in got] == [("session_1", "2023/04", 2), ("session_2", "2023/05", 1), ("session_3", "", 1)]
    t = episodes.turns(spark.createDataFrame(got, episodes.sessions_of_raw(episodes.read_json(spark, str(p), episodes.RAW)).schema)).orderBy("session_no", "turn").collect()
    assert [r["has_answer"] for r in t] == [False, False, True, False]


def test_canonical_documents(spark, tmp_path):
    turn = [{"role": "user", "content": "x"}]
    (tmp_path / "m.json").write_text(json.dumps({"history_id": "", "question_id": "q", "chat_time": {"session_2": "b"}, "chat_history": {"session_10": turn, "session_2": turn, "extra": turn}}))
    got = episodes.sessions_of_canonical(episodes.read_json(spark, str(tmp_path / "m.json"), episodes.CANONICAL)).orderBy("session_no").collect()
    assert [(r["history_name"], r["session_key"], r["session_date"]) for r in got] == [("q", "session_2", "b"), ("q", "session_10", ""), ("q", "extra", "")]
    (tmp_path / "l.json").write_text(json.dumps({"chat_time": ["a"], "chat_history": [turn, turn]}))
    got = episodes.sessions_of_canonical(episodes.read_json(spark, str(tmp_path / "l.json"), episodes.LEGACY)).orderBy("session_no").collect()
    assert [(r["history_name"], r["session_key"], r["session_date"]) for r in got] == [("unknown_history", "session_1", "a"), ("unknown_history", "session_2", "")]


def test_candidates(spark, tmp_path):
    doc = {"history_name": "h1", "chunks": [{"chunk_index": 1, "session_index": 2, "session_date": "d2", "candidate_memories": ["The user lives in Lyon.", " "]}, {"chunk_index": 0, "session_index": 0, "session_date": "d1", "candidate_memories": ["The user lives in Nice.", "The user lives in Nice."]}]}
    (tmp_path / "h1.json").write_text(json.dumps(doc))
    (tmp_path / "stage_manifest.json").write_text("{}")
    facts = episodes.facts(episodes.read_candidates(spark, str(tmp_path)))
    assert [(r["seq"], r["session_index"], r["text"][-6:]) for r in facts.orderBy("seq").collect()] == [(0, 1, " Nice."), (1, 1, " Nice."), (2, 2, " Lyon.")]
    held = experiment.ingest(facts.withColumn("embedding", F.array(F.lit(1.0))), "add_all", {})
    assert [r["text"][-6:] for r in held.orderBy("seq").collect()] == [" Nice.", " Lyon."]


def test_registry_and_paths(spark, tmp_path):
    episodes.register("x", "/data/x.json", "zh")
    assert episodes.resolve("x") == ("/data/x.json", "zh") and episodes.resolve("y", "/o") == ("/o", "en")
    with pytest.raises(KeyError):
        episodes.resolve("y")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text("[]")
    assert episodes.raw_or_preprocessed(str(tmp_path / "pre" / "a.json")) == (str(tmp_path / "raw" / "a.json"), True)
    assert episodes.raw_or_preprocessed(f"file://{tmp_path}/pre/a.json", spark) == (f"file://{tmp_path}/raw/a.json", True)
    with pytest.raises(FileNotFoundError):
        episodes.raw_or_preprocessed(str(tmp_path / "pre" / "b.json"))


def test_store(spark, tmp_path):
    kind = "history_name string, memory_id long, text string, time string"
    path = str(tmp_path / "store")
    store.write(spark.createDataFrame([("a", 1, "x", ""), ("b", 2, "y", "t")], kind), path)
    store.write(spark.createDataFrame([("a", 3, "z", "t")], kind), path)
    assert sorted((r["history_name"], r["memory_id"]) for r in store.read(spark, path).collect()) == [("a", 3), ("b", 2)]
    store.clear(spark, path, "b")
    assert [r["memory_id"] for r in spark.read.parquet(path).collect()] == [3]
    lists = spark.createDataFrame([("h", ["a", "b"], ["x"], None, ["t", "u", "v"])], "history_name string, ids array<string>, texts array<string>, source_indices array<string>, times array<string>")
    assert [(r["text"], r["source_index"], r["time"]) for r in store.aligned(lists).orderBy("seq").collect()] == [("x", "unknown", "t"), ("", "unknown", "u")]
    for _ in range(2):
        store.append_lines(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "lines"))
        store.append_csv(spark.createDataFrame([("b", 1, True, {"a": 1})], "benchmark string, n int, sampled boolean, per_type map<string,int>"), str(tmp_path / "csv"))
    assert episodes.read_lines(spark, str(tmp_path / "lines"), "n int").count() == 2
    row = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first()
    assert (row["benchmark"], row["sampled"]) == ("b", "true") and row.__fields__ == store.CSV_COLUMNS
    store.write_json(str(tmp_path / "d" / "x.json"), {"a": 1})
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": 1} and os.listdir(tmp_path / "d") == ["x.json"]


CONFIG = {"experiment": {"benchmark": "L M", "suffix": "s"}, "methods": {"add_all": {"enabled": True}, "mem0": {"enabled": True, "k": 1}}, "generate": {"memory_token_limit": 256, "retrieve_topk": 3}, "extract": {"granularity": 2}}


def test_fingerprints():
    assert artifacts.slug(CONFIG) == "l-m_s_add_all+mem0_tl256" and artifacts.slug({}) == "run"
    a = artifacts.fingerprint("candidate", CONFIG)
    other = json.loads(json.dumps(CONFIG))
    other["generate"]["retrieve_topk"] = 9
    other["methods"]["mem0"]["k"] = 2
    assert artifacts.fingerprint("candidate", other) == a
    assert artifacts.fingerprint("ingest", other, a, "add_all") == artifacts.fingerprint("ingest", CONFIG, a, "add_all")
    assert artifacts.fingerprint("ingest", other, a, "mem0") != artifacts.fingerprint("ingest", CONFIG, a, "mem0")
    assert artifacts.fingerprint("answer", other, "x") != artifacts.fingerprint("answer", CONFIG, "x")
    assert artifacts.fingerprint("candidate", CONFIG, templates={"a": "1"}) != artifacts.fingerprint("candidate", CONFIG, templates={"a": "2"})
    with pytest.raises(ValueError):
        artifacts.digest(float("nan"))


def test_retrying():
    calls, waits = [], []

    class Flaky:
        def complete(self, prompts):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError
            return ["ok"] * len(prompts)

    assert backends.Retrying(Flaky(), wait=waits.append).complete(["a"]) == ["ok"] and waits == [1.0, 2.0]
    calls.clear()
    assert backends.Retrying(Flaky(), attempts=2, wait=waits.append).complete(["a", "b"]) == [None, None]


def test_wrapped_backends():
    class Echo:
        def __init__(self):
            self.calls = []

        def complete(self, prompts, max_tokens=None):
            self.calls.append((tuple(prompts), max_tokens))
            if "bad" in prompts:
                raise RuntimeError
            if max_tokens and max_tokens > 300:
                raise backends.TooLong
            return [p.upper() for p in prompts]

    e = Echo()
    assert backends.Concurrent(e, 3, attempts=2, wait=lambda s: None).complete(["a", "bad", "c"]) == ["A", None, "C"]
    e = Echo()
    assert backends.Halving(e, 1000).complete(["a"]) == ["A"] and [m for _, m in e.calls] == [1000, 500, 250]
    assert backends.Halving(Echo(), 9000).complete(["a"]) == ["{}"]
    e = Echo()
    assert backends.Batched(e, ("CON", "EQV"), "IND", size=2).complete(["con", "eqv", "what", "bad"]) == ["CON", "EQV", "IND", "IND"]
    assert len(e.calls) == 4
    assert backends.request("Qwen3", "x", 9)["chat_template_kwargs"] == {"enable_thinking": False} and "chat_template_kwargs" not in backends.request("other", "x", 9)
    assert backends.said({"content": " ", "reasoning_content": "r"}) == "r" and backends.said({}) == ""
    backends.register("echo", Echo)
    assert isinstance(backends.model("echo"), Echo)
    with pytest.raises(KeyError):
        backends.model("none")
    a, b = backends.identity(backends.Retrying(backends.HashedWords(8))), backends.identity(backends.Retrying(backends.HashedWords(9)))
    assert a != b and a == backends.identity(backends.Retrying(backends.HashedWords(8)))
    assert [backends.relation_of(x) for x in ('{"relation": "con"}', '```json\n{"relation": "OSN"}\n```', "so: {\"relation\": \"EQV\"}!", "CON", None, "{")] == ["CON", "OSN", "EQV", "IND", "IND", "IND"]


def test_stages_have_locks_and_manifests(spark, tmp_path):
    a, b = (artifacts.Stages(spark, str(tmp_path)) for _ in range(2))
    lock = a.lock("ingest", "k")
    with pytest.raises(artifacts.Busy):
        b.once("ingest", "k", lambda: spark.range(1))
    late = artifacts.Stages(spark, str(tmp_path), stale=5.0, now=lambda: __import__("time").time() + 60)
    assert late.once("ingest", "k", lambda: spark.range(3), upstream="u").count() == 3
    assert not os.path.exists(lock) and late.manifest("ingest", "k") == {"stage": "ingest", "fingerprint": "k", "run": late.run, "upstream": "u"}
    assert b.once("ingest", "k", lambda: 1 / 0).count() == 3 and b.made == [] and late.made == ["ingest/k"]
    with pytest.raises(ZeroDivisionError):
        b.once("ingest", "l", lambda: 1 / 0)
    assert b.once("ingest", "l", lambda: spark.range(1)).count() == 1


def test_markers_follow_files_and_settings(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text("{}")
    done = spark.createDataFrame(artifacts.marked(spark, str(tmp_path), {"k": 1}).collect())
    assert artifacts.unmarked(artifacts.marked(spark, str(tmp_path), {"k": 1}), done).count() == 0
    assert artifacts.unmarked(artifacts.marked(spark, str(tmp_path), {"k": 2}), done).count() == 2
    (tmp_path / "a.json").write_text('{"x": 1}')
    (left,) = artifacts.unmarked(artifacts.marked(spark, str(tmp_path), {"k": 1}), done).collect()
    assert left["path"].endswith("a.json")


class Says:
    """A language model that answers by a function."""

    def __init__(self, rule):
        self.rule = rule

    def complete(self, prompts):
        return [self.rule(p) for p in prompts]


def facts_of(spark, texts):
    words = backends.HashedWords()
    rows = [("h", i, t, "2023/05/20 (Sat) 0%d:00" % i, 1, 0, i, len(texts), "\n".join(texts), words.embed([t])[0]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "history_name string, seq long, text string, time string, session_index int, chunk_index int, pos int, of int, transcript string, embedding array<double>")


def test_ingest_asks_the_models_it_is_given(spark):
    facts = facts_of(spark, ["the user likes tea", "the user likes coffee"])
    label = Says(lambda p: '{"relation": "CON"}' if p.startswith("Compare") else "fused: " + p.split("OLD: ")[1].replace("\n", " | "))
    models = experiment.Backends(label, backends.HashedWords())
    got = {r["memory_id"]: r for r in experiment.ingest(facts, "relation_decision", {"threshold": 0.1}, models).collect()}
    assert [got[i]["memory_role"] for i in range(3)] == ["evidence", "primary", "answer"] and got[1]["answer_hidden"]
    assert got[2]["text"] == "fused: the user likes tea | NEW: the user likes coffee"
    plain = experiment.ingest(facts, "relation_decision", {"threshold": 0.1, "no_fusion": True}, models)
    assert "the user likes coffee" in {r["text"] for r in plain.where("memory_role = 'answer'").collect()}
    assert experiment.ingest(facts, "relation_decision", {"threshold": 0.1, "active": ["EQV"]}, models).where("memory_role <> 'primary'").count() == 0
    log = experiment.decisions(facts, {"threshold": 0.1}, models).orderBy("seq").collect()
    assert [r["event"] for r in log] == ["candidates", "plan", "candidates", "plan", "answer"]


def test_operations_leave_the_store_that_they_say(spark):
    facts = facts_of(spark, ["the user likes tea", "the user likes coffee now", "other"]).withColumn("chunk_index", F.col("seq").cast("int"))

    def rule(p):
        held = p.split("New facts:")[0]
        if "coffee" in p.split("New facts:")[1]:
            return json.dumps({"memory": [{"id": "0", "event": "update", "text": "the user likes coffee now"}, {"id": 7, "event": "DELETE"}, "junk"]})
        if "other" in p.split("New facts:")[1]:
            return json.dumps({"memory": [{"id": 0, "event": "DELETE"}, {"event": "ADD", "text": "other"}]}) if "coffee" in held else "no JSON"
        return json.dumps({"memory": [{"event": "ADD", "text": "the user likes tea"}]})

    models = experiment.Backends(Says(rule), backends.HashedWords())
    got = experiment.ingest(facts, "mem0", {}, models).collect()
    assert [r["text"] for r in got] == ["other"]
    kept = experiment.ingest(facts, "mem0", {"allow_delete": False}, models)
    assert {r["text"] for r in kept.collect()} == {"the user likes coffee now", "other"}
    assert {r["text"] for r in experiment.ingest(facts.where("seq < 2").replace("the user likes coffee now", "the user likes coffee", "text"), "mem0", {}).collect()} == {"the user likes coffee"}


def test_admission_features_come_from_the_chunk(spark):
    facts = facts_of(spark, ["my name is Ann", "my name is Ann Lee", "zzz"])
    plain = {r["seq"]: r for r in experiment.scored(facts, {}, experiment.Backends()).collect()}
    assert [plain[i]["confidence"] for i in range(3)] == [1.0, 1.0, 1.0] and plain[2]["recency"] == 1.0 > plain[0]["recency"]
    asked = experiment.Backends(Says(lambda p: '{"utility": 7}' if "Fact: zzz" in p else "none"))
    assert {r["seq"]: r["utility"] for r in experiment.scored(facts, {}, asked).collect()} == {0: 0.5, 1: 0.5, 2: 1.0}
    assert {r["utility"] for r in experiment.scored(facts, {"skip_utility": True}, asked).collect()} == {0.5}
    only_last = experiment.ingest(facts, "amac", {"weights": "0,0,0,1,0", "threshold": 0.99})
    assert [r["text"] for r in only_last.collect()] == ["zzz"]


def test_clusters_keep_times_and_stable_ids(spark):
    facts = facts_of(spark, ["the user likes tea", "the user likes tea", "other things"])
    a, b = (sorted(map(tuple, experiment.ingest(facts.repartition(n, "seq"), "evermemos", {}).collect())) for n in (1, 5))
    assert a == b and len({r[1] for r in a}) == len(a)
    assert {(r[3], r[4][-5:], r[5]) for r in a} == {("the user likes tea the user likes tea", "01:00", "primary"), ("the user likes tea", "00:00", "evidence"), ("the user likes tea", "01:00", "evidence"), ("other things", "02:00", "primary")}


def test_graph_facts_hold_until_the_next(spark):
    facts = facts_of(spark, ["the user lives in Rome", "the user lives in Lyon", "the user works"])
    assert {r["text"] for r in experiment.ingest(facts, "zep", {}).collect()} == {"User_h lives in Lyon", "User_h works"}


def test_fusion_rewires_and_marks_a_copy(spark, tmp_path):
    kind = "history_name string, memory_id long, seq long, text string, time string, memory_role string, parent_primary long, answer_hidden boolean, answer_id long, stale boolean, fused_member_count long"
    rows = [("h", 0, 0, "a", "2", None, None, None, None, None, None), ("h", 1, 1, "b", "1", "evidence", 0, None, None, None, None), ("h", 2, 2, "c", "3", "primary", None, None, None, None, None), ("h", 3, 3, "d", "4", "primary", 1, None, None, None, None), ("g", 0, 0, "x", "1", None, None, None, None, None, 1), ("g", 1, 1, "y", "1", "evidence", 0, None, None, None, 1)]
    df = spark.createDataFrame(rows, kind).withColumn("member_ids", F.when(F.col("history_name") == "g", F.array("memory_id")))
    got = {(r["history_name"], r["memory_id"]): (r["text"], r["time"], r["parent_primary"], r["fused_member_count"]) for r in experiment.fused(df).collect()}
    assert got == {("h", 4): ("a\nb", "2", None, 2), ("h", 2): ("c", "3", None, 1), ("h", 3): ("d", "4", 4, 1), ("g", 0): ("x", "1", None, 1), ("g", 1): ("y", "1", 0, 1)}
    said = {r["memory_id"]: r["text"] for r in experiment.fused(df, Says(lambda p: "one" if "a" in p else None)).where("history_name = 'h'").collect()}
    assert said == {4: "one", 2: "c", 3: "d"}
    stages = artifacts.Stages(spark, str(tmp_path))
    stages.once("ingest", "k", lambda: df)
    assert experiment.fuse_copy(spark, stages, "k", "f").count() == 5 and spark.read.parquet(stages.path("ingest", "k")).count() == 6
    assert stages.manifest("fusion", "f")["upstream"] == "k"
    again = experiment.fused(spark.read.parquet(stages.path("fusion", "f")))
    assert sorted(map(str, again.collect())) == sorted(map(str, spark.read.parquet(stages.path("fusion", "f")).collect()))


def test_answers_by_each_way_of_retrieval(spark):
    words = backends.HashedWords()
    m = experiment.ingest(facts_of(spark, ["tea is green", "coffee is black", "milk is white"]), "add_all", {})
    q = spark.createDataFrame([("h", "q", "what is black coffee", "black", "t")], "history_name string, question_id string, question string, answer string, question_type string")
    ask = lambda **more: experiment.answer(m, q, "add_all", 1, None, backends.Lines(), words, **more).first()["context"]
    assert ask() == ask(mixed={"dense_weight": 0, "bm25_weight": 1}) == ask(fused_rows=experiment.fused(m)) and "coffee is black" in ask()
    assert "2023" in ask() and "2023" not in ask(show_time=False)
    assert experiment.answer(m, q, "add_all", 1, 2, backends.Lines(), words, trim=lambda c, n: F.upper(c)).first()["context"].startswith("MEMORY 1")


def test_variants_share_what_does_not_change(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW))
    sessions = episodes.sessions_of_raw(episodes.read_json(spark, str(tmp_path / "raw.json"), episodes.RAW))
    questions = spark.createDataFrame([("h1", "q1", "Where does the user live? moved Lyon", "Lyon", "update")], "history_name string, question_id string, question string, answer string, question_type string")
    other = json.loads(json.dumps(CONFIG))
    other["generate"]["memory_token_limit"] = 512
    models = {"extractor": backends.Lines(), "answerer": backends.Lines(), "judging": backends.Containment(), "embedding": backends.HashedWords()}
    runs = [experiment.Run(c, "add_all", **models) for c in (CONFIG, other)]
    assert [s for s, _, _ in experiment.scheduled(runs)] == ["candidate", "ingest", "answer", "answer", "judge", "judge"]
    got = experiment.run_variants(spark, str(tmp_path / "out"), [("a", CONFIG), ("b", other)], ["add_all"], sessions, questions, **models).where("question_type = 'ALL'").collect()
    assert sorted((r["variant_id"], r["method"], r["judged"]) for r in got) == [("a", "add_all", 1), ("b", "add_all", 1)]
    assert sorted(os.listdir(tmp_path / "out" / "stages")) == ["answer", "candidate", "ingest", "judge"]
    assert [len([x for x in os.listdir(tmp_path / "out" / "stages" / s) if x.endswith(".json")]) for s in ("candidate", "ingest", "answer", "judge")] == [1, 1, 2, 2]
    changed = experiment.Run(CONFIG, "add_all", **(models | {"judging": backends.Lines()}))
    assert [changed.keys[s] == runs[0].keys[s] for s in changed.keys] == [True, True, True, False]
    assert experiment.Run(CONFIG, "add_all", nonce="x", **models).keys["candidate"] != runs[0].keys["candidate"]


@pytest.mark.parametrize("method", experiment.METHODS)
def test_the_whole_experiment(spark, tmp_path, method):
    (tmp_path / "raw.json").write_text(json.dumps(RAW))
    sessions = episodes.sessions_of_raw(episodes.read_json(spark, str(tmp_path / "raw.json"), episodes.RAW))
    questions = spark.createDataFrame([("h1", "q1", "Where does the user live? moved Lyon", "Lyon", "update"), ("h1", "q2", "late", "nowhere else", "other"), ("gone", "q3", "x", "y", "other")], "history_name string, question_id string, question string, answer string, question_type string")
    line, judge, words = backends.Lines(), backends.Containment(), backends.HashedWords()
    given = (str(tmp_path / "out"), CONFIG, sessions, questions, method, line, line, judge, words)
    got = {r["question_type"]: (r["correct"], r["judged"]) for r in experiment.run(spark, *given).collect()}
    assert got["ALL"][1] == 3 and got["update"] == (1, 1) and got["other"] == (0, 2)
    stages = artifacts.Stages(spark, str(tmp_path / "out"))
    key = experiment.Run(CONFIG, method, line, line, judge, words).keys["candidate"]
    assert stages.finished("candidate", key) and stages.once("candidate", key, lambda: 1 / 0).count() > 0


def test_facts_as_a_stream(spark, tmp_path):
    kind = "history_name string, seq long, text string"
    spark.createDataFrame([("a", 0, "x"), ("a", 1, " x "), ("b", 2, "x")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = histories.ingested(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("facts_seen").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("a", 3, "x"), ("a", 4, "y")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        got = {r["seq"]: r["is_new"] for r in spark.sql("select * from facts_seen").collect()}
    finally:
        q.stop()
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_a_changed_field_makes_later_stages_anew():
    """Each field of the configuration: the stages from the first one on that depends on it."""
    stages = list(artifacts.STAGE_FIELDS)

    def keys(config):
        out = [""]
        for stage in stages:
            out.append(artifacts.fingerprint(stage, config, out[-1], templates=artifacts.templates_of(stage)))
        return out[1:]

    for path in {p for fields in artifacts.STAGE_FIELDS.values() for p in fields}:
        (_, config), = construction.configurations({}, {path: ["changed"]})
        first = min(i for i, stage in enumerate(stages) if path in artifacts.STAGE_FIELDS[stage])
        assert [a != b for a, b in zip(keys({}), keys(config), strict=True)] == [i >= first for i in range(len(stages))]


def test_models_are_told_what_to_do(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW))
    sessions = episodes.sessions_of_raw(episodes.read_json(spark, str(tmp_path / "raw.json"), episodes.RAW))
    said = lambda **more: experiment.extract(episodes.turns(sessions), "all", 0, Says(lambda p: json.dumps({"memories": [p]})), **more).first()
    got = said(aspects=["events"])
    assert [f.partition(" in this dialogue")[0] for f in got["facts"]] == ["List durable facts about the user", "List what the user did or plans to do, with its time,"]
    assert all(f.endswith("\nDialogue:\n" + got["transcript"].strip()) and '{"memories": [...]}' in f for f in got["facts"])
    assert len(said(aspects=["people", "events"], aspects_only=True)["facts"]) == 2
    with pytest.raises(ValueError):
        said(aspects_only=True)
    asked = spark.createDataFrame([("Where?\nNow", "Lyon", "in Lyon"), ("Who?", "Ann", None)], "question string, answer string, model_answer string")
    prompts = {r["question"]: r["verdict"] for r in experiment.judge(asked, Says(lambda p: p)).collect()}
    assert prompts["Where?\nNow"].startswith("Question: Where? Now\nReference: Lyon\nAnswer: in Lyon\nDoes the answer agree") and "step by step" in prompts["Who?"]
    assert experiment.judge(asked, Says(lambda p: p), use_cot=False).first()["verdict"].endswith("Say only 'yes' or 'no'.")


def test_samples_and_ranking_before_fusion_are_stages_of_a_run(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW))
    sessions = episodes.sessions_of_raw(episodes.read_json(spark, str(tmp_path / "raw.json"), episodes.RAW))
    questions = spark.createDataFrame([("h1", f"q{i}", "Where does the user live?", "Lyon", "update") for i in range(6)], "history_name string, question_id string, question string, answer string, question_type string")
    config = json.loads(json.dumps(CONFIG))
    config["generate"] |= {"answer_stratified_sample": 4, "rank_before_fusion": True}
    config["evaluate"] = {"judge_stratified_sample": 2}
    config.setdefault("experiment", {})["keep_answers"] = True
    line, words = backends.Lines(), backends.HashedWords()
    got = experiment.run(spark, str(tmp_path / "out"), config, sessions, questions, "relation_decision", line, line, backends.Containment(), words)
    assert {r["question_type"]: r["judged"] for r in got.collect()}["ALL"] == 2
    run = experiment.Run(config, "relation_decision", line, line, backends.Containment(), words)
    assert spark.read.parquet(f"{tmp_path}/out/stages/answer/{run.keys['answer']}").count() == 4
    assert artifacts.Stages(spark, str(tmp_path / "out")).finished("fusion", run.keys["fusion"])
    assert len(list((tmp_path / "out" / "answers").glob("*/*.json"))) == 3 + 1 + 1  # chunks, and one question and verdict of six alike
    assert run.keys["answer"] != experiment.Run(CONFIG, "relation_decision", line, line, backends.Containment(), words).keys["answer"]


def test_evidence_lifts_its_fused_row(spark):
    """Only hidden evidence is like the question, so the fused row that holds it comes first."""
    rows = [("h", 0, 0, "tea", [1.0, 0.0, 0.0], None, None), ("h", 1, 1, "green tea", [0.0, 1.0, 0.0], "evidence", 0), ("h", 2, 2, "milk", [0.0, 0.6, 0.8], None, None)]
    memories = spark.createDataFrame(rows, "history_name string, memory_id long, seq long, text string, embedding array<double>, memory_role string, parent_primary long")
    owners = spark.createDataFrame([("h", 10, 0, [0, 1]), ("h", 2, 2, [2])], "history_name string, fused_id long, seq long, member_ids array<long>")
    asked = spark.createDataFrame([("h", 7, [0.0, 1.0, 0.0], "green")], "history_name string, query_id long, query array<double>, query_text string")
    for mixed in (None, {"dense_weight": 0.5, "bm25_weight": 0.5}, {"full_corpus_pool": True}):
        got = retrieval.retrieve(asked, memories, 2, F.col("memory_role").isNull(), mixed, owners).orderBy("rank").collect()
        assert [r["memory_id"] for r in got] == [10, 2]


def test_bundles_name_the_line_a_row_hangs_on(spark):
    rows = [("h", 1, 1, "a", "t", None, None, None), ("h", 2, 2, "b", "t", "evidence", 1, "ATTACH"), ("h", 3, 3, "c", "t", "evidence", 2, "UPDATE"), ("h", 4, 4, "d", "t", "evidence", 2, "EQUIV")]
    memories = spark.createDataFrame(rows, "history_name string, memory_id long, seq long, text string, time string, memory_role string, parent_primary long, edge string")
    (said,) = (r["text"] for r in experiment.fused(memories, Says(lambda p: p)).collect())
    assert said.splitlines()[1:] == ["1. [PRIMARY] a", "2. [ATTACH of 1] b", "3. [UPDATE of 2] c", "4. [EQUIV of 2] d"]


@pytest.mark.parametrize("name", ["a:b", "a/b%c", "..", "plain", "tab\tand [x]={y}"])
def test_a_history_of_any_name_can_be_dropped(spark, tmp_path, name):
    rows = spark.createDataFrame([(name, 1), ("kept", 2)], "history_name string, memory_id long")
    store.write(rows, str(tmp_path / "s"))
    store.clear(spark, str(tmp_path / "s"), name)
    assert [r["history_name"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["kept"]


class Counting:
    """Writes down what it is asked; refuses the prompt "bad" until a file says that it may."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompts):
        with open(os.path.join(self.folder, f"{os.getpid()}.log"), "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        if "bad" in prompts and not os.path.exists(os.path.join(self.folder, "may")):
            raise RuntimeError("refused")
        return [None if p == "none" else p.upper() for p in prompts]


def test_nothing_is_asked_twice(spark, tmp_path):
    (tmp_path / "log").mkdir()
    asked = lambda: sorted(x for f in (tmp_path / "log").glob("*.log") for x in f.read_text().split())
    one = backends.Counting if hasattr(backends, "Counting") else Counting
    rows = spark.createDataFrame([(f"p{i % 20}", i) for i in range(200)] + [("bad", 1), ("none", 2), (None, 3)], "prompt string, n int").repartition(4)
    run = lambda: backends.answered(rows, "prompt", Counting(str(tmp_path / "log")), f"file://{tmp_path}/kept")
    with pytest.raises(Exception, match="refused"):
        run().collect()
    before = asked()
    assert len(before) == len(set(before))  # equal prompts once
    (tmp_path / "log" / "may").write_text("")
    got = {r["prompt"]: r["response"] for r in run().collect()}
    assert got == {f"p{i}": f"P{i}" for i in range(20)} | {"bad": "BAD", "none": None, None: ""}
    kept = {p for p in before if (p not in ("bad", "none"))}
    again = asked()
    # What came back before the failure is not asked for again; calls that failed are.
    assert all(again.count(p) <= 2 for p in kept | {"bad"}) and again.count("none") <= 2
    settled = asked()
    assert {r["prompt"]: r["response"] for r in run().collect()} == got
    assert [p for p in asked() if p != "none"] == [p for p in settled if p != "none"]
