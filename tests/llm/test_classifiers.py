import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, licenses, toxicity

from . import samples


def corpus(n: int, seed: int = 0):
    r = random.Random(seed)
    syllables = {"aa": ["the", "ing", "and"], "bb": ["der", "sch", "ung"], "cc": ["eau", "oir", "ent"]}
    for i in range(n):
        lang = r.choice(sorted(syllables))
        yield i, " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(r.randint(5, 40))), lang


def test_language_held_out_accuracy_and_edge_rows(spark):
    rows = [(i, t, k, "s", 0) for i, t, k in corpus(300)]
    docs = samples.frame(spark, rows)
    model = list(langid.models(docs.where("doc_id % 3 <> 0")))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    held = [(i, k) for i, _, k, _, _ in rows if i % 3 == 0]
    assert np.mean([got[i]["lang_pred"] == k for i, k in held]) >= 0.98
    edge = {r["doc_id"]: r for r in langid.predict(samples.frame(spark), model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (40, 41, 42))
    assert all(0 <= r["score"] <= 1 for r in edge.values())
    nothing = langid.models(samples.empty(spark))
    assert {r["lang_pred"] for r in langid.predict(samples.frame(spark), nothing).collect()} == {"und"}
    assert langid.predict(samples.empty(spark), model).count() == 0


def test_language_counts_match_a_plain_count():
    from palimpsest.llm import text

    codes, offs = text.folded(["Ab1 b", None, ""])
    assert codes.tolist() == [0, ord("a"), ord("b"), 0, ord("b"), 0, 0, 0]
    assert offs.tolist() == [0, 6, 7, 8]


def plain_grams(t: str):
    """Distinct n-grams' counts of one text, letters lower-cased, one 0 for each run of anything else."""
    codes = [0]
    for c in t.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    if codes[-1] or len(codes) == 1:
        codes.append(0)
    if not t:
        codes = [0]
    return codes


def bucket(gram, bits: int) -> int:
    h = 0
    for c in gram:
        h = (h + c) * 0x9E3779B97F4A7C15 % 2**64
    return ((h ^ (h >> 29)) * ((0xBF58476D1CE4E5B9 + 2 * len(gram)) % 2**64) % 2**64) >> (64 - bits)


def plain_buckets(t: str | None, orders, bits: int) -> list[int]:
    codes = plain_grams(t or "")
    return [bucket(codes[i : i + n], bits) for n in orders for i in range(len(codes) - n + 1)]


EDGE = ["", None, " \t", "a", "Ab1 b", "x" * 5, "éÉ 漢 \x00 q", " ".join(["der", "schung"] * 20_000), "the ing", "the ing"]


def test_language_scores_equal_plain_naive_bayes(spark):
    rows = [(i, t, k, "s", 0) for i, t, k in corpus(120, 5)]
    (model,) = langid.models(samples.frame(spark, rows))
    counts = {k: np.full(1 << langid.BITS, langid.SMOOTHING) for k in ("aa", "bb", "cc")}
    for _, t, k, _, _ in rows:
        for x in plain_buckets(t, langid.ORDERS, langid.BITS):
            counts[k][x] += 1
    given = [(i, t, None, None, 0) for i, t in enumerate([*EDGE, *(t for _, t, *_ in rows[:20])])]
    got = {r["doc_id"]: r for r in langid.predict(samples.frame(spark, given), [model]).collect()}
    for i, t, *_ in given:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        own = plain_buckets(t, langid.ORDERS, langid.BITS)
        z = {k: np.log(c / c.sum())[own].sum() + np.log(sum(r[2] == k for r in rows) / len(rows)) for k, c in counts.items()}
        best = max(z, key=lambda k: (z[k], [-ord(c) for c in k]))
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(np.exp(x - z[best]) for x in z.values()), rel=1e-9)


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_language_scores_depend_on_the_text_alone(spark, parts):
    rows = [(i, t, k, "s", 0) for i, t, k in corpus(200, 6)]
    (model,) = langid.models(samples.frame(spark, rows))
    short = [(i, t[: 1 + i % 9], k, s, n) for i, t, k, s, n in rows] + [(900 + i, t, None, None, 0) for i, t in enumerate(EDGE)]
    want = [langid.log_scores(model, [t])[0] for _, t, *_ in short]
    assert np.array_equal(langid.log_scores(model, [t for _, t, *_ in short]), np.array(want), equal_nan=True)
    found = samples.frame(spark, short).repartition(parts, F.xxhash64("doc_id"))
    got = {r["doc_id"]: r["score"] for r in langid.predict(found, [model]).collect()}
    alone = {i: 0.0 if np.isnan(w[0]) else np.exp(w.max() - np.log(np.exp(w - w.max()).sum()) - w.max()) for (i, *_), w in zip(short, want)}
    assert got == {i: pytest.approx(x, rel=1e-12) for i, x in alone.items()}


def test_languages_of_several_passes_compete(spark, monkeypatch):
    rows = [(i, t, f"{k}{i % 5}", "s", 0) for i, t, k in corpus(400, 8)]
    docs = samples.frame(spark, rows)
    (whole,) = langid.models(docs)
    monkeypatch.setattr(langid, "MAX_LANGS", 4)
    parts = list(langid.models(docs))
    assert len(parts) > 2 and sorted(x for m in parts for x in m.langs) == whole.langs
    get = lambda m: {r["doc_id"]: (r["lang_pred"], pytest.approx(r["score"], rel=1e-9)) for r in langid.predict(docs, m).collect()}
    assert get(parts) == {k: (a, b.expected) for k, (a, b) in get([whole]).items()}


def test_toxicity_scores_equal_plain_sums(spark):
    rows = list(toxic_corpus(200))
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), 0.25)
    given = [(i, t, None, None, 0) for i, t in enumerate([*EDGE, *(t for _, t, _ in rows[:30])])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(samples.frame(spark, given).repartition(5), model).collect()}
    for i, t, *_ in given:
        z = model.bias + sum(float(model.weights[b]) for b in sorted(set(plain_buckets(t, toxicity.ORDERS, toxicity.BITS))))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-6)


def test_toxicity_weights_are_ratios_of_plain_counts_times_coefficients():
    rows = list(toxic_corpus(200))
    y = np.array([y for *_, y in rows])
    model = toxicity.fit([t for _, t, _ in rows], y, 0.25)
    held = [set(plain_buckets(t, toxicity.ORDERS, toxicity.BITS)) for _, t, _ in rows]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    for b in set().union(*held):
        toxic, other = (sum(b in h for h, k in zip(held, y) if k == v) for v in (1, 0))
        ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
        if toxic + other < toxicity.MIN_DOCS or abs(ratio) < toxicity.MIN_RATIO:
            assert model.weights[b] == 0
        elif toxic == n1 and not other:
            assert model.weights[b] > 0


def test_toxicity_sample_is_bounded_by_characters(spark):
    rows = list(toxic_corpus(300))
    docs = samples.frame(spark, [(i, t, None, None, 0) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    thin = toxicity.train(docs, labels, max_chars=sum(len(t) for _, t, _ in rows) // 3)
    whole = toxicity.train(docs, labels)
    assert not np.array_equal(thin.weights, whole.weights)
    again = toxicity.train(docs.repartition(5), labels)
    assert np.array_equal(again.weights, whole.weights) and again.bias == whole.bias


def toxic_corpus(n: int):
    for i, t, _ in corpus(n, 9):
        w = t.split()
        if i % 4 == 0:
            w.insert(len(w) // 2, random.Random(i).choice(["nasty", "vilest"]))
        yield i, " ".join(w), int(i % 4 == 0)


def test_toxicity_finds_planted_words_and_leaves_clean_texts(spark):
    rows = list(toxic_corpus(600))
    model = toxicity.fit([t for i, t, _ in rows if i % 3], np.array([y for i, _, y in rows if i % 3]), 0.25)
    test = [(t, y) for i, t, y in rows if i % 3 == 0]
    s = toxicity.scores(model, [t for t, _ in test])
    assert ((s >= 0.7) == np.array([y for _, y in test], bool)).mean() > 0.98
    docs = samples.frame(spark)
    assert sorted(r["doc_id"] or 0 for r in toxicity.score(docs, model).collect()) == sorted(r[0] or 0 for r in samples.documents())
    kept = toxicity.clean(samples.frame(spark, [(i, t, None, None, 0) for i, t, _ in rows]), model)
    assert kept.columns == docs.columns
    assert abs(kept.count() - sum(1 - y for _, _, y in rows)) <= 6
    assert toxicity.clean(samples.empty(spark), model).count() == 0


def test_toxicity_training_over_tables(spark):
    rows = list(toxic_corpus(300))
    docs = samples.frame(spark, [(i, t, None, None, 0) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9999, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.scores(model, [rows[0][1]])[0] > 0.7 > toxicity.scores(model, [rows[1][1]])[0]
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.scores(none, ["x", None])[0] < 0.01
    assert toxicity.train(samples.empty(spark), labels.limit(0)).bias < 0


def test_held_out_is_the_crc_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(200).select("id", langid.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_license_automata():
    a = licenses.compile_template("x", "a <<optional>> b <<end>> <<var 3>> c")
    say = lambda t: a.accept(t.encode().split(), 0)
    assert [say("a c"), say("a b c"), say("a b q q q c"), say("a q q q q c"), say("b c"), say("a b")] == [2, 3, 6, 0, 0, 0]
    mit = b"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction"
    assert licenses.scan(mit)["labels"] == "mit"
    assert licenses.scan(mit.replace(b"hereby", b"herewith"))["labels"] == ""


def wording(markup: str, filled: int) -> list[str]:
    """Mandatory words of a template, and some words for its replaceable regions."""
    import re

    out, skip = [], False
    for piece in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if piece.startswith("<<var"):
            out += ["Holder"] * filled
        elif piece.startswith("<<"):
            skip = piece == "<<optional>>"
        elif not skip:
            out.append(piece)
    return out


def test_each_template_needs_every_mandatory_word():
    for label, all_of in licenses.TEMPLATES.items():
        for markup in all_of:
            own = lambda w: (label, len(w)) in {(x, n) for _, n, x in licenses.scan(" ".join(w).lower().encode())["places"]}  # noqa: E731, B023
            for filled in (0, 5):
                w = wording(markup, filled)
                assert own(w)
                for i, x in enumerate(w):
                    if x != "Holder":
                        assert not own([*w[:i], "changed", *w[i + 1 :]]) and not own([*w[:i], *w[i + 1 :]]), (label, x)


def test_no_template_is_missed_by_the_words_that_decide_what_is_read():
    _, rare, _ = licenses._plan()
    for a in licenses.automata():
        assert any(r in w for r in rare for w in a.mandatory())
    assert licenses.compile_template("x", "a <<optional>> b <<end>> c").mandatory() in ([b"a", b"c"], [b"c", b"a"])


def test_license_scan_of_a_long_text_and_clashing_columns(spark):
    words = ["filler"] * 60_000
    words[59_000:59_002] = ["MIT", "License"]
    rows = [(1, " ".join(words), "en", "s", 0), (1, "mit license", "en", "s", 0), (None, "mit license", None, None, None)]
    docs = samples.frame(spark, rows).withColumn("n_words", F.lit("x")).withColumn("labels", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["n_words"], r["first_word"], r["labels"]) for r in licenses.license_scan(docs).collect())
    assert got == [(0, 2, 0, "mit"), (1, 2, 0, "mit"), (1, 60_000, 59_000, "mit")]


def test_license_scan_against_plain_search(spark):
    import re

    given = ["the MIT license, the Apache\nLICENSE; mit-license", "permit license", "GNU general public license. x", None, "", "mit  license mit license"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(given)]
    got = {r["doc_id"]: r for r in licenses.license_scan(samples.frame(spark, rows)).collect()}
    for i, t in enumerate(given):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted(k for k in range(len(w)) for p in licenses.PHRASES if w[k : k + len(p.split())] == p.split())
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((places[0], places[-1]) if places else (None, None))
    assert got[0]["base_labels"] == "apache,mit"
    assert licenses.license_scan(samples.empty(spark)).count() == 0
