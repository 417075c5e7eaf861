import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, decontaminate, filters, jaccard, substrings, text, voronoi, warc

from . import samples

BLANK = re.compile("[^\x20\x09-\x0d]+")


def shingles(t):
    w = BLANK.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(rows):
    """Component of each row, by comparing every pair."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d if d is not None else 10**9)
    return [(d, len(s), min(least[find(i)]) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for g in range(n // 10):
        base = samples.words(100 * seed + g, r.choice([6, 30, 90, 200]))
        for k in range(10):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"new{r.randrange(99)}"
            if r.random() < 0.3:
                w = w[: max(1, int(len(w) * r.uniform(0.7, 1)))]
            rows.append((1000 * g + k, " ".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize("block, common", [(2048, 200), (3, 3), (2048, 2)])
def test_jaccard_components_equal_all_pairs(spark, monkeypatch, block, common):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = near_copies(150, block + common) + [r for r in samples.documents() if r[0] is not None]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.labelled(samples.frame(spark, rows)).collect())
    assert got == sorted(grouped([(r[0], r[1]) for r in rows]))


def test_jaccard_keeps_one_of_each_group(spark):
    docs = samples.frame(spark)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    want = {d for d, n, c in grouped([(r[0], r[1]) for r in samples.documents() if r[0] is not None]) if d == c}
    assert ids == sorted([(False, d) for d in want] + [(True, 0)])
    assert jaccard.deduplicated(samples.empty(spark)).count() == 0
    assert jaccard.labelled(samples.empty(spark)).count() == 0


def test_links_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert jaccard.links(a, a[:80]) and not jaccard.links(a, a[:79])
    assert not jaccard.links(a[:0], a[:0])
    for n in range(1, 60):  # the prefix reaches far enough
        assert jaccard.prefix_size(n) == n - int(np.ceil(0.8 * n - 1e-9)) + 1


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500, 500), (-5, 7), (i, i + 1) if False else (7, 8)]
    edges += [(1000 + i, 1001 + i) for i in range(200)] + [(4000, 4001 + i) for i in range(300)] + [(600, 600)] * 3
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {(r["node"], r["root"]) for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in up}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_forest_names_the_least_node_of_each_component():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 60, 45), r.integers(0, 60, 45)
    nodes, roots = components.forest(a, b)
    up = {x: x for x in nodes.tolist()}
    for _ in range(60):
        for x, y in zip(a.tolist(), b.tolist()):
            up[x] = up[y] = min(up[x], up[y])
    assert up == dict(zip(nodes.tolist(), roots.tolist()))


def test_filter_misses_nothing(spark):
    keys = [random.Random(2).randrange(-(2**63), 2**63) for _ in range(500)]
    flags = filters.build(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"), "k", 20)
    assert filters.may_hold(flags, np.array(keys)).all()
    others = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    assert filters.may_hold(flags, others).mean() < 0.01


def repeated_windows(rows, span):
    cut = [BLANK.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + span]) for w in cut for i in range(len(w) - span + 1))
    for (d, _), w in zip(rows, cut):
        gone = set()
        for i in range(len(w) - span + 1):
            if count[tuple(w[i : i + span])] > 1:
                gone.update(range(i, i + span))
        kept = [x for i, x in enumerate(w) if i not in gone]
        yield d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def plain_factors(phrases, times):
    """Greedy factors by trying every length at every place."""
    for p, (w, n) in enumerate(zip(phrases, times)):
        i = 0
        while i < len(w):
            best = len(w) - i if n > 1 else max(
                k for k in range(len(w) - i + 1)
                if not k or any(v[j : j + k] == w[i : i + k] for q, v in enumerate(phrases) for j in range(len(v) - k + 1) if (p, i) != (q, j))
            )
            if best:
                yield p, i, best
            i += max(1, best)


@pytest.mark.parametrize("letters", [2, 5, 40])
def test_factors_are_greedy_and_longest(letters):
    r = random.Random(letters)
    phrases = [[r.randrange(letters) for _ in range(r.randint(0, 28))] for _ in range(25)]
    times = [r.choice([1, 1, 1, 2]) for _ in phrases]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in phrases])])
    got = substrings.factors(np.array([x for w in phrases for x in w], np.uint64), offs, np.array(times))
    assert list(zip(*(x.tolist() for x in got))) == list(plain_factors(phrases, times))


@pytest.mark.parametrize("hot, indexed", [(1, 20_000), (3, 2), (2048, 5)])
def test_substrings_do_not_depend_on_hot_anchors_or_block_sizes(spark, monkeypatch, hot, indexed):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "INDEXED", indexed)
    line = samples.words(60, 12)  # a common line in ever other contexts, twice in an equal one
    rows = [(i, " ".join(samples.words(400 + i, 15) + line + samples.words(500 + i % 25, 15)), None, None, 0) for i in range(30)]
    rows += samples.documents() + [(900, "x " * 90, None, None, 0)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(samples.frame(spark, rows), 20).collect())
    assert got == sorted((d or 0, a, b, c) for d, a, b, c in repeated_windows([(r[0], r[1]) for r in rows], 20))


@pytest.mark.parametrize("span", [35, 9])
def test_substrings_equal_a_plain_count(spark, span):
    rows = samples.documents() + near_copies(60, 8) + [(900, "x " * 90, None, None, 0), (901, "a b " * 40, None, None, 0)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(samples.frame(spark, rows), span).collect())
    assert got == sorted((d or 0, a, b, c) for d, a, b, c in repeated_windows([(r[0], r[1]) for r in rows], span))


def test_substrings_cut_texts_and_keep_columns(spark):
    docs = samples.frame(spark)
    got = substrings.removed(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[10] == "" and by[40] is None and by[42] == " \n\t " and by[33] == "a b c d"
    assert substrings.removed(samples.empty(spark)).count() == 0
    assert substrings.spans_of(np.array([0, 1, 1, 0, 1], bool)) == [(1, 3), (4, 5)]


def test_least_of_windows():
    x = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for k in (1, 2, 7, 28, 64):
        assert (substrings.least(x, k) == np.array([x[i : i + k].min() for i in range(len(x) - k + 1)])).all()


def edited(w, n, r, vocabulary):
    w = list(w)
    for _ in range(n):
        p = r.randrange(len(w))
        kind = r.choice("sid")
        if kind == "s":
            w[p] = r.choice(vocabulary)
        elif kind == "i":
            w.insert(p, r.choice(vocabulary))
        elif len(w) > 3:
            del w[p]
    return w


def test_leaks_reach_the_recall_of_all_windows(spark):
    r, vocabulary = random.Random(4), samples.words(50, 300)
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(10, 60)))) for i in range(30)] + [(90, None), (91, " , "), (92, "one")]
    rows = []
    for i, t in items[:30]:
        for n in (0, 1, 3, 6):
            w = r.choices(vocabulary, k=20) + edited(t.split(), n, r, vocabulary) + r.choices(vocabulary, k=20)
            rows.append((10 * i + n, " ".join(w).upper() if n == 0 else " ".join(w), None, None, 0))
    rows += [(9000, None, None, None, 0), (9001, "", None, None, 0), (9002, items[0][1], None, None, 0), (9003, " ".join(items[1][1].split()[:-1]), None, None, 0)]
    found = decontaminate.Items.of([i for i, _ in items], [t for _, t in items])
    # Every window of every document against every item, by edit distance alone.
    want = set()
    cut = [[x.encode() for x in re.findall(r"[^\W_]+", (t or "").lower())] for _, t, *_ in rows]
    for (d, *_), w in zip(rows, cut):
        for i, t in items:
            v = [x.encode() for x in re.findall(r"[^\W_]+", (t or "").lower())]
            if v and w and min(distance(v, w[s : s + len(v)]) for s in range(max(1, len(w) - len(v) + 1))) <= int(len(v) * 0.2 + 1e-9):
                want.add((d, i))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(samples.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {(10 * i, i) for i in range(30)} <= got and (9002, 0) in got
    kept = decontaminate.without_leaks(samples.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {x[0] for x in rows} - {d for d, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(samples.frame(spark), none).count() == 0
    assert decontaminate.without_leaks(samples.empty(spark), none).count() == 0
    assert len(found.ids) == 31


def test_leaks_at_the_limit_whatever_the_length():
    r = random.Random(21)
    vocabulary = samples.words(22, 4000)
    items = [r.sample(vocabulary, n) for n in (59, 100, 200, 400) for _ in range(6)]
    docs, want = [], []
    for i, w in enumerate(items):
        limit, w = len(w) // 5, list(w)
        for p in r.sample(range(len(w)), limit):
            w[p] = f"other{r.randrange(10**6)}"
        docs.append(" ".join([*r.sample(vocabulary, 30), *w, *r.sample(vocabulary, 30)]))
        want.append((i, i, 30, limit))
        w[w.index(next(x for x in w if not x.startswith("other")))] = "onemore"  # past the limit
        docs.append(" ".join(["z"] * 30 + w + ["z"] * 30))
    found = decontaminate.Items.of(list(range(len(items))), [" ".join(w) for w in items])
    got = []
    for lo, _, buf, offs in text.doc_slices(pa.array(docs)):
        d, k, s, e = decontaminate.leaks_in(*decontaminate._words(buf, offs), found)
        got += zip((d + lo).tolist(), k.tolist(), s.tolist(), e.tolist())
    assert sorted(got) == [(2 * d, i, s, e) for d, i, s, e in want]


@pytest.mark.parametrize("cells", [2_000_000, 300])
def test_leaks_equal_all_windows(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    r, vocabulary = random.Random(31), samples.words(32, 40)
    items = [r.choices(vocabulary, k=r.randint(1, 40)) for _ in range(25)]
    docs = [r.choices(vocabulary, k=r.randint(0, 15)) + edited(w, n, r, vocabulary) + r.choices(vocabulary, k=r.randint(0, 15)) for w in items for n in (0, len(w) // 10, len(w) // 5, len(w) // 4)]
    want = []
    for d, w in enumerate(docs):
        for i, v in enumerate(items):
            e, s = min((distance(v, w[s : s + len(v)]), s) for s in range(max(1, len(w) - len(v) + 1)))
            if w and e <= int(len(v) * 0.2 + 1e-9):
                want.append((d, i, s, e))
    found = decontaminate.Items.of(list(range(len(items))), [" ".join(w) for w in items])
    (_, _, buf, offs), = text.doc_slices(pa.array([" ".join(w) for w in docs]))
    assert sorted(zip(*(x.tolist() for x in decontaminate.leaks_in(*decontaminate._words(buf, offs), found)))) == want


@pytest.mark.parametrize("size", [20, 40, 80, 160, 240, 400])
@pytest.mark.parametrize("even", [False, True])
def test_recall_of_the_search_at_the_limit_of_edits(size, even):
    r = random.Random(size)
    items, docs = [[r.randrange(10**9) for _ in range(size)] for _ in range(60)], []
    for w in items:
        n, w = size // 5, list(w)
        kinds = r.sample("s" * (n - n // 4 * 2) + "id" * (n // 4), n)
        places = [i * size // n + size // n // 2 for i in range(n)] if even else r.sample(range(size), n)
        for p in sorted(places, reverse=True):
            kind = kinds.pop()
            w[p : p + 1] = [r.randrange(10**9)] if kind == "s" else [w[p], r.randrange(10**9)] if kind == "i" else []
        docs.append([r.randrange(10**9) for _ in range(15)] + w + [r.randrange(10**9) for _ in range(15)])
    found = decontaminate.Items.of(list(range(60)), [" ".join(map(str, w)) for w in items])
    want, got = set(), set()
    for lo, _, buf, offs in text.doc_slices(pa.array([" ".join(map(str, w)) for w in docs])):
        d, k, _, e = decontaminate.leaks_in(*decontaminate._words(buf, offs), found)
        got |= set(zip((d + lo).tolist(), k.tolist(), e.tolist()))
    # All windows of a document against its own item; the others share no word with it.
    for i, (w, v) in enumerate(zip(docs, items)):
        rows = np.array([w[s : s + size] for s in range(max(1, len(w) - size + 1))], np.uint64)
        e = decontaminate.edit_distance(rows, np.full(len(rows), rows.shape[1]), np.repeat(np.array([v], np.uint64), len(rows), 0), np.full(len(rows), size)).min()
        if e <= size // 5:
            want.add((i, i, int(e)))
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    assert len(want) >= 20 and len(got & want) >= 0.95 * len(want)


def test_items_that_share_a_phrase_stay_within_memory():
    import tracemalloc

    r, phrase = random.Random(3), "which of the following statements about the passage is true".split()
    items = [phrase + [f"w{r.randrange(10**6)}" for _ in range(r.randint(10, 40))] for _ in range(600)]
    repeated = (" ".join(phrase) + " ") * 1100
    (_, _, buf, offs), = text.doc_slices(pa.array([repeated + " ".join(items[7])]))
    found = decontaminate.Items.of(list(range(len(items))), [" ".join(w) for w in items])
    tracemalloc.start()
    d, k, s, e = decontaminate.leaks_in(*decontaminate._words(buf, offs), found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (7, len(phrase) * 1100, 0) in set(zip(k.tolist(), s.tolist(), e.tolist()))
    assert set(d.tolist()) == {0} and peak < 250 << 20


def test_repeated_items_and_documents_each_give_rows(spark):
    words = samples.words(61, 40)
    docs = samples.frame(spark, [(1, " ".join(words), None, None, 0)] * 2 + [(2, "else", None, None, 0)])
    items = spark.createDataFrame([(5, " ".join(words[3:20]))] * 3 + [(6, " ".join(words[3:20]))], "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["start_word"], x["edits"]) for x in decontaminate.leaks(docs, items).collect())
    assert got == [(1, 5, 3, 0)] * 6 + [(1, 6, 3, 0)] * 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_distances_of_pairs():
    r = random.Random(7)
    pairs = [([r.randrange(1, 5) for _ in range(r.randint(1, 12))], [r.randrange(1, 5) for _ in range(r.randint(1, 12))]) for _ in range(60)]
    pad = lambda x: np.array([v + [0] * (12 - len(v)) for v in x], np.uint64)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    got = decontaminate.edit_distance(pad(a), np.array([len(x) for x in a]), pad(b), np.array([len(x) for x in b]))
    assert got.tolist() == [distance(x, y) for x, y in pairs]


def test_walk_maps_equal_rows_alike():
    rows = np.random.default_rng(1).integers(1, 2**63, (4, 20), dtype=np.uint64)
    rows[1] = rows[0]
    out = decontaminate.walk(rows, 1)
    assert (out[0] == out[1]).all() and (out[0] != out[2]).mean() > 0.5


def vectors(n, seed, d=8):
    g = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in g.normal(0, 0.3, d)], 0) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 16])
def test_voronoi_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(voronoi, "BLOCK", block)
    rows = vectors(300, 5) + [(1000 + i, vectors(1, 9)[0][1], 0) for i in range(40)] + [(400, None, 0), (401, [1.0, float("nan")] * 4, 0), (402, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), (500, [0.5, 0.25], 0), (600, [], 0), (100, vectors(1, 11)[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in voronoi.topk_join(df, F.col("vec_id") % 100 == 0).collect())
    usable = [(i, tuple(int(np.floor(1024 * np.float64(np.float32(x)))) for x in v)) for i, v, _ in rows if i is not None and v and all(np.isfinite(v))]
    want = []
    for q in sorted({i for i, _ in usable if i % 100 == 0}):
        v = min(x for i, x in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in usable if i != q and len(x) == len(v))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert voronoi.topk_join(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_voronoi_with_more_lengths_than_have_pivots(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "LENGTHS", 2)
    monkeypatch.setattr(voronoi, "BLOCK", 7)
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-9, 9, 1 + i % 5) / 8], 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in voronoi.topk_join(df, F.col("vec_id") % 10 == 0).collect())
    want = []
    for q, v, _ in rows[::10]:
        best = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, x)), i) for i, x, _ in rows if i != q and len(x) == len(v))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("copies, spread", [(1, False), (2, False), (11, True), (20, False)])
def test_voronoi_with_a_query_id_that_is_repeated(spark, copies, spread):
    rows = vectors(20, 3)
    large = [9.0 * x for x in vectors(1, 12)[0][1]]
    rows = [(i + 1, v, 0) for i, v, _ in rows] + [(100, [float(np.float32(x + (c / 8 if spread else 0))) for x in large], 0) for c in range(copies)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in voronoi.topk_join(df, F.col("vec_id") % 100 == 0).collect())
    whole = [(i, tuple(int(np.floor(1024 * np.float64(np.float32(x)))) for x in v)) for i, v, _ in rows]
    v = min(x for i, x in whole if i == 100)
    best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in whole if i != 100)[:10]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_warc_round_trip(spark, monkeypatch):
    from palimpsest.llm import runtime

    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    big, other = "<p>é" * 500, "y" * 999
    rows = [(1, "http://a/ü x", big), (2, "http://b", big), (7, None, big), (7, None, big), (3, "http://c", other), (4, "http://d", other), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", big), (8, "http://h", "z\r\n\r\nWARC/1.1\r\n" * 90), (9, "http://i", "w" * 2_500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    folder = runtime.scratch(spark, "w")
    whole = warc.write_archives(warc.classified(df), f"{folder}/a")
    members = warc.normalise(whole, f"{folder}/b")
    got = warc.read_records(members).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (page, _, html) in zip(sorted(got, key=lambda r: key((r["page_id"],))), sorted(rows, key=key)):
        raw = (html or "").encode()
        revisit = html == big and page != 7
        assert (r["page_id"], r["payload_bytes"], r["payload_digest"]) == (page, len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else bytearray(raw))
    assert warc.read_records(warc.normalise(warc.write_archives(warc.classified(df.limit(0)), f"{folder}/c"), f"{folder}/d")).count() == 0


def test_gzip_streams_of_several_members_and_broken_ones():
    import io
    import zlib

    pack = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    rec = [warc.page_record(i, f"http://x/{i}", b"p" * (i * 700), i * 700, "00" * 20, None, False).dump() for i in range(5)]
    raw = pack(b"".join(rec[:3])) + pack(b"".join(rec[3:]))
    assert [r["X-Page-ID"] for r in warc.records(warc.inflated(io.BytesIO(raw)))] == list("01234")
    with pytest.raises(EOFError):
        list(warc.records(warc.inflated(io.BytesIO(raw[:-30]))))


def test_records_without_a_length_are_damage():
    with pytest.raises(ValueError, match="without a length"):
        list(warc.records(iter([b"WARC/1.1\r\nWARC-Type: response\r\n\r\nxx\r\n\r\n"])))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.records(iter([b"hello\r\n\r\n"])))


def test_phrase_hashes_agree_for_equal_windows():
    w = samples.words(3, 80)
    (_, _, buf, offs), = text.doc_slices(pa.array([" ".join(w), " ".join(["x", "y", *w[10:70]])]))
    p = substrings.phrases_of(buf, offs, 20)
    seen = {}
    for doc, pos, size, at in zip(p["doc"], p["pos"], p["size"], p["at"]):
        for k in range(size):
            seen[doc, pos + k] = p["hash"][at + k]
    assert all(seen[0, 10 + i] == seen[1, 2 + i] for i in range(41))
