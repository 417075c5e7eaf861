"""Fingerprints against plain votes, edits against a plain loop, near pairs against all pairs."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import simhash, text

from . import samples


def by_hand(content):
    """Votes of one text, term by term."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (content or "").encode())
    grams = [low[i : i + 8] for i in range(max(1, len(low) - 7))] if low else []
    total = [0] * simhash.BITS
    for gram, n in Counter(grams).items():
        one = text.mix(np.frombuffer(gram, np.uint8).astype(np.uint64) + np.uint64(1))
        h = text.windows(one, len(gram)) >> np.uint64(64 - simhash.HASH_BITS)
        for part in range(2):
            x = int(text.mix(h + np.uint64((part + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
            for k in range(64):
                bit = x >> (8 * (k // 8) + 7 - k % 8) & 1
                total[part * 64 + k] += (2 * bit - 1) * math.floor(16 * math.sqrt(n))
    return int("".join("1" if v > 0 else "0" for v in total), 2).to_bytes(16, "big").hex()


TEXTS = [None, "", "a", "short", "exactly8", "Ünïcödé ABC abc", "漢字の文", "the cat sat on the mat. " * 9, " ".join(samples.words(1, 300))]


def test_votes():
    found = simhash.fingerprints(pa.array(TEXTS))
    assert [x.tobytes().hex() for x in found] == [by_hand(t) for t in TEXTS]
    assert [x.tobytes().hex() for x in simhash.fingerprints(pa.array(TEXTS[::-1]))][::-1] == [by_hand(t) for t in TEXTS]


@pytest.mark.parametrize("parts", ["1", "4"])
def test_edits_follow_the_ids(spark, parts):
    rows = [r for r in samples.documents() if r[0] != 50]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = simhash.with_edits(samples.frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    hashed = {(x["doc_id"], x["text"]): x["h"] for x in samples.frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (-math.inf if r[0] is None else r[0], -hashed[r[0], r[1]]), reverse=True)
    want = []
    for row, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = row[1] or "", after[1] or ""
        new = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        one, two, other = (int(by_hand(x), 16) for x in (t, new, u))
        want.append((row[0], len(t), hashlib.sha256(new.encode()).hexdigest(), f"{one:032x}", f"{two:032x}", 1 - (one ^ two).bit_count() / 128, 1 - (one ^ other).bit_count() / 128))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_edits_stay_near_and_other_texts_do_not(spark):
    rows = [(i, " ".join(samples.words(i, 150)), "en", "s", 0) for i in range(60)]
    found = simhash.with_edits(samples.frame(spark, rows)).collect()
    assert all(x["near_edited"] > x["near_next"] for x in found)
    assert np.mean([x["near_edited"] for x in found]) > 0.7 and abs(np.mean([x["near_next"] for x in found]) - 0.5) < 0.05


def test_a_single_document_follows_itself(spark):
    (x,) = simhash.with_edits(samples.frame(spark, [(1, "abcdef", None, None, 6)])).collect()
    assert (x["edited_sha256"], x["near_next"]) == (hashlib.sha256(b"abcdab").hexdigest(), 1.0)


def prints(r, n):
    out = []
    for _ in range(n):
        base = r.getrandbits(128)
        out.append(base)
        for _ in range(r.randint(0, 4)):
            out.append(base := base ^ sum(1 << r.randrange(128) for _ in range(r.randint(0, 5))) & (2**128 - 1))
    return [x.to_bytes(16, "big") for x in out]


@pytest.mark.parametrize(("radius", "tile"), [(1, 2048), (3, 2048), (3, 2), (8, 5)])
def test_all_pairs_within_the_radius_are_found_once(spark, monkeypatch, radius, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(radius + tile)
    given = [*prints(r, 60), *[(0).to_bytes(16, "big")] * 5, *[(1 << k).to_bytes(16, "big") for k in range(40)]]
    df = spark.createDataFrame([(x, "k") for x in given] + [(None, "k")], "print binary, key string").repartition(3)
    found = [(bytes(x["a"]), bytes(x["b"]), x["distance"]) for x in simhash.near_pairs(df, radius).collect()]
    distance = {(a, b): (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() for a, b in itertools.combinations(sorted(set(given)), 2)}
    assert sorted(found) == sorted((a, b, d) for (a, b), d in distance.items() if d <= radius)


def test_classes_and_counts(spark):
    r = random.Random(9)
    given = [(None if r.random() < 0.05 else r.randint(0, 500), x) for x in prints(r, 40) * 2]
    found = {bytes(x["print"]): (x["n_near"], x["class_id"]) for x in simhash.classes(spark.createDataFrame(given, "doc_id long, print binary")).collect()}
    every = sorted({p for _, p in given})
    near = {p: [q for q in every if (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() <= simhash.RADIUS] for p in every}
    root = {p: p for p in every}
    while any(root[p] != min(root[q] for q in near[p]) for p in every):
        root = {p: min(root[q] for q in near[p]) for p in every}
    for p in every:
        ids = [i for i, q in given if root[q] == root[p] and i is not None]
        assert found[p] == (sum(q in near[p] for _, q in given) - 1, min(ids) if ids else None)


def test_an_empty_table(spark):
    assert simhash.with_edits(samples.empty(spark)).count() == 0
    assert simhash.classes(spark.createDataFrame([], "doc_id long, print binary")).count() == 0
