"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius.

A text's terms are the 8-byte sequences of its UTF-8 bytes, A-Z lower-cased (a shorter
text is one term); a term that occurs n times weighs floor(16 sqrt(n)). Each bit of a
fingerprint is the sign of the weighted votes of its terms' hashes. Weights are integers,
so equal texts have equal fingerprints wherever they are made.

Fingerprints within ``radius`` bits of each other agree in two of ``radius + 2`` blocks of
bits at least. For each pair of blocks there is a table keyed by them (that is, by the
first bits of the permuted fingerprint); equal keys are compared exactly. Copies are one
fingerprint before they are sent to the tables, keys that occur once go no further, and
a key of many fingerprints is split into tiles. A pair is told by the first table that
has it.

Rows: null texts count as empty; a text without bytes has a fingerprint of zeros. Null and
repeated ids are rows like others. An empty table gives an empty result, other columns
play no part. A task needs some 60 bytes for each byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import components, runtime, text

BITS, GRAM, RADIUS = 128, 8, 3
HASH_BITS = 44
#: Fingerprints of a key that are compared at once.
TILE = 2048
U = np.uint64
_SIGNS = (((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1) * 2 - 1).astype(np.float64)


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of every different term of every document."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    one = text.mix(text.LOWER[buf].astype(U) + U(1))
    grams = text.windows(one, GRAM)
    inside = np.arange(len(grams)) + GRAM <= offs[1:][doc[: len(grams)]]
    held, at = [grams[inside]], [doc[: len(grams)][inside]]
    for i in np.flatnonzero((np.diff(offs) > 0) & (np.diff(offs) < GRAM)):
        held.append(text.windows(one[offs[i] : offs[i + 1]], int(offs[i + 1] - offs[i])))
        at.append(np.array([i]))
    keys = (np.concatenate(at).astype(U) << U(HASH_BITS)) | (np.concatenate(held) >> U(64 - HASH_BITS))
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    weight = np.floor(16 * np.sqrt(np.diff(np.append(first, len(keys)))))
    keys = keys[first]
    return (keys >> U(HASH_BITS)).astype(np.int64), keys & U((1 << HASH_BITS) - 1), weight


def votes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Signed sums for each bit of each document."""
    n = len(offs) - 1
    doc, h, weight = _terms(buf, offs)
    out = np.empty((n, BITS))
    for part in range(BITS // 64):
        x = text.mix(h + U((part + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        for b in range(8):
            cell = (doc << 8) | (x >> U(8 * b)).astype(np.uint8)
            lo = part * 64 + 8 * b
            out[:, lo : lo + 8] = np.bincount(cell, weights=weight, minlength=n << 8).reshape(n, 256) @ _SIGNS
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """One row of ``BITS // 8`` bytes for each text."""
    out = np.zeros((len(column), BITS // 8), np.uint8)
    for lo, hi, buf, offs in text.doc_slices(column):
        out[lo:hi] = np.packbits(votes(buf, offs) > 0, axis=1)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(prints: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in prints]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: The first and the last document of a range, whose neighbours are another task's.
EDGE = pa.schema([("piece", pa.int64()), ("last", pa.bool_()), ("edge_id", pa.int64()), ("edge_text", pa.string())])
KINDS = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in schema)


def edited(doc: str, follower: str) -> str:
    """The text with its last third replaced by as many code points of the start of another, or all of that."""
    third = len(doc) // 3
    return doc[: len(doc) - third] + follower[:third]


def compared(ids: list[int | None], docs: list[str], prints: np.ndarray, followers: list[str], following: np.ndarray) -> pa.RecordBatch:
    """Results of documents whose followers are known."""
    new = [edited(d, f) for d, f in zip(docs, followers, strict=True)]
    changed = fingerprints(pa.array(new, pa.string()))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in new]
    return runtime.out_batch(RESULT, doc_id=ids, n_chars=[len(d) for d in docs], edited_sha256=sha, fingerprint=_hex(prints), edited_fingerprint=_hex(changed), near_edited=alike(prints, changed), near_next=alike(prints, following))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one range: each with the next one; the first and the last as edges."""
    schema, piece = pa.schema([*RESULT, *EDGE]), TaskContext.get().partitionId()

    def edge(last: bool, doc: int | None, content: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"piece": piece, "last": last, "edge_id": doc, "edge_text": content}], schema)

    held = None
    for batch in batches:
        for lo, hi, _, _ in text.doc_slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            ids, docs, prints = part["doc_id"].to_pylist(), [x or "" for x in part["text"].to_pylist()], fingerprints(part["text"])
            if held is None:
                yield edge(False, ids[0], docs[0])
            else:
                ids, docs, prints = [held[0], *ids], [held[1], *docs], np.concatenate([held[2], prints])
            if len(ids) > 1:
                done = compared(ids[:-1], docs[:-1], prints[:-1], docs[1:], prints[1:])
                yield pa.RecordBatch.from_arrays([*done.columns, *[pa.nulls(len(done), f.type) for f in EDGE]], schema=schema)
            held = ids[-1], docs[-1], prints[-1:]
    if held is not None:
        yield edge(True, held[0], held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, followers = [[x or "" for x in batch[c].to_pylist()] for c in ("text", "follower")]
        yield compared(batch["doc_id"].to_pylist(), docs, fingerprints(batch["text"]), followers, fingerprints(batch["follower"]))


def with_edits(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    A document is edited with the text of the next one by descending id (null ids come
    last, rows of one id in the order of their texts' hashes); the first follows the last.
    """
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    given = documents.select(F.col("doc_id").cast("long"), "text").withColumn("own", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("own")]
    dealt = given.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("own")
    found = runtime.written(dealt.mapInArrow(runtime.lean(_neighbours), f"{_ddl(RESULT)}, {_ddl(EDGE)}"), "simhash")
    edges = runtime.reread(found).where("piece IS NOT NULL")
    # One number for each range, whatever the input's size.
    pieces = edges.where("last").select("piece")
    ring = W.orderBy("piece")
    after = pieces.select("piece", F.coalesce(F.lead("piece").over(ring), F.min("piece").over(W.partitionBy())).alias("then"))
    first = runtime.reread(found).where("NOT last").select(F.col("piece").alias("then"), F.col("edge_text").alias("follower"))
    met = edges.where("last").join(after, "piece").join(first, "then").select(F.col("edge_id").alias("doc_id"), F.col("edge_text").alias("text"), "follower")
    return found.where("piece IS NULL").select(*RESULT.names).unionByName(met.mapInArrow(runtime.lean(_across), _ddl(RESULT)))


def blocks(radius: int) -> list[tuple[int, int]]:
    """First and end bit of each of ``radius + 2`` blocks."""
    cuts = [BITS * i // (radius + 2) for i in range(radius + 3)]
    return list(zip(cuts, cuts[1:], strict=False))


def tables(radius: int) -> list[tuple[int, int]]:
    return list(combinations(range(radius + 2), 2))


def _masks(radius: int) -> np.ndarray:
    """The bits of each block, as bytes."""
    out = np.zeros((radius + 2, BITS), np.uint8)
    for i, (a, b) in enumerate(blocks(radius)):
        out[i, a:b] = 1
    return np.packbits(out, axis=1)


def _keyed(radius: int):
    """Each fingerprint to a key of each table."""
    masks, pairs = _masks(radius), tables(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch["print"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
            for t, (i, j) in enumerate(pairs):
                two = np.ascontiguousarray(prints & (masks[i] | masks[j])).view(U)
                key = text.mix(text.mix(two[:, 0] + U(t)) ^ two[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), t, np.int32)), batch["print"]], names=["key", "t", "print"])

    return run


def _within(radius: int):
    masks, pairs = _masks(radius), tables(radius)
    number = {p: t for t, p in enumerate(pairs)}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of two parts of a key's fingerprints (or of one part) that are near, first found here."""
        out: list[tuple[bytes, bytes, int]] = []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(s["print"].to_pylist()), np.uint8).reshape(-1, BITS // 8) for s in (left, right))
            t, same = left["t"][0].as_py(), left["i"][0].as_py() == left["j"][0].as_py()
            xs, ys = np.ascontiguousarray(x).view(U), np.ascontiguousarray(y).view(U)
            for lo in range(0, len(x), 256):
                apart = sum(np.bitwise_count(xs[lo : lo + 256, None, k] ^ ys[None, :, k]).astype(np.int16) for k in range(BITS // 64))
                for a, b in zip(*np.nonzero(apart <= radius), strict=True):
                    p, q = x[lo + a].tobytes(), y[b].tobytes()
                    if p == q or (same and p > q):
                        continue
                    differ = x[lo + a] ^ y[b]
                    whole = [k for k in range(radius + 2) if not (differ & masks[k]).any()]
                    if number[whole[0], whole[1]] == t:
                        out.append((min(p, q), max(p, q), int(apart[a, b])))
        return pa.table({"a": pa.array([p for p, _, _ in out], pa.binary()), "b": pa.array([q for _, q, _ in out], pa.binary()), "distance": pa.array([d for _, _, d in out], pa.int32())})

    return run


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b, distance``: every two different fingerprints of a column ``print`` (binary) within the radius, a < b."""
    if not 0 < radius < BITS // 2:
        raise ValueError(f"a radius of {radius} bits has no tables")
    spark = prints.sparkSession
    runtime.arrow_limits(spark)
    every = prints.select("print").where("print IS NOT NULL").distinct()
    keyed = runtime.written(every.mapInArrow(runtime.lean(_keyed(radius)), "key long, t int, print binary"), "simhash-keys")
    sizes = keyed.groupBy("key", "t").agg(F.count("*").alias("n")).where("n > 1").select("key", "t", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    shared = runtime.reread(keyed).join(sizes, ["key", "t"]).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    shared = runtime.written(shared, "simhash-shared")
    left = shared.select("key", "t", "print", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"))
    right = runtime.reread(shared).select("key", "t", "print", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    tile = ["key", "t", "i", "j"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_within(radius), "a binary, b binary, distance int")


def classes(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``print, n_near, class_id`` of every fingerprint of rows ``doc_id, print``.

    ``n_near`` counts the documents within the radius of one with this fingerprint,
    itself left out; ``class_id`` is the least id that links lead to.
    """
    prints = runtime.written(documents.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-prints")
    pairs = runtime.written(near_pairs(prints, radius), "simhash-pairs")
    both = pairs.select("a", "b").unionByName(runtime.reread(pairs).select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(prints.select(F.col("print").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    # 64-bit names of fingerprints: two of n share one with a chance of n * n / 2 ** 65.
    edges = runtime.reread(pairs).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    roots = components.connected(edges, sparse=True)
    named = runtime.reread(prints).withColumn("node", F.xxhash64("print"))
    rooted = runtime.written(named.join(roots, "node", "left").select("print", "n", "least", F.coalesce("root", "node").alias("root")), "simhash-roots")
    top = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = runtime.reread(rooted).join(top, "root").join(counted.withColumnRenamed("a", "print"), "print", "left")
    return linked.select("print", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), "class_id")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runtime.written(with_edits(runtime.table(spark, sf_dir, "documents")), "simhash-documents")
    near = classes(found.select("doc_id", F.unhex("fingerprint").alias("print"))).withColumn("fingerprint", F.lower(F.hex("print"))).drop("print")
    return runtime.reread(found).join(near, "fingerprint").select(*RESULT.names, "n_near", "class_id")


QUERIES = {"op13_fingerprints": op13_fingerprints}
ORACLE_SQL: dict[str, str] = {}
