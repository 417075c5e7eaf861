"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams. Each is scaled by the log
of the ratio in which toxic and other documents hold it; a logistic regression
with an L2 penalty is fitted on the scaled features.

Rows: a null or empty text has no features and gets the score of the intercept.
A document with several labels teaches each of them. Without labels of both
kinds every score is the share of toxic labels, within 1e-6 of 0 and 1 (1e-6 if
there are none). Labels that repeat count once; documents that repeat each teach.
Ids, languages and sources are never features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, text
from .langid import held_out

#: Orders of the n-grams, and bits of their hash.
ORDERS, BITS = (4, 5, 6), 20
#: Bound of the fitted sample: documents of each label, chosen by a hash of their id, and characters of all.
MAX_DOCS, MAX_CHARS = 3000, 24 << 20
#: N-grams in fewer fitted documents, or with a flatter ratio, carry no weight.
MIN_DOCS, MIN_RATIO = 5, 0.7
SMOOTHING, PENALTY, ROUNDS = 1.0, 1e-3, 300
#: Documents of a step of the fit.
FITTED = 500
THRESHOLD = 0.7


@dataclass
class ToxicModel:
    """A weight for each bucket (ratio times coefficient), and the intercept."""

    weights: np.ndarray
    bias: float


def present(codes: np.ndarray) -> np.ndarray:
    """Distinct buckets of one document's n-grams."""
    if len(codes) < min(ORDERS):
        return np.empty(0, np.int64)
    return np.unique(np.concatenate([b[: max(0, len(codes) - n + 1)] for n, b in text.gram_buckets(codes, ORDERS, BITS)]))


def packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets in two bytes each, after the numbers of those in each range of 2**16."""
    return np.bincount(buckets >> 16, minlength=1 << (BITS - 16)).astype("<u4").tobytes() + buckets.astype("<u2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The buckets again."""
    n = 1 << (BITS - 16)
    return np.repeat(np.arange(n) << 16, np.frombuffer(raw, "<u4", n)) | np.frombuffer(raw, "<u2", offset=4 * n)


class Packed:
    """The buckets of several texts, unpacked one text at a time."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw = raw

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(unpacked, self.raw)


def fit(texts: list[str | None], toxic: np.ndarray, prior: float) -> ToxicModel:
    """Fit on texts in memory; ``prior`` is the share of toxic documents outside the sample."""
    return fit_features(Packed([packed(present(text.folded([t])[0])) for t in texts]), toxic, prior)


def fit_features(features: Iterable[np.ndarray], toxic: np.ndarray, prior: float) -> ToxicModel:
    """The same for the distinct buckets of each text."""
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return ToxicModel(np.zeros(1 << BITS, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    df = np.zeros((2, 1 << BITS), np.int32)
    for f, y in zip(features, toxic, strict=True):
        df[int(y), f] += 1
    n0, n1 = int((~toxic).sum()), int(toxic.sum())
    ratio = np.log((df[1] + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((df[0] + SMOOTHING) / (n0 + 2 * SMOOTHING))
    kept = (df.sum(0) >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    del df
    ids = np.flatnonzero(kept)
    column = np.full(1 << BITS, -1, np.int32)
    column[ids] = np.arange(len(ids), dtype=np.int32)
    rows = [c[c >= 0] for f in features for c in (column[f],)]
    size = np.array([len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int32)])
    del rows
    offs = np.concatenate([[0], np.cumsum(size)])
    scale = ratio[ids]
    y = toxic.astype(float)
    share = np.where(toxic, prior / n1, (1 - prior) / n0)  # the sample's documents weigh as they occur
    w, b, sw, sb = np.zeros(len(ids)), 0.0, np.full(len(ids), 1e-8), 1e-8
    for _ in range(ROUNDS):  # full-batch AdaGrad, some documents at a time so that little is held
        gw, gb = PENALTY * w / max(1, len(ids)) ** 0.5, 0.0
        ws = w * scale
        for lo in range(0, len(size), FITTED):
            hi = min(len(size), lo + FITTED)
            c = col[offs[lo] : offs[hi]]
            row = np.repeat(np.arange(hi - lo), size[lo:hi])
            z = np.bincount(row, ws[c], hi - lo) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi]) * share[lo:hi]
            gw += np.bincount(c, g[row] * scale[c], len(ids))
            gb += g.sum()
        sw += gw * gw
        sb += gb * gb
        w -= 0.1 * gw / np.sqrt(sw)
        b -= 0.1 * gb / np.sqrt(sb)
    weights = np.zeros(1 << BITS, np.float32)
    weights[ids] = w * ratio[ids]
    return ToxicModel(weights, float(b))


def train(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ToxicModel:
    """Fit on the documents that ``labels`` marks.

    The sample is bounded: about ``max_docs`` documents of each label and
    ``max_chars`` characters, by a hash of the id, weighted back to the shares of
    all labels.
    """
    marks = runtime.need(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").distinct()
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, F.lit(min(1.0, max_docs / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, max_docs / max(1, sizes.get(0, 0))))) * 1_000_000
    # The sample's ids are bounded by max_docs, so they may be broadcast, and no text is shuffled.
    # Tasks cut the texts into n-grams; one task fits on those; only the weights reach the driver.
    sample = runtime.written(runtime.need(documents, "doc_id", "text").join(F.broadcast(marks.where(chosen)), "doc_id").select("doc_id", "toxic", "text"), "labelled-sample")
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < 1_000_000 * max_chars / chars)
    prior = sizes.get(1, 0) / max(1, total)
    runtime.arrow_limits(documents.sparkSession, 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [packed(present(text.folded([t])[0])) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(grams, pa.binary())], names=["doc_id", "toxic", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), b["grams"].to_pylist(), strict=True)]
        rows.sort()
        model = fit_features(Packed([r[2] for r in rows]), np.array([r[1] for r in rows]), prior)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([at.astype("<i4").tobytes()]), pa.array([model.weights[at].astype("<f4").tobytes()])], names=["bias", "at", "weights"])

    dealt = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").repartition(documents.sparkSession.sparkContext.defaultParallelism)
    grams = dealt.mapInArrow(runtime.lean(cut), "doc_id long, toxic int, grams binary")
    found = grams.repartition(1).mapInArrow(runtime.lean(run), "bias double, at binary, weights binary").collect()
    if not found:  # an empty sample may have no task
        return fit_features([], np.empty(0), prior)
    bias, at, weights = found[0]
    out = ToxicModel(np.zeros(1 << BITS, np.float32), bias)
    out.weights[np.frombuffer(at, "<i4")] = np.frombuffer(weights, "<f4")
    return out


SCHEMA = "doc_id long, score double"


def scores(model: ToxicModel, texts: list[str | None]) -> np.ndarray:
    """The probability that each text is toxic.

    Most n-grams carry no weight; only the others are sorted to find those of each
    text once.
    """
    codes, offs = text.folded(texts)
    end = np.repeat(offs[1:], np.diff(offs))
    held = []
    for n, buckets in text.gram_buckets(codes, ORDERS, BITS):
        at = np.flatnonzero((model.weights[buckets] != 0) & (np.arange(len(codes)) + n <= end))
        held.append((np.searchsorted(offs, at, "right") - 1) << BITS | buckets[at])
    once = np.unique(np.concatenate(held))
    z = np.bincount(once >> BITS, model.weights[once & ((1 << BITS) - 1)], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score`` of every whole text, in one narrow pass."""
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, _ in text.doc_slices(b["text"], text.SLICE_BYTES // 2):
                yield runtime.out_batch(schema, doc_id=b["doc_id"].slice(lo, hi - lo), score=scores(shared.value, b["text"].slice(lo, hi - lo).to_pylist()))

    return runtime.need(documents, "doc_id", "text").mapInArrow(runtime.lean(run), SCHEMA)


def trained(spark: SparkSession, sf_dir: str) -> ToxicModel:
    """The model of the tables' labels, without those held out."""
    labels = runtime.table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    return train(runtime.table(spark, sf_dir, "documents"), labels)


def clean(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows, all columns kept, whose text scores below the threshold."""
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, _ in text.doc_slices(b["text"], text.SLICE_BYTES // 2):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(scores(shared.value, part["text"].to_pylist()) < THRESHOLD))

    return documents.mapInArrow(runtime.lean(run), documents.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    found = score(docs, trained(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
