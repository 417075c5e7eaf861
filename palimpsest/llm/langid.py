"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text's n-grams are those of its letters, lower-cased, with other characters
between words; none reaches beyond the text's end, so a score depends on the text
alone. The score is the posterior probability of the predicted language.

Rows: null or letterless texts get ``und`` with score 0. Documents without a
language teach nothing. With no labelled document at all every text is ``und``.
Equal posteriors go to the language that sorts first. Any number of languages is
scored, ``MAX_LANGS`` of them a pass. Only ``doc_id``, ``text`` and, for
training, ``lang`` are read; neither of the ids is a feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, text

#: Orders of the n-grams, and bits of their hash.
ORDERS, BITS = (1, 2, 3), 16
#: Bound of the fitted sample: documents of each language, chosen by a hash of their id.
MAX_DOCS = 4000
#: Languages of a broadcast matrix, 0.5 MB each; more languages take further passes over the texts.
MAX_LANGS = 64
SMOOTHING = 0.5


@dataclass
class LangModel:
    """Log-probabilities of each bucket by language (0 for the one beyond), the languages in order, and the logs of their shares."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray


def _packed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, _, _ in text.doc_slices(column, text.SLICE_BYTES // 2):
        yield lo, hi, *text.folded(column.slice(lo, hi - lo).to_pylist())


def _grams(codes: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the n-grams' buckets; those that would pass their text's end are in a bucket of their own, the last."""
    end = np.repeat(offs[1:], np.diff(offs))
    for n, buckets in text.gram_buckets(codes, ORDERS, BITS):
        yield np.where(np.arange(len(codes)) + n <= end, buckets, 1 << BITS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        for lo, hi, codes, offs in _packed(b["text"]):
            names = b["lang"].slice(lo, hi - lo).to_pylist()
            all_of = list(_grams(codes, offs))
            for i, name in enumerate(names):
                into = counts.setdefault(name, np.zeros(1 << BITS, np.int64))
                docs[name] = docs.get(name, 0) + 1
                own = slice(offs[i], offs[i + 1])
                for buckets in all_of:
                    into += np.bincount(buckets[own], minlength=(1 << BITS) + 1)[:-1]
    for name, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(c[at], docs[name]), pa.int64())], names=["lang", "bucket", "n"])


def models(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Iterator[LangModel]:
    """Fit on ``doc_id``, ``text`` and non-null ``lang``: a model for each ``MAX_LANGS`` languages or so.

    The sample is bounded: about ``max_docs`` documents of each language, by a
    hash of the id. Counts are made on the executors and summed there; what
    reaches the driver at a time is one model, a fixed size.
    """
    runtime.arrow_limits(labelled.sparkSession)
    rows = runtime.need(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = runtime.written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n, total = sizes.agg(F.count("*"), F.sum("n")).first()
    parts = -(-n // MAX_LANGS)
    for k in range(parts):
        part = F.pmod(F.xxhash64("lang"), F.lit(parts)) == k
        prior = {r["lang"]: r["n"] for r in sizes.where(part).collect()}
        if not prior:
            continue
        rate = F.create_map(*[F.lit(x) for name, n in prior.items() for x in (name, min(1.0, max_docs / n))])
        chosen = rows.where(part).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
        sums = chosen.drop("doc_id").mapInArrow(runtime.lean(_counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        own = dict(list(sums.groupby("lang")))
        langs = sorted(prior)
        counts = np.full((len(langs), 1 << BITS), SMOOTHING)
        for i, name in enumerate(langs):
            if name in own:  # else the sample has none of its documents
                grams = own[name][own[name]["bucket"] >= 0]
                counts[i, grams["bucket"].to_numpy()] += grams["n"].to_numpy()
        yield LangModel(langs, np.pad(np.log(counts / counts.sum(1, keepdims=True)), ((0, 0), (0, 1))), np.log(np.array([prior[x] for x in langs]) / total))


def log_scores(model: LangModel, texts: list[str | None]) -> np.ndarray:
    """Rows of log-probabilities of a text and each language; NaN for texts without a letter."""
    codes, offs = text.folded(texts)
    total = np.zeros((len(texts), len(model.langs)))
    for buckets in _grams(codes, offs):
        for k in range(len(model.langs)):
            total[:, k] += np.add.reduceat(model.logp[k][buckets], offs[:-1])
    total += model.prior
    total[np.add.reduceat((codes != 0).astype(np.int64), offs[:-1]) == 0] = np.nan
    return total


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(documents: DataFrame, fitted: Iterable[LangModel]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, in one narrow pass for each model.

    A pass carries on the best language so far, its log-probability, and the log of
    the sum over all languages, so languages of several models compete.
    """
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    none = F.lit(None)
    rows = runtime.need(documents, "doc_id", "text").select("doc_id", "text", none.cast("string").alias("lang_pred"), none.cast("double").alias("best"), none.cast("double").alias("total"))
    fitted = iter(fitted)
    model = next(fitted, None)
    while model:
        shared = spark.sparkContext.broadcast(model)
        model = next(fitted, None)
        # The last pass gives no texts back.
        kinds = {"doc_id": pa.int64(), **({"text": pa.string()} if model else {}), "lang_pred": pa.string(), "best": pa.float64(), "total": pa.float64()}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=pa.schema(kinds.items())) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                for lo, hi, _, _ in text.doc_slices(b["text"], text.SLICE_BYTES // 2):
                    part = b.slice(lo, hi - lo)
                    scores = log_scores(m, part["text"].to_pylist())
                    top = scores.argmax(1)  # the first of equal ones; languages are sorted
                    best = scores[np.arange(len(top)), top]
                    names, had = part["lang_pred"].to_pylist(), part["best"].to_numpy(zero_copy_only=False)
                    sums = np.log(np.exp(scores - best[:, None]).sum(1)) + best
                    total = part["total"].to_numpy(zero_copy_only=False)
                    more = ~np.isnan(total)
                    total = np.where(more, np.logaddexp(np.where(more, total, 0.0), sums), sums)
                    for i in np.flatnonzero(~np.isnan(best)):
                        name = m.langs[top[i]]
                        if names[i] is None or best[i] > had[i] or (best[i] == had[i] and name < names[i]):
                            names[i] = name
                    letters = ~np.isnan(best)
                    yield runtime.out_batch(schema, doc_id=part["doc_id"], text=part["text"], lang_pred=names, best=pa.array(np.fmax(best, had), mask=~letters), total=pa.array(total, mask=~letters))

        rows = rows.mapInArrow(runtime.lean(run), "doc_id long, " + "text string, " * bool(model) + "lang_pred string, best double, total double")
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("total")))).alias("score"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Is this document kept from training: crc32 of its id as text, modulo."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    fitted = models(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return predict(docs, fitted).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
