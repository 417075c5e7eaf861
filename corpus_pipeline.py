"""From raw documents to token ids: five stages, each a training-data operator.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes what a stage returns as Parquet and reads it again for the
next one.

Rows: null and empty texts have no features, links, passages or leaks; they pass
all stages unless the intercept alone is toxic. Rows without a ``doc_id`` are
documents like others. Columns beyond those of ``documents`` are carried along to
the last stage, whatever their names. Empty tables give an empty table; without
benchmark items no document leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard, pieces, runtime, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a text without features has the score of the intercept.

    Without labels of both kinds the score is the share of toxic ones. Repeated rows
    score alike and go or stay together.
    """
    return toxicity.clean(docs, toxicity.trained(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least ``doc_id``.

    Of rows that share this id and the group, the one with the least hash of its
    text stays, once. Texts without words are linked with nothing and stay.
    """
    return jaccard.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; lengths follow.

    Every place of such a passage goes, the first too, since windows are judged on
    the input. A document that loses all its words stays, with an empty text; null
    and empty texts and their lengths stay as they are.
    """
    cut = substrings.removed(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; items without words leak into nothing, texts without words hold none."""
    return decontaminate.without_leaks(docs, runtime.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_pieces`` of every document that is left; null and empty texts have no ids."""
    import public_tokenizers

    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: Trained and iterative stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, held = runtime.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.written(docs, f"stage-{k}-{name}")
            if held:
                runtime.discard(spark, held)
            held = docs.shared_path
    return docs
