"""Evaluation tables: judge metrics, repeats, classification reports, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def judge_metrics(judged: DataFrame) -> DataFrame:
    """Per question type and overall (type ``ALL``): correct, judged, failed calls, accuracy of what was judged."""
    failed = F.coalesce(F.col("judge_api_failed"), F.lit(False))
    got = judged.groupingSets([["question_type"], []], "question_type").agg(
        F.count_if(~failed & F.coalesce(F.col("is_correct"), F.lit(False))).alias("correct"), F.count_if(~failed & F.col("is_correct").isNotNull()).alias("judged"),
        F.count_if(failed).alias("api_failed"), F.grouping("question_type").alias("g"),
    )
    return got.select(F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("question_type", F.lit("None"))).alias("question_type"), "correct", "judged", "api_failed", _share(F.col("correct"), F.col("judged")).alias("accuracy"))


def merged(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with what a judge said of them; rows that it did not see keep their fields."""
    key = ["history_name", "question_id"]
    new = outcomes.select(*key, F.col("is_correct").alias("_c"), F.col("judge_api_failed").alias("_f"), F.lit(True).alias("_seen"))
    both = predictions.withColumn("question_id", F.coalesce("question_id", "history_name")).join(new, key, "left")
    pick = lambda new, old: F.when(F.col("_seen"), F.col(new)).otherwise(F.col(old))
    return both.withColumns({"is_correct": pick("_c", "is_correct"), "judge_api_failed": pick("_f", "judge_api_failed")}).drop("_c", "_f", "_seen")


def repeats(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of ``accuracy`` over runs, sums of their counts; no deviation for one run.

    Runs without a finite accuracy, or of several benchmarks or judges, are an error.
    """
    bad = F.col("accuracy").isNull() | F.isnan("accuracy") | (F.abs("accuracy") == float("inf"))
    checked = runs.withColumn("accuracy", F.when(bad, F.raise_error(F.lit("accuracy is not a finite number")).cast("double")).otherwise(F.col("accuracy")))
    aggs = [F.count("*").alias("n"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sample_std"), F.sum("judged").alias("judged_sum"), F.avg("judged").alias("judged_mean"), F.sum("api_failed").alias("failed_sum"), F.avg("api_failed").alias("failed_mean")]
    mixed = [c for c in ("benchmark", "judge_model") if c in runs.columns]
    got = checked.groupBy(*(by or [])).agg(*aggs, *[F.count_distinct(c).alias(f"_{c}") for c in mixed])
    for c in mixed:
        got = got.withColumn("mean", F.when(F.col(f"_{c}") > 1, F.raise_error(F.lit(f"runs of several values of {c}")).cast("double")).otherwise(F.col("mean"))).drop(f"_{c}")
    return got


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """``gold, pred, n`` for every pair of labels, zero where there is none; a missing prediction is ``NONE``."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(g, p) for g in labels for p in [*labels, "NONE"]], "gold string, pred string")
    n = pairs.select("gold", F.coalesce("pred", F.lit("NONE")).alias("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return grid.join(n, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, and rows MACRO, WEIGHTED and MICRO."""
    hit = F.when(F.col("gold") == F.col("pred"), 1).otherwise(0)
    gold = pairs.groupBy(F.col("gold").alias("class")).agg(F.count("*").alias("support"), F.sum(hit).alias("tp"))
    pred = pairs.where("pred is not null").groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("predicted"))
    both = gold.join(pred, "class", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    each = both.withColumns({"precision": _share(F.col("tp"), F.col("predicted")), "recall": _share(F.col("tp"), F.col("support"))})
    each = each.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ["class", "precision", "recall", "f1", "support"]
    macro = each.agg(F.lit("MACRO").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    weighted = each.agg(F.lit("WEIGHTED").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    micro = each.agg(F.lit("MICRO").alias("class"), _share(F.sum("tp"), F.sum("predicted")).alias("precision"), _share(F.sum("tp"), F.sum("support")).alias("recall"), _share(2 * F.sum("tp"), F.sum("predicted") + F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    return each.select(*cols).unionByName(macro).unionByName(weighted).unionByName(micro)


def kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa; 1 if agreement is expected to be full."""
    by = by or []
    cell = pairs.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    a = cell.groupBy(*by, F.col("gold").alias("c")).agg(F.sum("n").alias("a"))
    b = cell.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("b"))
    total = cell.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"))
    chance = a.join(b, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    both = total.join(chance, by, "left") if by else total.crossJoin(chance)  # without groups, one row each
    pe = F.coalesce("ab", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return both.withColumns({"po": F.col("same") / F.col("n"), "pe": pe}).select(*by, "n", "po", "pe", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def agreement(labels: DataFrame, item: str, model: str, label: str) -> DataFrame:
    """Agreement and kappa of every pair of models on the items both labelled."""
    x = labels.select(F.col(item).alias("item"), F.col(model).alias("model_a"), F.col(label).alias("gold"))
    y = labels.select(F.col(item).alias("item"), F.col(model).alias("model_b"), F.col(label).alias("pred"))
    return kappa(x.join(y, "item").where("model_a < model_b"), ["model_a", "model_b"])


def errors(pairs: DataFrame) -> DataFrame:
    """For each gold label, wrong predictions, how many, and which is most common (then first by name)."""
    wrong = pairs.where(~F.col("gold").eqNullSafe(F.col("pred"))).select("gold", F.coalesce("pred", F.lit("NONE")).alias("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("gold").orderBy(F.desc("n"), "pred"))
    return wrong.withColumns({"place": place, "wrong": F.sum("n").over(W.partitionBy("gold"))})


def distribution(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Counts and shares (four places) of labels, by group and overall (group ``ALL``)."""
    n = rows.groupingSets([[by, label], [label]], by, label).agg(F.count("*").alias("n"), F.grouping(by).alias("g"))
    named = n.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), label, "n")
    return named.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(W.partitionBy(by)), 4))
