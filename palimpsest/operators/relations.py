"""Relations of a new fact to old ones: labels, the plan they make, anchors, fused text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings


def labelled(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs (old, new) with ``label`` by the offline rule, on sets of words.

    Equal sets: EQV. The new one holds all of the old and more: OSN; the reverse:
    NSO. Otherwise CON if similar enough, else IND. Each pair's sets are made and
    compared once; what is left of them is three sizes.
    """
    x, y, z = "_old_words", "_new_words", "_sizes"
    rows = pairs.withColumns({x: F.array_distinct(strings.tokens(F.col("old"))), y: F.array_distinct(strings.tokens(F.col("new")))})
    rows = rows.withColumn(z, F.struct(F.size(x).alias("a"), F.size(y).alias("b"), F.size(F.array_intersect(x, y)).alias("k"))).drop(x, y)
    a, b, k = (F.col(f"{z}.{n}") for n in "abk")
    union = a + b - k
    label = F.when((k == a) & (k == b), "EQV").when(k == a, "OSN").when(k == b, "NSO").when((union > 0) & (k >= threshold * union), "CON").otherwise("IND")
    return rows.withColumn("label", label).drop(z)


def plans(labelled: DataFrame, key: list[str], length: Column | None = None) -> DataFrame:
    """One plan for each new fact from its labelled candidates (old_id, old, rank, label); ``length`` may stand for that of the old text.

    The strongest label present decides: CON, OSN, NSO, EQV, else the fact is
    fresh. CON and OSN take all olds with that label, in rank order; NSO the one
    with the longest trimmed text (the better ranked of equal ones), EQV the best.
    """
    here = lambda x: F.filter(F.sort_array(F.collect_list(F.when(F.col("label") == x, F.struct("rank", "old_id")))), lambda s: s.isNotNull())
    got = labelled.groupBy(*key).agg(
        here("CON").alias("con"), here("OSN").alias("osn"), here("EQV").alias("eqv"),
        F.max_by(F.when(F.col("label") == "NSO", F.col("old_id")), F.when(F.col("label") == "NSO", F.struct(F.length(F.trim("old")) if length is None else length, -F.col("rank")))).alias("parent"),
    )
    some = lambda c: F.size(c) > 0
    outcome = F.when(some("con"), "conflict_update").when(some("osn"), "stronger_primary").when(F.col("parent").isNotNull(), "weaker_evidence").when(some("eqv"), "equivalent_evidence").otherwise("fresh")
    ids = lambda c: F.transform(c, lambda s: s["old_id"])
    got = got.withColumn("outcome", outcome)
    is_ = lambda x: F.col("outcome") == x
    out = got.select(
        *key, "outcome",
        F.when(is_("conflict_update"), ids("con")).otherwise(F.array().cast("array<bigint>")).alias("con_update_ids"),
        F.when(is_("stronger_primary"), ids("osn")).otherwise(F.array().cast("array<bigint>")).alias("demote_ids"),
        F.when(is_("weaker_evidence"), F.col("parent")).alias("parent_id"),
        F.when(is_("equivalent_evidence"), F.get("eqv", F.lit(0))["old_id"]).alias("representative_id"),
    )
    return with_anchor(out)


def with_anchor(plan: DataFrame) -> DataFrame:
    """Adds the old row that anchors the answer memory, the relation, and whether the new row is hidden (else the old)."""
    o = F.col("outcome")
    return plan.withColumns({
        "anchor_id": F.when(o == "conflict_update", F.get("con_update_ids", F.lit(0))).when(o == "stronger_primary", F.get("demote_ids", F.lit(0))).when(o == "weaker_evidence", F.col("parent_id")).when(o == "equivalent_evidence", F.col("representative_id")),
        "relation": F.when(o == "conflict_update", "CON").when(o == "stronger_primary", "OSN").when(o == "weaker_evidence", "NSO").when(o == "equivalent_evidence", "EQV"),
        "hide_new": F.when(o.isin("conflict_update", "stronger_primary"), True).when(o != "fresh", False),
    })


def unfused_text(relation: Column, old: Column, new: Column) -> Column:
    """The answer memory's text without a language model: the newer or the older fact as it stands."""
    return F.when(relation.isin("OSN", "CON"), new).otherwise(F.trim(old))


def joined_text(old: Column, new: Column) -> Column:
    """The fallback of a failed fusion."""
    return F.concat_ws("\n", old, new)
