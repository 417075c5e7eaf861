"""Evidence forests by pointer doubling: depth, root, size and pre-order of every row, in a few joins for any depth.

Each round doubles how far a row sees: its ancestor becomes its ancestor's ancestor, and
what was counted on the way is added up. A chain of 100,000 rows in one history takes 17
rounds, each of them joins of the whole table; no task holds a history. Rows that hang
below no root, cycles among them, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from . import memory


def linked(memories: DataFrame) -> DataFrame:
    """``history_name, id, parent, top``: rows with their parent, if it is there, and whether they are roots (primaries without a parent)."""
    rows = memories.select("history_name", F.col("memory_id").alias("id"), F.col("parent_primary").alias("parent"), (memory.is_primary() & F.col("parent_primary").isNull()).alias("top"))
    return rows.where("id IS NOT NULL").dropDuplicates(["history_name", "id"])


def _doubled(rows: DataFrame, sums: list[str], below: bool) -> DataFrame:
    """One round: ``anc`` is the row 2^k above, null beyond the top.

    With ``below``, sums of a row take in those of the rows 2^k below it; without, those
    of the row above.
    """
    key = ["history_name", "anc"]
    above = rows.select("history_name", F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("end").alias("_end"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in sums])
    out = rows.join(above, key, "left")
    far = F.col("_end").isNotNull()  # the ancestor is a row
    out = out.select("history_name", "id", "parent", "top", F.col("_anc").alias("anc"), F.when(far, F.col("_end")).otherwise(F.col("end")).alias("end"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), *[(F.col(c) + (F.lit(0) if below else F.coalesce(f"_{c}", F.lit(0)))).alias(c) for c in sums])
    if not below:
        return out
    gained = rows.where("anc IS NOT NULL").groupBy(*key).agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumnRenamed("anc", "id")
    return out.join(gained, ["history_name", "id"], "left").select("history_name", "id", "parent", "top", "anc", "end", "depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])


def _until_top(rows: DataFrame, sums: list[str], below: bool, limit: int) -> DataFrame:
    """Rounds until no row has an ancestor left, or, where there are cycles, all that the longest chain can need."""
    rows = checkpointed(rows)
    reach = 1
    while reach <= limit and not rows.where("anc IS NOT NULL").isEmpty():
        rows, reach = checkpointed(_doubled(rows, sums, below)), reach * 2
    return rows


def placed(memories: DataFrame) -> DataFrame:
    """``history_name, memory_id, parent_primary, root_id, depth, size, place`` of the rows below roots.

    ``size`` counts a row and all below it; ``place`` numbers a history's rows in
    pre-order from 0, roots and children by id. Ids of a history differ; a history
    without a name has roots only.
    """
    rows = linked(memories)
    limit = max((r[0] for r in rows.groupBy("history_name").count().agg(F.max("count")).collect() if r[0]), default=0)
    there = rows.select("history_name", F.col("id").alias("parent"), F.lit(True).alias("known"))
    begun = rows.join(there, ["history_name", "parent"], "left").select(
        "history_name", "id", "parent", "top", F.when(~F.col("top") & F.col("known"), F.col("parent")).alias("anc"),
        F.when(F.col("known") & ~F.col("top"), F.col("parent")).otherwise(F.col("id")).alias("end"),
        F.when(F.col("known") & ~F.col("top"), 1).otherwise(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"),
    )
    sized = _until_top(begun, ["size"], True, limit)
    tops = rows.where("top").select("history_name", F.col("id").alias("end"))
    kept = sized.where("anc IS NULL AND (top OR end <> id)").join(tops.withColumn("_t", F.lit(True)), ["history_name", "end"], "left").where("top OR _t")
    earlier = W.partitionBy("history_name", F.when(F.col("top"), F.lit(None)).otherwise(F.col("parent"))).orderBy("id")
    step = F.sum("size").over(earlier) - F.col("size") + F.when(F.col("top"), 0).otherwise(1)
    own = kept.select("history_name", "id", "parent", "top", F.when(~F.col("top"), F.col("parent")).alias("anc"), "end", F.lit(0).cast("long").alias("depth"), step.alias("place"), F.col("end").alias("root_id"), F.col("depth").alias("_d"), "size")
    own = checkpointed(own)
    walked = _until_top(own.select("history_name", "id", "parent", "top", "anc", F.col("id").alias("end"), "depth", "place"), ["place"], False, limit)
    known = own.select(F.col("history_name").alias("_h"), F.col("id").alias("_i"), "root_id", F.col("_d").alias("_depth"), "size")
    both = walked.select("history_name", "id", "parent", "place").join(known, F.col("history_name").eqNullSafe(F.col("_h")) & (F.col("id") == F.col("_i")))
    return both.select("history_name", F.col("id").alias("memory_id"), F.col("parent").alias("parent_primary"), "root_id", F.col("_depth").cast("long").alias("depth"), "size", F.col("place").cast("long").alias("place"))


def packages(memories: DataFrame) -> DataFrame:
    """``history_name, place, center_id, depth, member_ids``: each tree cut into disjoint packages of depth one, in pre-order.

    Roots and rows with children are centers; a package is a center and those of its
    children that have none, by id. A center whose children all have some is alone.
    """
    rows = checkpointed(placed(memories))
    leaves = rows.where("size = 1 AND parent_primary IS NOT NULL").groupBy("history_name", F.col("parent_primary").alias("center_id")).agg(F.sort_array(F.collect_list("memory_id")).alias("leaves"))
    centers = rows.where("size > 1 OR depth = 0").select("history_name", F.col("memory_id").alias("center_id"), "depth", F.col("place").alias("order"))
    own = centers.join(leaves, ["history_name", "center_id"], "left")
    place = F.row_number().over(W.partitionBy("history_name").orderBy("order"))
    return own.select("history_name", place.alias("place"), "center_id", "depth", F.concat(F.array("center_id"), F.coalesce("leaves", F.array().cast("array<long>"))).alias("member_ids"))


def wave(memories: DataFrame) -> DataFrame:
    """The packages of two and more that a round of fusion takes, ancestors before descendants: by depth, then center."""
    several = packages(memories).where(F.size("member_ids") > 1)
    place = F.row_number().over(W.partitionBy("history_name").orderBy("depth", "center_id"))
    return several.select("history_name", place.alias("place"), "center_id", "depth", "member_ids")
