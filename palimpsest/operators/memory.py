"""The memory table: roles, visibility, dedup, evidence trees, bundle fusion, mutations.

A row: history_name, memory_id, seq, text, source_index, time, memory_role,
parent_primary, edge, answer_hidden, answer_id, stale, session_index, embedding.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import dates, strings
from ..session import ship


def role() -> Column:
    return F.coalesce(F.col("memory_role"), F.lit("primary"))


def is_primary() -> Column:
    return ~role().isin("evidence", "answer")


def _fresh() -> Column:
    return ~F.coalesce(F.col("stale"), F.lit(False))


def searchable_primary() -> Column:
    """Rows that ingest compares with: primaries that are not stale, hidden ones too."""
    return is_primary() & _fresh()


def answer_visible() -> Column:
    """Rows that answers may use."""
    hidden = F.coalesce(F.col("answer_hidden"), F.lit(False))
    return _fresh() & ((role() == "answer") | ((role() != "evidence") & ~hidden))


def fusion_primary() -> Column:
    """The looser reading of bundle fusion: anything but evidence."""
    return role() != "evidence"


def deduplicated(memories: DataFrame) -> DataFrame:
    """Of rows with one history, trimmed text and role, the earliest by time, then place; blank and null texts all stay."""
    order = W.partitionBy("history_name", F.trim("text"), role()).orderBy(dates.chat_time_or_last(F.col("time")), "seq")
    return memories.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) | (F.coalesce(F.trim("text"), F.lit("")) == "")).drop("_n")


def add_all(facts: DataFrame) -> DataFrame:
    """Every fact becomes a primary, in order; equal texts count once (the earliest by time)."""
    kept = facts.withColumn("text", F.trim("text")).where("text <> ''").withColumns({"memory_role": F.lit("primary"), "update_method": F.lit("add_all")})
    return deduplicated(kept)


def listed(memories: DataFrame, descending: bool = False) -> DataFrame:
    """All rows with their place by time, then insertion."""
    t = dates.chat_time_or_last(F.col("time"))
    order = W.partitionBy("history_name").orderBy(t.desc() if descending else t.asc(), "seq")
    return memories.withColumn("place", F.row_number().over(order))


def descendants(memories: DataFrame) -> DataFrame:
    """``history_name, root_id, memory_id, seq, depth`` of what hangs below each root, level by level.

    A root is a primary without a parent. Trees stay within histories and are
    followed to their ends, however deep. A cycle can hang below a root only where
    a history repeats an id; there an id is not reached again below itself.
    """
    ship(memories.sparkSession)
    base = memories.select("history_name", "memory_id", "parent_primary", is_primary().alias("p"), "seq")
    kinds = {f.name: f.dataType for f in base.schema}
    schema = StructType([StructField(n, kinds[k]) for n, k in (("history_name", "history_name"), ("root_id", "memory_id"), ("memory_id", "memory_id"), ("seq", "seq"))] + [StructField("depth", IntegerType())])
    return base.groupBy("history_name").applyInArrow(_trees, schema)


def _trees(rows: pa.Table) -> pa.Table:
    """The trees of one history; a history without a name has roots only."""
    ids, parents, primary = (rows[c].to_pylist() for c in ("memory_id", "parent_primary", "p"))
    children: dict = {}
    if rows["history_name"][0].is_valid:
        for i, (parent, p) in enumerate(zip(parents, primary, strict=True)):
            if parent is not None and not p:
                children.setdefault(parent, []).append(i)
    repeated = len(set(ids)) < len(ids)
    # Each node: its root's row, its own row, its depth, the node above it.
    root = [i for i, p in enumerate(primary) if p and parents[i] is None]
    row, depth, above = list(root), [0] * len(root), [-1] * len(root)
    node = 0
    while node < len(row):
        below = children.get(ids[row[node]], ()) if ids[row[node]] is not None else ()
        if repeated and below:
            path, at = set(), node
            while at >= 0:
                path.add(ids[row[at]])
                at = above[at]
            below = [i for i in below if ids[i] not in path]
        for i in below:
            root.append(root[node])
            row.append(i)
            depth.append(depth[node] + 1)
            above.append(node)
        node += 1
    own = rows.take(pa.array(row, pa.int64()))
    roots = rows["memory_id"].take(pa.array(root, pa.int64()))
    return pa.table({"history_name": own["history_name"], "root_id": roots, "memory_id": own["memory_id"], "seq": own["seq"], "depth": pa.array(depth, pa.int32())})


def fused_bundles(memories: DataFrame) -> DataFrame:
    """Each root with its evidence as one row: members, latest time by string order, texts joined by line ends."""
    tree = descendants(memories)
    rows = tree.join(memories.select("history_name", "memory_id", "text", "time"), ["history_name", "memory_id"])
    member = F.struct("depth", "seq", "memory_id", "text")
    got = rows.groupBy("history_name", "root_id").agg(F.count("*").alias("members"), F.max("time").alias("time"), F.sort_array(F.collect_list(member)).alias("m"))
    return got.select(
        "history_name", "root_id", "members", "time",
        F.transform("m", lambda x: x["memory_id"]).alias("member_ids"),
        F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"),
    )


def fused_store(memories: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The store after fusion: each root with evidence becomes one row, its members go, others stay.

    A fused row has a new id (after the history's greatest, by root), its texts
    joined by line ends, or the one that ``texts`` (history_name, root_id, text) has,
    the latest time by string order, and ``member_ids``. Rows that stay are their
    own only member; their parent becomes the fused row that took it in. Histories
    in which a row has members already are left as they are.
    """
    held = memories
    for name, kind in (("fused_member_count", "long"), ("member_ids", "array<long>")):
        held = held if name in held.columns else held.withColumn(name, F.lit(None).cast(kind))
    done = held.where("member_ids is not null").select("history_name").distinct() if "member_ids" in memories.columns else None
    todo = held if done is None else held.join(done, "history_name", "left_anti")
    fused = fused_bundles(todo).where("members > 1")
    if texts is not None:
        fused = fused.join(texts.select("history_name", "root_id", F.col("text").alias("_said")), ["history_name", "root_id"], "left").withColumn("text", F.coalesce(F.nullif(F.trim("_said"), F.lit("")), "text")).drop("_said")
    top = todo.groupBy("history_name").agg(F.max("memory_id").alias("_top"))
    place = F.row_number().over(W.partitionBy("history_name").orderBy("root_id"))
    fused = fused.withColumn("place", place).join(top, "history_name").withColumn("fused_id", F.col("_top") + F.col("place"))
    owner = fused.select("history_name", "fused_id", F.explode("member_ids").alias("member"))
    stay = todo.join(owner.select("history_name", F.col("member").alias("memory_id")), ["history_name", "memory_id"], "left_anti")
    parents = owner.select("history_name", F.col("member").alias("parent_primary"), "fused_id")
    stay = stay.join(parents, ["history_name", "parent_primary"], "left").withColumn("parent_primary", F.coalesce("fused_id", "parent_primary"))
    stay = stay.withColumns({"fused_member_count": F.greatest(F.coalesce("fused_member_count", F.lit(1)), F.lit(1)).cast("long"), "member_ids": F.array(F.col("memory_id").cast("long"))})
    roots = todo.withColumnRenamed("memory_id", "root_id").drop("text", "time", "member_ids", "fused_member_count", "memory_role", "parent_primary")
    new = fused.select("history_name", "root_id", F.col("fused_id").alias("memory_id"), "text", "time", "member_ids", F.col("members").alias("fused_member_count")).join(roots, ["history_name", "root_id"])
    new = new.withColumns({"memory_role": F.lit("primary"), "parent_primary": F.lit(None).cast(held.schema["parent_primary"].dataType)})
    out = stay.select(*held.columns).unionByName(new.select(*held.columns))
    return out if done is None else out.unionByName(held.join(done, "history_name", "left_semi").select(*held.columns))


def embedding_text(primary_text: Column, text: Column) -> Column:
    """What is embedded for a row: the text meant for it, else its own."""
    return F.coalesce(F.nullif(F.trim(primary_text), F.lit("")), text)


def depth_one_packages(memories: DataFrame) -> DataFrame:
    """``history_name, center_id, leaves``: each row with children, with those children that have none."""
    children = memories.where("parent_primary is not null").select("history_name", F.col("parent_primary").alias("center_id"), "memory_id")
    inner = memories.where("parent_primary is not null").select("history_name", F.col("parent_primary").alias("memory_id")).distinct()
    leaves = children.join(inner, ["history_name", "memory_id"], "left_anti")
    return leaves.groupBy("history_name", "center_id").agg(F.count("*").alias("leaves"), F.min("memory_id").alias("first_leaf"))


def applied(memories: DataFrame, operations: DataFrame) -> DataFrame:
    """The store after a batch of ADD, UPDATE and DELETE, the last operation on an id counting.

    ``operations``: history_name, memory_id, op, text, time, op_seq. Updates of
    unknown ids or with blank texts and NONE do nothing.
    """
    order = W.partitionBy("history_name", "memory_id").orderBy(F.desc("op_seq"))
    live = operations.where("op in ('ADD', 'DELETE') or (op = 'UPDATE' and trim(text) <> '')")
    last = live.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("history_name", "memory_id", "op", F.col("text").alias("_text"), F.col("time").alias("_time"))
    both = memories.join(last, ["history_name", "memory_id"], "full_outer")
    known = F.col("seq").isNotNull()
    return both.where(F.coalesce(F.col("op") != "DELETE", F.lit(True)) & (known | (F.col("op") == "ADD"))).select(
        "history_name", "memory_id", F.coalesce("_text", "text").alias("text"), F.coalesce("_time", "time").alias("time"), F.coalesce("op", F.lit("KEEP")).alias("last_op")
    )


def clusters_finalized(members: DataFrame) -> DataFrame:
    """``history_name, cluster, text, members, memory_role, seq, time``: singletons as they are, others joined, plus their evidence rows.

    A joined row has the place of its first member and the time of its last.
    """
    m = F.struct("seq", "text", "time")
    got = members.groupBy("history_name", "cluster").agg(F.count("*").alias("members"), F.sort_array(F.collect_list(m)).alias("m"))
    joined = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    primary = got.select("history_name", "cluster", joined.alias("text"), "members", F.lit("primary").alias("memory_role"), F.get("m", F.lit(0))["seq"].alias("seq"), F.element_at("m", -1)["time"].alias("time"))
    several = got.where("members > 1").select("history_name", "cluster", "members", F.explode("m").alias("x"))
    return primary.unionByName(several.select("history_name", "cluster", F.col("x.text").alias("text"), "members", F.lit("evidence").alias("memory_role"), "x.seq", "x.time"))


def graph_edges(facts: DataFrame) -> DataFrame:
    """Facts as edges of a history's graph: speakers named, and valid until the next fact on the same matter.

    ``facts``: history_name, seq, text, time. A matter is named by the first three
    words of the aliased text; blank facts are none. Adds ``fact, matter, valid_at, invalid_at``.
    """
    named = facts.where("trim(text) <> ''").withColumn("fact", strings.aliased(F.trim("text"), F.col("history_name")))
    matter = F.array_join(F.slice(strings.tokens(F.col("fact")), 1, 3), " ")
    return validity(named.withColumn("matter", matter), ["history_name", "matter"], "seq", "fact")


def validity(facts: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """A bitemporal table: each fact holds until the next one of its key; adds ``valid_at``, ``invalid_at``."""
    order = W.partitionBy(*key).orderBy(at, value)
    return facts.withColumns({"valid_at": F.col(at), "invalid_at": F.lead(at).over(order)})


def valid_edges(edges: DataFrame) -> DataFrame:
    """What still holds and says something."""
    return edges.where("invalid_at is null and trim(fact) <> ''")


def not_exported(edges: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """Edges of an incremental export."""
    return edges.join(exported.select(key).distinct(), key, "left_anti")
