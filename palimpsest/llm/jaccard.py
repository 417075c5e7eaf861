"""N-gram Jaccard join over size-banded tiles with bitmap signatures.

A document's set holds hashes of its distinct 5-word shingles. Two documents
link when 100 * intersection >= 80 * union.

1. Equal sets are one node, named by a hash of the set.
2. A filter of bounded size tells shingles that occur in several documents, and a
   second one those in very many. Shingles are ordered by rarity so measured,
   then by hash; linked sets share one of their first ``prefix`` shingles in any
   such order, and sets with enough shingles of their own need not be looked at.
3. Sets that share such a shingle and are near enough in size form coarse groups
   (connected components): all links lie within a group.
4. Each group's sets are compared with the group's least set; what links with it
   needs no comparison among itself.
5. The rest is compared with its whole group in tiles: members are banded by size
   (a band spans a factor of 1.25) and bands are cut into blocks, so a tile has a
   bounded number of rows and only neighbouring bands meet. In a tile, bit counts
   of the sets' parity bitmaps bound the overlap from above; what passes is
   decided by intersecting the sorted arrays.
6. Components of the links give the result.

Rows: documents without text or words have an empty set and are alone. Fewer
than five words make one shingle. Rows that repeat a ``doc_id`` are documents of
their own which share its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import components, filters, runtime, text

SHINGLE = 5
#: Ranges of 32 hash bits each in which shingles are counted, as bits; bytes of a table for each range beyond the least.
#: A shingle is common from this many documents on.
RANGE_BITS, MOST_RANGE_BITS, RANGE_BYTES, COMMON = 10, 20, 32 << 20, 200
#: Shingles that a task gathers before it sends them out by range.
GATHERED = 1 << 19
#: Parts into which the sets with a common shingle are dealt.
PARTS = 32
#: Rows of a block, and bits of a bitmap.
BLOCK, BITMAP = 2048, 2048


def sets_of(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted shingle hashes of each document."""
    low = text.LOWER[buf]
    w = text.words(low, offs, text.BLANKS)
    h = text.word_hashes(low, w, seed=5)
    grams = text.windows(h, SHINGLE, seed=5)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(text.windows(h[a:b], b - a, seed=6))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    x = np.array([text.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(text.mix(x).astype(np.int64)[0])


def prefix_size(n: int) -> int:
    """Linked sets share one of this many first shingles, in any common order."""
    return n - (4 * n + 4) // 5 + 1


def range_bits(documents: DataFrame) -> int:
    """Enough ranges that a task sorts some ten million shingles of one at a time, whatever the table's size."""
    return min(MOST_RANGE_BITS, max(RANGE_BITS, (runtime.size_hint(documents) // RANGE_BYTES).bit_length()))


def counted_key(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of a shingle's hash by which it is counted."""
    return shingles >> np.uint64(32 - bits)


def common_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters of the shingles that occur in two documents, and of those in very many; and the bits of a range.

    The leading bits of each hash are counted: rows carry arrays of 32 bits for a
    range of the bits before them, four bytes a shingle.
    """
    runtime.arrow_limits(documents.sparkSession)
    bits = range_bits(documents)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            keys = np.sort(counted_key(np.concatenate(held), bits))
            high = keys >> np.uint64(32)
            new = np.flatnonzero(np.diff(high, prepend=high[0] + np.uint64(1)))
            low = keys.astype(np.uint32).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array(high[new].astype(np.int32)), pa.array([low[a:e].tobytes() for a, e in zip(new, [*new[1:], len(low)], strict=True)], pa.binary())], names=["range", "low"])

        for b in batches:
            for _, _, buf, offs in text.doc_slices(b["text"]):
                sets = sets_of(buf, offs)
                held += sets
                n += sum(map(len, sets))
                if n >= GATHERED:
                    yield sent()
                    held, n = [], 0
        if any(map(len, held)):
            yield sent()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range: one range is held at a time."""
        held, now = [], None

        def counted() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
            times = np.diff(np.append(new, len(keys)))
            new, times = new[times > 1], times[times > 1]
            for lo in range(0, len(new), 1 << 16):
                k = text.mix(keys[new[lo : lo + (1 << 16)]].astype(np.uint64) | np.uint64(now << 32))
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(times[lo : lo + (1 << 16)] >= COMMON)], names=["key", "common"])

        for b in batches:
            for r, low in zip(b["range"].to_pylist(), b["low"], strict=True):
                if r != now and held:
                    yield from counted()
                    held = []
                now = r
                held.append(np.frombuffer(low.as_buffer(), "<u4"))
        if held:
            yield from counted()

    dealt = documents.select("text").mapInArrow(runtime.lean(spread), "range int, low binary").repartition("range").sortWithinPartitions("range")
    runtime.arrow_limits(documents.sparkSession, 4096)
    found = runtime.written(dealt.mapInArrow(runtime.lean(gather), "key long, common boolean"), "shared-shingles")
    both = filters.build(found, "key", filters.bits_for(documents, filters.SHINGLES)), filters.build(found.where("common"), "key", 23)
    runtime.discard(documents.sparkSession, found.shared_path)
    return *both, bits


def ranked_sets(documents: DataFrame, flags: tuple[np.ndarray, np.ndarray, int], more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, sid, prefix, rare`` of every document; ``prefix`` has only shingles that others may share.

    Its first ``rare`` shingles are not common. ``more`` names columns of longs that
    are carried along.
    """
    runtime.arrow_limits(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(flags)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("prefix", pa.list_(pa.int64())), ("rare", pa.int32()), *[(c, pa.int64()) for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, many, bits = shared.value
        for b in batches:
            for lo, hi, buf, offs in text.doc_slices(b["text"]):
                sets = sets_of(buf, offs)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)])
                key = text.mix(counted_key(flat, bits))
                rank = filters.may_hold(several, key).astype(np.int8)
                rank += (rank > 0) & filters.may_hold(many, key)
                at, prefixes, names, rare = 0, [], [], []
                for s in sets:
                    r = rank[at : at + len(s)]
                    at += len(s)
                    left = prefix_size(len(s)) - int((r == 0).sum()) if len(s) else 0
                    names.append(set_id(s))
                    rare.append(int((r == 1).sum()))
                    if left > 0:  # sets are sorted by hash, so each rank is too
                        prefixes.append(np.concatenate([s[r == 1], s[r == 2]])[:left].astype(np.int64))
                    else:
                        prefixes.append(np.empty(0, np.int64))
                yield runtime.out_batch(schema, doc_id=b["doc_id"].slice(lo, hi - lo), n=[len(s) for s in sets], sid=names, prefix=prefixes, rare=rare, **{c: b[c].slice(lo, hi - lo) for c in more})

    kind = "doc_id long, n int, sid long, prefix array<long>, rare int" + "".join(f", {c} long" for c in more)
    out = runtime.written(runtime.need(documents, "doc_id", "text", *more).mapInArrow(runtime.lean(run, shared=(shared,)), kind), "ranked-sets")
    shared.destroy()  # the table stays; the filters are not needed again
    return out


def _runs(rows: DataFrame, by: list[str], size: str, reach: str, name: str) -> DataFrame:
    """Adds ``head``, the first ``name`` of each run of rows near in size: a run ends where ``size`` is beyond all that came before."""
    order = W.partitionBy(*by).orderBy(size, name)
    before = F.max(reach).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = before.isNull() | (4 * F.col(size) > 5 * before)
    return rows.withColumn("starts", starts).withColumn("head", F.last(F.when(F.col("starts"), F.col(name)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))


def coarse_groups(ranked: DataFrame) -> DataFrame:
    """``sid, group``: sets that may link, by runs of near sizes among the sets with a prefix shingle.

    Sets with a common shingle are dealt into parts; the parts' runs are joined afterwards.
    """
    sets = ranked.where(F.size("prefix") > 0).select("sid", "n", "prefix", "rare").dropDuplicates(["sid"])
    rows = sets.select("sid", "n", "rare", F.posexplode("prefix").alias("place", "token"))
    part = F.when(F.col("place") < F.col("rare"), 0).otherwise(1 + F.pmod(F.xxhash64("sid"), F.lit(PARTS)).cast("int"))
    held = _runs(rows.select("sid", "n", "token", part.alias("part")), ["token", "part"], "n", "n", "sid")
    # Stars around the first set of each run, rather than chains, so that components settle soon.
    own = held.where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    parts = held.where("part > 0").groupBy("token", "part", "head").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("token", "lo", "hi", F.col("head").alias("first"))
    across = _runs(parts, ["token"], "lo", "hi", "first").where("first <> head").select(F.col("first").alias("a"), F.col("head").alias("b"))
    return components.connected(own.unionByName(across)).select(F.col("node").alias("sid"), F.col("root").alias("group"))


def group_sets(documents: DataFrame, ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """``group, sid, n, shingles`` for one document of each set in a group.

    A filter of bounded size picks the documents by their ids, so only their texts
    are cut again and only their sets are shuffled. A task sends a set once.
    """
    spark = documents.sparkSession
    first = ranked.groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("first"))
    chosen = runtime.written(first.join(groups.hint("merge"), "sid").select("sid", "group", "first"), "chosen-sets")
    shared = spark.sparkContext.broadcast(filters.build(chosen.select(F.xxhash64("first").alias("key")), "key", filters.bits_for(documents, filters.ROWS)))
    schema = pa.schema([("sid", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))])
    runtime.arrow_limits(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            b = b.filter(pa.array(filters.may_hold(shared.value, b["key"].to_numpy())))
            doc_ids = b["first"].to_numpy()
            for lo, hi, buf, offs in text.doc_slices(b["text"]):
                sets, keep = sets_of(buf, offs), []
                sid = np.array([set_id(s) for s in sets], np.int64)
                for i, name in enumerate(zip(sid.tolist(), doc_ids[lo:hi].tolist(), strict=True)):
                    if name not in seen:
                        seen.add(name)
                        keep.append(i)
                sets = [sets[i] for i in keep]
                flat = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.int64))
                size = np.array([len(s) for s in sets], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
                yield runtime.out_batch(schema, sid=sid[keep], first=doc_ids[lo:hi][keep], n=size, shingles=lists)

    rows = runtime.need(documents, "doc_id", "text").select(F.coalesce("doc_id", F.lit(-1)).alias("first"), "text")
    found = rows.withColumn("key", F.xxhash64("first")).mapInArrow(runtime.lean(run, shared=(shared,)), "sid long, first long, n int, shingles array<long>")
    out = runtime.written(found.join(chosen.hint("merge"), ["sid", "first"]).select("group", "sid", "n", "shingles"), "group-sets")
    shared.destroy()
    runtime.discard(spark, chosen.shared_path)
    return out


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: each shingle flips a bit."""
    out = np.zeros((len(sets), BITMAP), bool)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Does the pair of sorted sets link?"""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 5 * len(a) < 4 * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a list column."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat, offs = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def solve_tile(asked: pa.Table, given: pa.Table) -> pa.Table:
    """Links between the asked and the given sets of a tile, but none within what is connected already.

    ``linked`` marks given sets that are connected with one another outside the tile.
    """
    found: list[tuple[int, int]] = []
    if len(asked) and len(given):
        ids = np.concatenate([asked["sid"].to_numpy(), given["sid"].to_numpy()])
        sets = _sets(asked["shingles"]) + _sets(given["shingles"])
        size = np.array([len(s) for s in sets])
        bits = bitmaps(sets)
        forest, k = _Forest(len(ids)), len(asked)
        place: dict[int, int] = {}
        for i, sid in enumerate(ids.tolist()):  # a set can stand on both sides
            forest.up[i] = place.setdefault(sid, i)
        linked = np.flatnonzero(given["linked"].to_numpy()) + k
        for i in linked[1:]:
            forest.up[forest.find(int(i))] = forest.find(int(linked[0]))
        for i in range(k):
            differ = np.bitwise_count(bits[k:] ^ bits[i]).sum(1, dtype=np.int64)
            n = size[k:] + size[i]
            for j in (np.flatnonzero(9 * ((n - differ) // 2) >= 4 * n) + k).tolist():
                a, b = forest.find(i), forest.find(j)
                if a != b and links(sets[i], sets[j]):
                    forest.up[a] = b
                    found.append((ids[i], ids[j]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def verified_links(sets: DataFrame) -> DataFrame:
    """Edges ``a, b`` between set names that connect exactly the sets which links connect.

    ``sets`` is a written table, which is removed. A group is named by its least set.
    """
    spark = sets.sparkSession
    heads = runtime.reread(sets).where("sid = group").dropDuplicates(["group"]).select("group", F.col("shingles").alias("of"))
    both = F.size(F.array_intersect("shingles", "of"))
    linked = (F.col("sid") == F.col("group")) | (5 * both >= 4 * (F.size("shingles") + F.size("of") - both))
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    once = sets.join(heads.hint("merge"), "group").select("group", "sid", "n", band.alias("band"), linked.alias("linked"), "shingles")
    judged = runtime.written(once, "judged-sets")
    runtime.discard(spark, sets.shared_path)
    counted = runtime.written(judged.groupBy("group", "band").agg(F.count("*").alias("rows"), F.count_if(~F.col("linked")).alias("rest")), "group-bands")
    blocks = lambda column: F.greatest(F.lit(1), F.ceil(F.col(column) / BLOCK)).cast("int")

    # Pairs of neighbouring bands where one has a rest; sets of other groups are done.
    left = counted.where("rest > 0").select("group", F.col("band").alias("band_a"), blocks("rest").alias("n_a"))
    right = runtime.reread(counted).select("group", F.col("band").alias("band_b"), blocks("rows").alias("n_b"))
    tiles = runtime.written(left.join(right, "group").where("abs(band_a - band_b) <= 1"), "tiles")
    open_groups = spark.sparkContext.broadcast(filters.build(left.select("group").distinct(), "group", 23))
    key = ["group", "band_a", "block_a", "band_b", "block_b"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    asked = runtime.reread(judged).where("not linked").join(tiles.withColumnRenamed("band_a", "band"), ["group", "band"])
    asked = asked.select("group", F.col("band").alias("band_a"), place("n_a").alias("block_a"), "band_b", every("n_b").alias("block_b"), "sid", "shingles")
    given = runtime.reread(judged).where(filters.passes(open_groups, "group")).join(runtime.reread(tiles).withColumnRenamed("band_b", "band"), ["group", "band"])
    given = given.select("group", "band_a", every("n_a").alias("block_a"), F.col("band").alias("band_b"), place("n_b").alias("block_b"), "sid", "shingles", "linked")
    runtime.arrow_limits(spark, BLOCK)
    solved = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(solve_tile, "a long, b long")
    direct = judged.where("linked and sid <> group").select(F.col("sid").alias("a"), F.col("group").alias("b"))
    return direct.unionByName(solved)


def set_components(documents: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, sid`` (and more columns) of every document, and ``sid, root`` of the sets that link with another."""
    docs = runtime.need(documents, "doc_id", "text", *more)
    ranked = ranked_sets(docs, common_shingles(docs), more)
    groups = coarse_groups(ranked)
    found = components.connected(verified_links(group_sets(docs, ranked, groups)), sparse=True)
    return ranked.select("doc_id", "n", "sid", *more), runtime.written(found.select(F.col("node").alias("sid"), "root"), "set-roots")


def labelled(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs, roots = set_components(documents)
    # The least document of each set, then of each component; neither collects a group.
    rooted = runtime.written(docs.join(roots.hint("merge"), "sid", "left").select("doc_id", "n", "sid", F.coalesce("root", "sid").alias("root")), "rooted")
    least = runtime.written(rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least-documents")
    return rooted.join(least.hint("merge"), "root", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows, all columns kept, of one document of each component: the least ``doc_id``.

    Of rows that share this number and a component, the least text's hash stays,
    once. Empty sets are alone and stay. A filter of bounded size lets the rows that
    stay for certain pass in place; only the others are shuffled.
    """
    spark = documents.sparkSession
    docs = runtime.need(documents, "doc_id", "text").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranked, roots = set_components(docs, "key")
    rooted = runtime.written(ranked.where("n > 0").join(roots.hint("merge"), "sid", "left").select("doc_id", "key", F.coalesce("root", "sid").alias("root")), "rooted")
    least = runtime.written(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("m"), F.count("*").alias("rows")).where("rows > 1").select("root", "m.*", "rows"), "least-documents")
    least = least.select("root", F.col("doc_id").alias("least_id"), F.col("key").alias("least_key"))
    # Rows of components with several rows; of those the least stays, once.
    several = runtime.written(rooted.join(least.hint("merge"), "root").select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("key") == F.col("least_key"))).alias("stays")).distinct(), "several")
    own, key, left_id, left_key, stays = runtime.fresh(documents, "own", "key", "left_id", "left_key", "stays")
    mine = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = spark.sparkContext.broadcast(filters.build(several.select(F.xxhash64("doc_id", "key").alias("own")), "own", filters.bits_for(documents, filters.ROWS)))
    names = documents.columns
    runtime.arrow_limits(spark)
    rows = documents.withColumn(own, F.xxhash64("doc_id", mine))
    certain = rows.where(~filters.passes(shared, own)).select(names)
    asked = rows.where(filters.passes(shared, own)).select(*names, mine.alias(key))
    marks = several.select(F.col("doc_id").alias(left_id), F.col("key").alias(left_key), F.col("stays").alias(stays))
    judged = asked.join(marks.hint("merge"), asked["doc_id"].eqNullSafe(marks[left_id]) & (asked[key] == marks[left_key]), "left").drop(left_id, left_key)
    alone = judged.where(F.col(stays).isNull()).select(names)
    once = judged.where(F.col(stays)).dropDuplicates(["doc_id", key]).select(names)
    return certain.unionByName(alone).unionByName(once)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(runtime.table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    u AS (SELECT doc_id, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    g AS (SELECT doc_id, k, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM u),
    sh AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(1, k - 4)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
    c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1)
    SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """
}
