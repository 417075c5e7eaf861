"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``SPAN`` consecutive words of a document. Every window has an anchor,
its ``ANCHOR`` words with the least hash (the leftmost of equal ones); equal
windows have equal anchors at equal places. The windows of one anchor in a row
form a phrase. Anchors assign phrases to reference blocks, so a document is
parsed against every block that can hold one of its windows, and against no other.

1. Anchors that occur twice anywhere pass a filter of bounded size; phrases of
   other anchors cannot repeat and go no further.
2. Equal phrases are counted, before the shuffle and after it; a passage in
   very many documents becomes one row.
3. A block is indexed by a suffix array over its phrases, whose symbols are windows
   (64-bit hashes of their words). Each phrase is factored greedily: the longest
   match elsewhere in the block, found among its neighbours in the suffix order,
   is a factor; a symbol without a match is a literal.
4. A factor of k symbols is SPAN + k - 1 words and thus always long enough. The
   parse goes on one window after the factor's last one, so at a boundary it looks
   back over SPAN - 1 words, and no repeated window across the boundary is missed.
   The factors' words are the duplicate spans; factors that overlap make longer ones.
5. Anchors with very many different phrases (common lines in ever other contexts)
   are no block's: their phrases are cut into windows, which are counted by
   themselves, a row for each window and task.

Two windows are equal if their hashes are; for n different windows the chance that
any two collide is about n**2 / 2**65.

Rows: null, empty and short texts have no window and keep all words. Repeated
rows are documents of their own, so their windows occur elsewhere. Windows are
judged on the input, all removals happen at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters, runtime, text

#: Words of a window and of an anchor.
SPAN, ANCHOR = 35, 8
#: Phrases that are indexed together; different phrases of an anchor from which on its windows are counted instead.
INDEXED, HOT = 20_000, 2048
_PLACE = 28  # bits for places in a slice, below the bits of the hash


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    m, have = values, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(m) - (width - have)], m[width - have :])


def phrases_of(buf: np.ndarray, offs: np.ndarray, span: int = SPAN) -> dict[str, np.ndarray]:
    """Phrases of some documents: document, first window, windows, anchor, its place; and all windows' hashes."""
    w = text.words(buf, offs, text.BLANKS)
    h = text.word_hashes(buf, w)
    none = np.empty(0, np.int64)
    if len(h) < span:
        return {"doc": none, "pos": none, "size": none, "anchor": none.astype(np.uint64), "lo": none, "at": none, "hash": none.astype(np.uint64)}
    grams = text.windows(h, ANCHOR, seed=3)
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & ~np.uint64((1 << _PLACE) - 1)) | (place & np.uint64((1 << _PLACE) - 1))
    least_at = (least(packed, span - ANCHOR + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    ok = text.whole(w.first, span)
    doc = w.doc[: len(ok)]
    new = np.ones(len(ok), bool)
    new[1:] = (least_at[1:] != least_at[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    at = np.flatnonzero(ok & new)
    stop = np.flatnonzero(~ok | new)
    nxt = np.searchsorted(stop, at, "right")
    size = np.append(stop, len(ok))[nxt] - at
    return {"doc": doc[at], "pos": at - w.first[doc[at]], "size": size, "anchor": grams[least_at[at]], "lo": least_at[at] - at, "at": at, "hash": text.windows(h, span, seed=2)}


def _key(text_column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text_column, F.lit("")))


def shared_anchors(documents: DataFrame, span: int) -> np.ndarray:
    """The filter of anchors that occur at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in text.doc_slices(b["text"]):
                keys, n = np.unique(phrases_of(buf, offs, span)["anchor"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    counted = documents.select("text").mapInArrow(runtime.lean(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return filters.build(counted.where("n > 1"), "anchor", filters.bits_for(documents, filters.ANCHORS))


_PHRASES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("phrase", pa.int64()), ("anchor", pa.int64()), ("lo", pa.int32()), ("windows", pa.binary())])


def candidate_phrases(documents: DataFrame, shared: Broadcast, span: int) -> DataFrame:
    """The phrases whose anchor passes the filter, with their windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b["doc_id"], b["key"].to_numpy()
            for lo, _, buf, offs in text.doc_slices(b["text"]):
                p = phrases_of(buf, offs, span)
                keep = filters.may_hold(shared.value, p["anchor"])
                doc, at, size = p["doc"][keep] + lo, p["at"][keep], p["size"][keep]
                if not len(at):
                    continue
                anchor, off = p["anchor"][keep], p["lo"][keep]
                upto = np.concatenate([[0], np.cumsum(size)])
                flat = p["hash"][np.arange(upto[-1]) + np.repeat(at - upto[:-1], size)]
                powers, _ = text.powers(int(size.max()) + 1)
                within = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
                phrase = text.mix(np.add.reduceat(flat * powers[within], upto[:-1]) + anchor + off.astype(np.uint64))
                windows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((upto * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.astype("<u8").tobytes())])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(keys[doc]), pa.array(p["pos"][keep].astype(np.int32)), pa.array(phrase.astype(np.int64)), pa.array(anchor.astype(np.int64)), pa.array(off.astype(np.int32)), windows], schema=_PHRASES)

    return documents.mapInArrow(runtime.lean(run, shared=(shared,)), "doc_id long, key long, pos int, phrase long, anchor long, lo int, windows binary")


def suffix_ranks(symbols: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each doubling level k, equal numbers for positions whose next 2**k symbols (up to their phrase's end) are equal.

    The numbers sort as the symbols do; the last level orders whole suffixes.
    """
    at = np.arange(len(symbols))
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    step, most = 1, int((end - at).max(initial=0))
    while step < most:
        r = ranks[-1]
        after = np.zeros(len(r), np.int64)
        more = at + step < end
        after[more] = r[at[more] + step] + 1
        ranks.append(np.unique(r * (len(r) + 1) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return ranks


def longest_matches(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many symbols from each position on, within its phrase, occur at another position too."""
    ranks = suffix_ranks(symbols, end)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        both = np.flatnonzero((x + (1 << k) <= end[a]) & (y + (1 << k) <= end[b]))
        same = both[ranks[k][x[both]] == ranks[k][y[both]]]
        common[same] += 1 << k
    longest = np.zeros(len(symbols), np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def factors(symbols: np.ndarray, offs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all phrases of a block: phrase, first symbol in it, symbols.

    ``times`` tells how often each phrase occurs; one that occurs again is a factor itself.
    """
    size = np.diff(offs)
    end = np.repeat(offs[1:], size)
    longest = longest_matches(symbols, end)
    again = np.repeat(times > 1, size)
    longest[again] = (end - np.arange(len(symbols)))[again]
    phrase, at = np.flatnonzero(size), offs[:-1][size > 0].copy()
    found = []
    while len(at):
        n = longest[at]
        hit = n > 0
        found.append(np.stack([phrase[hit], (at - offs[phrase])[hit], n[hit]]))
        at = at + np.maximum(n, 1)
        live = at < offs[phrase + 1]
        phrase, at = phrase[live], at[live]
    rows = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    return tuple(rows[:, np.lexsort((rows[1], rows[0]))])


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of some phrases on end, and where each phrase's begin."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    return np.frombuffer(column.buffers()[2], "<u8")[offs[0] : offs[-1]], offs - offs[0]


_FACTORS = "phrase long, first int, size int"


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; the factors of each phrase. A block ends where an anchor does."""

    def parsed(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        which, first, size = factors(*_windows(t["windows"].chunk(0)), t["n"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(t["phrase"].to_numpy()[which]), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], names=["phrase", "first", "size"])

    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= INDEXED:  # an anchor that goes on is taken along
            anchors = b["anchor"].to_numpy()
            cut = int(np.argmax(anchors != last)) if (anchors != last).any() else len(anchors)
            held.append(b.slice(0, cut))
            b = b.slice(cut)
            if not b.num_rows:
                continue
            yield parsed(pa.Table.from_batches(held))
            held, rows = [], 0
        held.append(b)
        rows += b.num_rows
        last = b["anchor"][b.num_rows - 1].as_py()
    if held:
        yield parsed(pa.Table.from_batches(held))


def _single_windows(shared: Broadcast):
    """A row for each window of each phrase whose anchor passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(filters.may_hold(shared.value, b["anchor"].to_numpy())))
            if not b.num_rows:
                continue
            flat, offs = _windows(b["windows"])
            size = np.diff(offs)
            row = pa.array(np.repeat(np.arange(len(size)), size))
            place = np.arange(len(flat)) - np.repeat(offs[:-1], size)
            yield pa.RecordBatch.from_arrays([b["phrase"].take(row), pa.array(place.astype(np.int32)), pa.array(flat.astype(np.int64)), b["n"].take(row)], names=["phrase", "first", "window", "n"])

    return run


def duplicate_windows(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, key, pos, size``: from window ``pos`` on, ``size`` windows that occur elsewhere.

    ``key`` is a hash of the text, so rows that share a ``doc_id`` stay apart.
    """
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    docs = documents.select("doc_id", "text", _key().alias("key"))
    flags = spark.sparkContext.broadcast(shared_anchors(docs, span))
    runtime.arrow_limits(spark)
    found = runtime.written(candidate_phrases(docs, flags, span), "phrases")
    flags.destroy()
    distinct = runtime.written(found.groupBy("phrase", "anchor", "lo", "windows").agg(F.count("*").alias("n")).select("phrase", "anchor", "windows", "n"), "distinct-phrases")
    hot = spark.sparkContext.broadcast(filters.build(distinct.groupBy("anchor").count().where(F.col("count") >= HOT), "anchor", 23))
    runtime.arrow_limits(spark, 4096)
    blocks = distinct.where(~filters.passes(hot, "anchor")).repartition("anchor").sortWithinPartitions("anchor")
    parsed = blocks.mapInArrow(runtime.lean(_parse_blocks), _FACTORS)
    single = runtime.reread(distinct).mapInArrow(runtime.lean(_single_windows(hot), shared=(hot,)), "phrase long, first int, window long, n long")
    again = single.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    counted = single.join(again.hint("merge"), "window").select("phrase", "first", F.lit(1).alias("size"))
    held = runtime.written(parsed.unionByName(counted), "factors")
    hot.destroy()
    runtime.discard(spark, distinct.shared_path)
    return found.select("doc_id", "key", "pos", "phrase").join(held.hint("merge"), "phrase").select("doc_id", "key", (F.col("pos") + F.col("first")).alias("pos"), "size")


def covered(n_words: int, parts: list[tuple[int, int]], span: int = SPAN) -> np.ndarray:
    """Which words of a document its duplicate windows (the first, and how many) cover."""
    edge = np.zeros(n_words + 1, np.int64)
    if parts:
        pos, size = np.array(parts).T
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + size - 1 + span, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words, as first word and end."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def split_by_parts(documents: DataFrame, span: int = SPAN) -> tuple[Broadcast, DataFrame, DataFrame, str, str]:
    """What tells rows with a flagged window apart: a filter and the rows with its key in a named column.

    Then the rows that may have one, with theirs (null if none) in another named
    column. Texts that the filter does not pass have no duplicate span and are
    never shuffled.
    """
    spark = documents.sparkSession
    name, own, key, left_id, left_key = runtime.fresh(documents, "parts", "own", "key", "left_id", "left_key")
    found = duplicate_windows(runtime.need(documents, "doc_id", "text"), span)
    # A set, since rows that are repeated give the same parts.
    parts = runtime.written(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "size")).alias("parts")), "spans")
    shared = spark.sparkContext.broadcast(filters.build(parts.select(F.xxhash64("doc_id", "key").alias("own")), "own", filters.bits_for(documents, filters.ROWS)))
    runtime.arrow_limits(spark)
    names = documents.columns
    rows = documents.withColumn(own, F.xxhash64("doc_id", _key()))
    asked = rows.where(filters.passes(shared, own)).select(*names, _key().alias(key))
    marks = parts.select(F.col("doc_id").alias(left_id), F.col("key").alias(left_key), F.col("parts").alias(name))
    joined = asked.join(marks.hint("merge"), asked["doc_id"].eqNullSafe(marks[left_id]) & (asked[key] == marks[left_key]), "left")
    return shared, rows, joined.select(*names, name), own, name


def _parts(column: pa.Array, i: int) -> list[tuple[int, int]]:
    return [(x["pos"], x["size"]) for x in column[i].as_py() or []]


def _kept(raw: bytes, parts: list[tuple[int, int]], span: int) -> tuple[list[bytes], int]:
    """Words that stay, and how many there were; bytes are split at the same blanks."""
    all_of = raw.split()
    if not parts:
        return all_of, len(all_of)
    mask = covered(len(all_of), parts, span)
    return [w for w, m in zip(all_of, mask.tolist(), strict=True) if not m], len(all_of)


def digests(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(b: pa.RecordBatch, parts_of) -> pa.RecordBatch:
        rows = []
        for i, t in enumerate(b["text"]):
            kept, n = _kept((t.as_py() or "").encode("utf-8", "surrogatepass"), parts_of(i), span)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return runtime.out_batch(schema, doc_id=b["doc_id"], n_words=[r[0] for r in rows], n_removed=[r[1] for r in rows], kept_sha256=[r[2] for r in rows])

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield digest(b.filter(pa.array(~filters.may_hold(shared.value, b[own].to_numpy()))), lambda i: [])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield digest(b, lambda i, b=b: _parts(b[parts], i))

    shared, rows, asked, own, parts = split_by_parts(runtime.need(documents, "doc_id", "text"), span)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return rows.mapInArrow(runtime.lean(certain, shared=(shared,)), kind).unionByName(asked.mapInArrow(runtime.lean(judged), kind))


def removed(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows with duplicate spans cut out of ``text``; other texts and columns stay as they are.

    A document of which a span is cut keeps its other words joined by one blank;
    one without words left stays, with an empty text.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i, t in enumerate(b["text"].to_pylist()):
                flagged = _parts(b[parts], i)
                texts.append(b" ".join(_kept(t.encode("utf-8", "surrogatepass"), flagged, span)[0]).decode("utf-8", "surrogatepass") if flagged else t)
            columns = [pa.array(texts, b.schema.field("text").type) if n == "text" else b[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shared, rows, asked, own, parts = split_by_parts(documents, span)
    return rows.where(~filters.passes(shared, own)).select(names).unionByName(asked.mapInArrow(runtime.lean(run), documents.schema))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(runtime.table(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE_SQL = {
    "op8_substring_dedup": r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    g AS (
      SELECT *, md5(string_agg(x, ' ') OVER s) AS h, count(*) OVER s AS n FROM u
      WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
    ),
    d AS (SELECT h FROM g WHERE n = 35 GROUP BY h HAVING count(*) > 1),
    f AS (SELECT g.doc_id, g.i, g.x, CASE WHEN g.n = 35 AND d.h IS NOT NULL THEN 1 ELSE 0 END AS starts FROM g LEFT JOIN d ON d.h = g.h),
    c AS (SELECT *, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f)
    SELECT t.doc_id, count(c.x) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
      sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
    FROM documents t LEFT JOIN c ON c.doc_id = t.doc_id GROUP BY t.doc_id
    """
}
