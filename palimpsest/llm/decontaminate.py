"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Words are runs of letters and digits, A-Z lower-cased. An item of L words leaks
into a document if a window of L words (the whole document, if it is shorter) is
within floor(L * ``RATE``) word edits of it.

1. An item is cut into one block more than its edits allow, so a leaking window
   holds a block unchanged. A fixed-size filter over the blocks' hashes tells which
   windows of an item's length are embedded: those that start within the allowed
   edits of where a block puts them. It names no items and loses no leak.
2. A random walk (CGK) embeds windows and items: each step writes the current
   word and moves on by a random bit of it, so a small edit distance becomes a
   small Hamming distance. ``WALKS`` walks times ``tables(L)`` tables sample the
   words at a few steps; the samples' hash is a key. The items whose key a window
   has are its candidates, and no others are.
3. The exact edit distance decides candidates, after bounds by bitmaps of the words
   and by the words that the item has not. Around each leak found, the windows within the item's edits are
   decided too, so that the best one is told.

Recall: an item at its limit of edits, spread evenly or at random, is found with a
chance above 0.95 at any length up to 400 words (``tests/llm`` measures it against
the exact distance of all windows); longer items sample one step a table. Windows
are embedded, and candidates decided, ``CELLS`` words or ``PAIRS`` pairs at a time,
however many items share a phrase and however often a document repeats it.

Rows: null and empty texts hold nothing, nor does an item without words. Equal
items match apart, each copy of a repeated row as well. Of an item's windows in a row, the one with the fewest edits
counts, of equal ones the first. Rows that repeat a ``doc_id`` each give rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, text

RATE = 0.2
#: Walks over each window, and steps of a walk for each word of an item.
WALKS, STEPS = 8, 2
#: Items of one broadcast, and characters of them; more items take further passes.
ITEMS, ITEM_CHARS = 20_000, 32 << 20
#: Bits of the words' bitmap of a window or an item.
BITS = 512
#: Windows that are embedded together, words of windows that are compared together, and pairs that are listed together
#: (a single window may have more).
TOGETHER, CELLS, PAIRS = 4_000, 500_000, 1_000_000

U = np.uint64


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = text.LOWER[buf]
    w = text.words(low, offs, text.ALNUM)
    return text.word_hashes(low, w, seed=9), w.first


def word_keys(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A key for each word (hash) as a word of an item."""
    return text.mix(h ^ (item.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))


def tables(size: int) -> tuple[int, int]:
    """Tables of a walk over so many words, and sampled steps of each: longer walks agree in fewer steps."""
    return (16, 2) if size <= 160 else (48, 2) if size <= 400 else (16, 1)


@dataclass
class Items:
    """Benchmark items as word hashes, with the index of their blocks and of their keys."""

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    sizes: np.ndarray
    reach: dict[int, int] = field(default_factory=dict)  # edits by item length
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by item length: hash, place
    flags: dict[int, np.ndarray] = field(default_factory=dict)  # by block size
    of_size: dict[int, np.ndarray] = field(default_factory=dict)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by item length: key, place in of_size
    marks: dict[int, np.ndarray] = field(default_factory=dict)  # by item length: a bitmap of each item's words
    held: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # keys of each item's words, sorted

    @classmethod
    def of(cls, ids: list, texts: list[str | None], rate: float = RATE) -> Items:
        kept_ids, words = [], []
        for i, t in zip(ids, texts, strict=True):
            raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
            h, _ = _words(raw, np.array([0, len(raw)]))
            if len(h):
                kept_ids.append(i)
                words.append(h)
        sizes = np.array([len(h) for h in words], np.int64)
        out = cls(kept_ids, words, (sizes * rate + 1e-9).astype(np.int64), sizes)
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            edits = out.reach[size] = int(out.edits[which[0]])
            k = size // (edits + 1)
            rows = np.stack([words[i] for i in which])
            place = np.arange(edits + 1) * k
            block = np.concatenate([text.windows(r, k, seed=9)[place] for r in rows])
            pairs = np.unique(np.rec.fromarrays([block, np.tile(place, len(rows))]))
            out.blocks[size] = pairs.f0.copy(), pairs.f1.copy()
            out.flags.setdefault(k, np.zeros(1 << 21, bool))[(block >> U(43)).astype(np.int64)] = True
            found = []
            for lo in range(0, len(rows), TOGETHER):
                row, key = keys_of(rows[lo : lo + TOGETHER])
                found.append((key, (lo + row).astype(np.int32)))
            key, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            out.keys[size] = key[order], item[order]
            out.of_size[size] = which
            out.marks[size] = bitmaps(rows, np.full(len(rows), size))
        if words:
            out.held = np.unique(word_keys(np.concatenate(words), np.repeat(np.arange(len(words)), sizes)))
        return out


def starts_of(h: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of items, the starts of windows that hold a block of such an item within its edits of its place."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, flags in items.flags.items():
        grams = text.windows(h, k, seed=9)
        hit = np.flatnonzero(flags[(grams >> U(43)).astype(np.int64)])
        hit = hit[doc[hit] == doc[hit + k - 1]] if len(hit) else hit
        hits[k] = hit, grams[hit]
    for size, (keys, place) in items.blocks.items():
        edits = items.reach[size]
        hit, gram = hits[size // (edits + 1)]
        lo, hi = np.searchsorted(keys, gram, "left"), np.searchsorted(keys, gram, "right")
        hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(hit):
            continue
        turn = np.zeros(len(h) + 1, np.int64)
        step = max(1, PAIRS // (edits + 1))
        for a in range(0, len(hit), step):
            at, m = hit[a : a + step], n[a : a + step]
            row = np.repeat(lo[a : a + step], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(at, m)
            begin, end = first[doc[at]], first[doc[at] + 1]
            last = np.maximum(begin, end - size)
            start = at - place[row]
            turn += np.bincount(np.clip(start - edits, begin, last), minlength=len(turn))
            turn -= np.bincount(np.clip(start + edits, begin, last) + 1, minlength=len(turn))
        yield size, np.flatnonzero(np.cumsum(turn[:-1]) > 0)


def padded(h: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of words from each start on, zero beyond each size."""
    column = np.arange(width)
    at = start[:, None] + column
    return np.where(column < size[:, None], h[np.minimum(at, len(h) - 1)], U(0))


def walk(rows: np.ndarray, seed: int) -> np.ndarray:
    """One CGK walk over each row: ``STEPS`` steps for each word of its width; past the end it writes zeros."""
    n, width = rows.shape
    steps = STEPS * width
    salt = np.random.default_rng(seed).integers(1, 2**63, steps, dtype=np.uint64)
    ends = np.concatenate([rows, np.zeros((n, 1), np.uint64)], 1)
    i, line = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), np.uint64)
    for j in range(steps):
        x = ends[line, i]
        out[:, j] = x
        y = (x ^ salt[j]) * U(0x9E3779B97F4A7C15)
        i = np.minimum(i + (y >> U(63)).astype(np.int64), width)
    return out


def keys_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each table of each walk; a table that saw a row's end alone gives none."""
    n, size = rows.shape
    count, samples = tables(size)
    at, keys = [], []
    for r in range(WALKS):
        steps = (np.random.default_rng(2000 + r).random((count, samples)) * STEPS * size).astype(np.int64)
        seen = walk(rows, 1000 + r)
        key = np.broadcast_to(np.arange(r * count, (r + 1) * count, dtype=np.uint64), (n, count))
        some = np.zeros((n, count), bool)
        for j in range(samples):
            x = seen[:, steps[:, j]]
            some |= x != 0
            key = text.mix(key * U(0x9E3779B97F4A7C15) + x)
        row, table = np.nonzero(some)
        at.append(row)
        keys.append(key[row, table])
    return np.concatenate(at), np.concatenate(keys)


def bitmaps(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``BITS`` bits for each row, set by its words. A bit that one row has and another has not is an edit."""
    bits = np.zeros((len(rows), BITS), bool)
    line, column = np.nonzero(np.arange(rows.shape[1]) < own[:, None])
    bits[line, (rows[line, column] >> U(33)) % U(BITS)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def candidates(h: np.ndarray, first: np.ndarray, doc: np.ndarray, size: int, starts: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and item of windows of a length that share a key, each pair once, in pieces, but for those whose bitmaps are too different."""
    held, item = items.keys[size]
    marks, reach = items.marks[size], items.reach[size]
    together = max(1, min(TOGETHER, CELLS // (STEPS * size)))
    for a in range(0, len(starts), together):
        s = starts[a : a + together]
        own = np.minimum(size, first[doc[s] + 1] - s)
        rows = padded(h, s, own, size)
        row, key = keys_of(rows)
        lo = np.searchsorted(held, key, "left")
        hit = held[np.minimum(lo, len(held) - 1)] == key
        if not hit.any():
            continue
        seen = bitmaps(rows, own)
        order = np.argsort(row[hit], kind="stable")
        row, key, lo = (x[hit][order] for x in (row, key, lo))
        n = np.searchsorted(held, key, "right") - lo
        total = np.concatenate([[0], np.cumsum(n)])
        begins = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))  # of each window's keys
        most = max(1, 4 * PAIRS // len(marks))
        b = 0
        while b < len(begins) - 1:
            c = min(max(b + 1, int(np.searchsorted(total[begins], total[begins[b]] + PAIRS, "right")) - 1), b + most)
            x, y = begins[b], begins[c]
            m = n[x:y]
            at = np.repeat(lo[x:y], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            met = np.zeros((c - b, len(marks)), bool)
            met[np.repeat(np.repeat(np.arange(c - b), np.diff(begins[b : c + 1])), m), item[at]] = True
            window, k = np.nonzero(met)
            window = row[begins[b:c]][window]
            b = c
            least = np.zeros((2, len(k)), np.int64)
            for j in range(marks.shape[1]):
                ours, theirs = seen[window, j], marks[k, j]
                least[0] += np.bitwise_count(ours & ~theirs)
                least[1] += np.bitwise_count(theirs & ~ours)
            can = least.max(0) <= reach
            if can.any():
                yield s[window[can]], items.of_size[size][k[can]]


def edit_distance(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs of rows with given lengths, all pairs at once."""
    width = b.shape[1]
    column = np.arange(width + 1)
    row = np.broadcast_to(column, (len(na), width + 1)).copy()
    out = nb.astype(np.int64).copy()
    for i in range(a.shape[1]):
        change = row[:, :-1] + (a[:, i : i + 1] != b)
        nxt = np.empty_like(row)
        nxt[:, 0] = i + 1
        nxt[:, 1:] = np.minimum(change, row[:, 1:] + 1)
        row = np.minimum.accumulate(nxt - column, axis=1) + column
        done = na == i + 1
        out[done] = row[done, nb[done]]
    return out


def least_edits(a: np.ndarray, own: np.ndarray, k: np.ndarray, size: np.ndarray, items: Items) -> np.ndarray:
    """A lower bound of each window's distance to its item: words that the item has not, or the missing length."""
    keys = word_keys(a, k[:, None])
    at = np.minimum(np.searchsorted(items.held, keys), len(items.held) - 1)
    inside = np.arange(a.shape[1]) < own[:, None]
    return np.maximum((inside & (items.held[at] != keys)).sum(1), size - own)


def decided(h: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Document, item, start and distance of the pairs of windows and items (of one length) that are within the item's edits."""
    size = int(items.sizes[item[0]])
    kept = [np.empty((4, 0), np.int64)]
    step = max(1, CELLS // size)
    for lo in range(0, len(start), step):
        s, k = start[lo : lo + step], item[lo : lo + step]
        d = doc[s]
        own = np.minimum(size, first[d + 1] - s)
        a = padded(h, s, own, size)
        can = least_edits(a, own, k, np.full(len(k), size), items) <= items.edits[k]
        if can.any():
            s, k, d, own, a = s[can], k[can], d[can], own[can], a[can]
            which, row = np.unique(k, return_inverse=True)
            e = edit_distance(a, own, np.stack([items.words[i] for i in which])[row], np.full(len(k), size))
            ok = e <= items.edits[k]
            kept.append(np.stack([d[ok], k[ok], s[ok], e[ok]]))
    return best_of(np.concatenate(kept, axis=1))


def best_of(rows: np.ndarray) -> np.ndarray:
    """For each document and item the window with the fewest edits, of equal ones the first."""
    rows = rows[:, np.lexsort((rows[2], rows[3], rows[1], rows[0]))]
    best = np.ones(rows.shape[1], bool)
    best[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return rows[:, best]


def leaks_in(h: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Document, item, start in the document and distance of each leak."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kept = [np.empty((4, 0), np.int64)]
    for size, starts in starts_of(h, first, items):
        found = np.empty((4, 0), np.int64)
        for s, k in candidates(h, first, doc, size, starts, items):
            found = best_of(np.concatenate([found, decided(h, first, doc, s, k, items)], axis=1))
        # The windows around each leak, some leaks at a time.
        reach = items.reach[size]
        shift = np.arange(-reach, reach + 1)
        for lo in range(0, found.shape[1] if reach else 0, max(1, PAIRS // len(shift))):
            d, k, s, _ = found[:, lo : lo + max(1, PAIRS // len(shift))]
            begin, last = first[d], np.maximum(first[d], first[d + 1] - size)
            near = np.clip(s[:, None] + shift, begin[:, None], last[:, None])
            code = np.unique(near.ravel() * len(items.ids) + np.repeat(k, len(shift)))
            kept.append(decided(h, first, doc, code // len(items.ids), code % len(items.ids), items))
        kept.append(found)
    rows = best_of(np.concatenate(kept, axis=1))
    rows[2] -= first[rows[0]]
    return tuple(rows)


def item_parts(benchmark: DataFrame) -> Iterator[Items]:
    """All items, in parts small enough to be broadcast; an item that is repeated is one, with its number of copies."""
    rows = runtime.need(benchmark, "item_id", "text").where("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-chars // ITEM_CHARS))
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield Items.of([(r["item_id"], r["copies"]) for r in own], [r["text"] for r in own])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start_word, edits``: every item that leaks into a document, in narrow passes."""
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("edits", pa.int64())])
    out = None
    for items in item_parts(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, _, buf, offs in text.doc_slices(b["text"], 2 * text.SLICE_BYTES):
                    d, k, s, e = leaks_in(*_words(buf, offs), shared.value)
                    for a in range(0, len(d), PAIRS):
                        ids, copies = zip(*(shared.value.ids[i] for i in k[a : a + PAIRS].tolist()), strict=True)
                        row = np.repeat(np.arange(len(ids)), copies)
                        at = pa.array(row)
                        yield runtime.out_batch(schema, doc_id=b["doc_id"].take(pa.array(d[a : a + PAIRS] + lo)).take(at), item_id=pa.array(ids, pa.int64()).take(at), start_word=s[a : a + PAIRS][row], edits=e[a : a + PAIRS][row])

        found = runtime.need(documents, "doc_id", "text").mapInArrow(runtime.lean(run), "doc_id long, item_id long, start_word long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns kept, into which no item leaks; nothing is shuffled."""
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    out = documents
    for items in item_parts(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, buf, offs in text.doc_slices(b["text"], 2 * text.SLICE_BYTES):
                    keep[leaks_in(*_words(buf, offs), shared.value)[0] + lo] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(runtime.lean(run), documents.schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE_SQL: dict[str, str] = {}
