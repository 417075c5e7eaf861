"""Vectorised text kernels: words, hashes of words and of word windows.

Everything works on the UTF-8 bytes of an Arrow string array, in slices of
about half a megabyte, so memory stays bounded for any batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import runtime

SLICE_BYTES = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


@cache
def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


#: The base of all prefix hashes; one table of its powers serves words and windows.
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
runtime.KEPT["powers"] = _POWERS.clear


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS.clear()
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p, out=p))
    return _POWERS[0][:n], _POWERS[1][:n]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: which bytes belong to words."""
    word = np.ones(256, bool)
    for a, b in ranges:
        word[a : b + 1] = False
    return word


#: Words are runs of anything but blanks and the control characters 9 to 13.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of digits, lower-case letters and everything beyond ASCII.
ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def doc_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a text column; null counts as empty."""
    a = pc.fill_null(column, "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    n = len(a)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    offs = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + n + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    """Words of several documents: byte ranges, and where each document's begin."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # for each document and the end, the index of its first word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> Words:
    """Maximal runs of word bytes within each document."""
    n = len(buf)
    inside = word[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    edge = np.empty(n, bool)
    edge[:1] = True
    edge[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (edge | cut[:n]))
    edge[-1:] = True
    edge[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (edge | cut[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def word_hashes(buf: np.ndarray, w: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word."""
    p, q = powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_bytes_table(seed)[buf] * p[:-1], out=c[1:])
    return mix((c[w.ends] - c[w.starts]) * q[w.starts] + (w.ends - w.starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of every k consecutive word hashes; len(h) - k + 1 of them, document ends ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p, q = powers(len(h) + 1)
    c = np.empty(len(h) + 1, np.uint64)
    c[0] = 0
    np.cumsum(h * p[:-1], out=c[1:])
    return mix((c[k:] - c[:n]) * q[:n] + U(k) + U(seed * 0xD1B54A32D192ED03 & (2**64 - 1)))


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Which window starts (of ``windows``) stay within one document."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= end


@cache
def letters() -> np.ndarray:
    """A flag for each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of several texts, each run of other characters one 0; with offsets.

    Every text starts and ends with a 0, so grams know where words begin.
    """
    low = ["" if t is None else t.lower() for t in texts]
    joined = "\0" + "\0\0".join(low) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    offs = np.concatenate([[0], np.cumsum(size)])
    codes = np.where(letters()[codes], codes, np.uint32(0))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[offs[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], at[offs]


def gram_buckets(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, ascending, the hash bucket of the n-gram that starts at each code point.

    Those that would pass the end are filled up with zeros.
    """
    h = np.zeros(len(codes), np.uint64)
    padded = np.concatenate([codes, np.zeros(max(orders), codes.dtype)]).astype(np.uint64)
    for n in range(1, max(orders) + 1):
        h += padded[n - 1 : n - 1 + len(codes)]
        h *= U(0x9E3779B97F4A7C15)
        if n in orders:
            x = h ^ (h >> U(29))
            x *= U((0xBF58476D1CE4E5B9 + 2 * n) & (2**64 - 1))
            x >>= U(64 - bits)
            yield n, x.view(np.int64)


class Pool:
    """Words' ids on end, so that the ids of many words are gathered at once."""

    def __init__(self, kind: type = np.uint32) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, kind)
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = 0

    def __len__(self) -> int:
        return len(self.index)

    def numbers(self, words: list[str]) -> tuple[np.ndarray, list[str], int]:
        """Every word's number; the new words in the order of their numbers, and the first of these.

        The caller puts the new words' ids before it gathers.
        """
        which = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unknown, first = np.flatnonzero(which < 0).tolist(), len(self.index)
        asked = [words[i] for i in unknown]
        new = list(dict.fromkeys(asked))
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        which[unknown] = list(map(self.index.__getitem__, asked))
        return which, new, first

    def put(self, numbers: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """The ids (on end) of the words with these numbers, and how many each has."""
        while len(self.index) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[numbers] = self.used + np.cumsum(size) - size
        self.size[numbers] = size
        self.used += len(flat)

    def gather(self, which: np.ndarray, per_text: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many each text (of so many words) has."""
        size = self.size[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.at[which] - upto[:-1], size)]
        first = np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])
        return ids, np.diff(upto[first])
