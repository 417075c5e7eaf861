"""Range asymmetric numeral systems over integer symbols, static tables, numpy lanes.

A table of frequencies is shared by many blocks. Each block is coded on its own
by ``LANES`` interleaved states that share one stream of 32-bit words, so any
block can be decoded alone; checkpoints within it hold the states and the place
in the stream, so its parts can be decoded side by side as well. Blocks of equal
shape are coded together: every numpy call works on all lanes of all blocks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Interleaved states of a block; symbols of a block; steps between checkpoints.
LANES, BLOCK, STEP = 32, 1 << 16, 512
#: Bits of the frequencies' sum, and the states' lower bound.
SCALE, LOW = 18, 1 << 31
#: Blocks that are coded together.
TOGETHER = 64

U = np.uint64
_HEAD = struct.Struct("<4sIIQ")
_BLOCK = struct.Struct("<IIII")


class Corrupt(ValueError):
    """A checksum does not match."""


@dataclass
class Table:
    """Symbols that occur, their scaled frequencies, and where each one's range begins."""

    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(self.freq) else np.empty(0, np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids) if len(ids) else np.empty(0, np.int64)
        symbols = np.flatnonzero(counts)
        n = counts[symbols]
        if len(symbols) > 1 << (SCALE - 1):
            raise ValueError("more symbols than the table can hold")
        if not len(symbols):
            return cls(symbols.astype(np.uint32), np.empty(0, np.uint64))
        freq = np.maximum(1, (n * ((1 << SCALE) / n.sum())).astype(np.int64))
        left = (1 << SCALE) - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        while left:  # the most frequent symbols take what rounding left over, or give it
            step = np.zeros(len(freq), np.int64)
            if left > 0:
                step[order[0]] = left
            else:
                give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] // 16))
                upto = np.minimum(np.cumsum(give), -left)
                step[order] = -np.diff(upto, prepend=0)
            freq += step
            left = (1 << SCALE) - int(freq.sum())
        return cls(symbols.astype(np.uint32), freq.astype(np.uint64))

    def dump(self) -> bytes:
        return zlib.compress(np.diff(self.symbols.astype(np.int64), prepend=-1).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def load(cls, raw: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        n = len(both) // 2
        return cls((np.cumsum(both[:n]) - 1).astype(np.uint32), both[n:].astype(np.uint64))

    def slots(self) -> np.ndarray:
        """For each slot of the scale, the index of its symbol."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def _encode_group(rank: np.ndarray, table: Table) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Code rows of equal length (-1: padding at the end); for each its words, states and places at checkpoints."""
    blocks, steps = rank.shape[0], rank.shape[1] // LANES
    ranks = rank.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    out = np.zeros((steps, blocks, LANES), np.uint32)
    emitted = np.zeros((steps, blocks, LANES), bool)
    marks = [(steps - 1) // STEP + 1, blocks, LANES]
    states = np.zeros(marks, np.uint64)
    ragged = (rank[:, -LANES:] < 0).any() or (rank < 0).any()
    for t in range(steps - 1, -1, -1):
        r = ranks[:, t]
        on = r >= 0 if ragged else None
        if on is not None:
            r = np.maximum(r, 0)
        f, c = table.freq[r], table.start[r]
        over = (x >> U(63 - SCALE)) >= f
        if on is not None:
            over &= on
        out[t] = x.astype(np.uint32)  # the low 32 bits; only those marked count
        emitted[t] = over
        x = np.where(over, x >> U(32), x)
        q = x // f
        y = (q << U(SCALE)) + (x - q * f) + c
        x = y if on is None else np.where(on, y, x)
        if t % STEP == 0:
            states[t // STEP] = x
    found = []
    for b in range(blocks):
        mask = emitted[:, b]
        per = np.concatenate([[0], np.cumsum(mask.sum(1))])
        found.append((out[:, b][mask].astype("<u4").tobytes(), states[:, b], per[np.arange(0, steps, STEP)].astype(np.uint32)))
    return found


def encode(ids: np.ndarray, table: Table | None = None) -> bytes:
    """A self-contained stream: header, table, then blocks with checkpoints and checksums."""
    ids = np.ascontiguousarray(ids, np.uint32)
    table = table or Table.of(ids)
    rank_of = np.zeros(int(table.symbols[-1]) + 1 if len(table.symbols) else 1, np.int32)
    rank_of[table.symbols] = np.arange(len(table.symbols))
    head = table.dump()
    parts = [_HEAD.pack(b"RANS", len(head), zlib.crc32(head), len(ids)), head]
    for lo in range(0, len(ids), BLOCK * TOGETHER):
        group = ids[lo : lo + BLOCK * TOGETHER]
        full = len(group) // BLOCK
        pieces = [group[: full * BLOCK].reshape(full, BLOCK)] if full else []
        if len(group) % BLOCK:
            pieces.append(group[full * BLOCK :].reshape(1, -1))
        for rows in pieces:
            width = -(-rows.shape[1] // LANES) * LANES
            rank = np.full((rows.shape[0], width), -1, np.int32)
            rank[:, : rows.shape[1]] = rank_of[rows]
            for row, (words, states, places) in zip(rows, _encode_group(rank, table), strict=True):
                body = states.astype("<u8").tobytes() + places.astype("<u4").tobytes() + words
                parts += [_BLOCK.pack(len(row), len(words), zlib.crc32(body), zlib.crc32(row.astype("<u4").tobytes())), body]
    return b"".join(parts)


def block_index(raw: bytes) -> tuple[Table, int, list[tuple[int, int, int, int, int]]]:
    """The table, the number of symbols, and (place, symbols, bytes of words, two checksums) of each block."""
    magic, size, crc, total = _HEAD.unpack_from(raw)
    head = raw[_HEAD.size : _HEAD.size + size]
    if magic != b"RANS" or zlib.crc32(head) != crc:
        raise Corrupt("header")
    at, blocks, seen = _HEAD.size + size, [], 0
    while seen < total:
        n, words, c1, c2 = _BLOCK.unpack_from(raw, at)
        blocks.append((at + _BLOCK.size, n, words, c1, c2))
        steps = -(-n // LANES)
        at += _BLOCK.size + (-(-steps // STEP)) * (LANES * 8 + 4) + words
        seen += n
    return Table.load(head), total, blocks


def _decode_units(table: Table, slots: np.ndarray, states: np.ndarray, words: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Decode parts of blocks side by side: a row of STEP * LANES symbol ranks for each."""
    n = len(words)
    size = np.array([len(w) for w in words])
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    stream = np.concatenate([*words, np.zeros(LANES, "<u4")]).astype(np.uint64)
    steps = int(-(-counts.max() // LANES))
    out = np.empty((n, steps, LANES), np.uint32)
    x, at = states.copy(), base.astype(np.int64)
    lane = np.arange(LANES)
    even = int(counts.min()) // LANES
    for t in range(steps):
        slot = x & U((1 << SCALE) - 1)
        s = slots[slot.astype(np.int64)]
        y = table.freq[s] * (x >> U(SCALE)) + slot - table.start[s]
        low = y < U(LOW)
        if t >= even:
            on = t * LANES + lane[None, :] < counts[:, None]
            y = np.where(on, y, x)
            low &= on
        which = np.cumsum(low, 1)
        w = stream[np.minimum(at[:, None] + which - low, len(stream) - 1)]
        x = np.where(low, (y << U(32)) | w, y)
        at += which[:, -1]
        out[:, t] = s
    return out.reshape(n, -1)


def decode(raw: bytes, only: slice = slice(None)) -> np.ndarray:
    """The symbols of the stream, or of some of its blocks; all checksums are verified."""
    table, _, blocks = block_index(raw)
    slots, found = table.slots(), []
    blocks = blocks[only]
    for lo in range(0, len(blocks), TOGETHER):
        states, words, counts, whole = [], [], [], []
        for at, n, size, c1, c2 in blocks[lo : lo + TOGETHER]:
            marks = -(-(-(-n // LANES)) // STEP)
            end = at + marks * (LANES * 8 + 4) + size
            if zlib.crc32(raw[at:end]) != c1:
                raise Corrupt("block")
            states.append(np.frombuffer(raw, "<u8", marks * LANES, at).reshape(marks, LANES))
            places = np.frombuffer(raw, "<u4", marks, at + marks * LANES * 8).astype(np.int64)
            stream = np.frombuffer(raw, "<u4", size // 4, end - size)
            words += [stream[a:b] for a, b in zip(places, [*places[1:], len(stream)], strict=True)]
            counts += [min(STEP * LANES, n - k * STEP * LANES) for k in range(marks)]
            whole.append((marks, c2))
        ranks = _decode_units(table, slots, np.concatenate(states), words, np.array(counts))
        k = 0
        for marks, c2 in whole:
            ids = table.symbols[np.concatenate([ranks[i, : counts[i]] for i in range(k, k + marks)])]
            if zlib.crc32(ids.astype("<u4").tobytes()) != c2:
                raise Corrupt("symbols")
            found.append(ids)
            k += marks
    return np.concatenate(found) if found else np.empty(0, np.uint32)
