"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

One pass over the characters moves the automaton; at each position the pieces
that end there are found by following output links, and each relaxes the best
score of the position. Of equal scores the one with the longer last piece wins.
Characters that no piece covers become byte pieces.

A piece has the blank mark only in front, so a text falls apart where a blank
follows another character; such words are solved side by side, one lane each,
and remembered.

Rows: null and empty texts have no ids. A literal blank mark (U+2581) becomes
byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import runtime, text

MARK = "▁"
#: How much worse than the worst piece an uncovered character is.
UNKNOWN_PENALTY = 10.0
#: Words that are remembered at most; cells of a Viterbi table at most; lanes under which plain Python is faster.
MEMORY, CELLS, FEW = 250_000, 1 << 20, 6
#: Stands for a literal mark within a word: a private code point is not enough, so one beyond Unicode is used.
_LITERAL = 0x110000


@dataclass
class Vocabulary:
    """Pieces with scores, the byte pieces' ids, and every id's bytes when decoded."""

    pieces: list[tuple[str, int, float]]  # text, id, score of those that match text
    byte_ids: np.ndarray
    raw: list[bytes]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, raw = [], np.full(256, -1, np.int64), []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                pieces.append((p, i, sp.get_score(i)))
                raw.append(p.replace(MARK, " ").encode())
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in pieces):
            raise ValueError("a piece has the blank mark after another character")
        return cls(pieces, byte_ids, raw)


class Automaton:
    """Goto, failure and output links over the pieces, as arrays."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        step: list[dict[int, int]] = [{}]
        piece = [-1]
        for k, (p, _, _) in enumerate(vocabulary.pieces):
            s = 0
            for c in map(ord, p):
                if (t := step[s].get(c)) is None:
                    t = step[s][c] = len(step)
                    step.append({})
                    piece.append(-1)
                s = t
            piece[s] = k
        n = len(step)
        fail, link = [0] * n, [0] * n
        todo = deque(step[0].values())
        while todo:
            s = todo.popleft()
            f = fail[s]
            link[s] = f if piece[f] >= 0 else link[f]
            for c, t in step[s].items():
                g = f
                while g and c not in step[g]:
                    g = fail[g]
                fail[t] = step[g].get(c, 0) if s else 0
                todo.append(t)
        self.step, self.fail, self.link, self.piece = step, np.array(fail), np.array(link), np.array(piece)
        self.size = np.array([len(p) for p, _, _ in vocabulary.pieces])
        self.score = np.array([x for _, _, x in vocabulary.pieces])
        self.id = np.array([i for _, i, _ in vocabulary.pieces])
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        pairs = sorted((s << 21 | c, t) for s, d in enumerate(step) for c, t in d.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([t for _, t in pairs], np.int64)
        self.head = np.where(self.piece >= 0, np.arange(n), self.link)  # where the chain of pieces that end here begins

    def one(self, codes: list[int]) -> list[int]:
        """Piece numbers of one word, -1 for an uncovered character; plain Python."""
        best, back, s = [0.0], [-1], 0
        step, fail, head, link, piece = self.step, self.fail, self.head, self.link, self.piece
        for t, c in enumerate(codes):
            while s and c not in step[s]:
                s = int(fail[s])
            s = step[s].get(c, 0)
            top, which, single, e = -np.inf, -1, False, int(head[s])
            while e:
                k = int(piece[e])
                size = int(self.size[k])
                single |= size == 1
                if (x := best[t + 1 - size] + float(self.score[k])) > top:
                    top, which = x, k
                e = int(link[e])
            if not single and (x := best[t] + self.unknown) > top:
                top, which = x, -1
            best.append(top)
            back.append(which)
        found, at = [], len(codes)
        while at:
            found.append(back[at])
            at -= int(self.size[back[at]]) if back[at] >= 0 else 1
        return found[::-1]

    def lanes(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Piece numbers of many words, given as rows of code points that are longest first.

        Rows are filled from the right; -2 stands before them.
        """
        n, width = codes.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.full((n, width + 1), -1, np.int32)
        state = np.zeros(n, np.int64)
        rows = np.arange(n)
        for t in range(width):
            live = int(np.searchsorted(-sizes, -t, "left"))  # words longer than t
            s, c = state[:live].copy(), codes[:live, t]
            todo = rows[:live]
            while len(todo):
                key = s[todo] << 21 | c[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                root = s[todo] == 0
                s[todo[hit]] = self.to[at[hit]]
                todo = todo[~hit & ~root]
                s[todo] = self.fail[s[todo]]
            state[:live] = s
            top, which, single = np.full(live, -np.inf), np.full(live, -1, np.int32), np.zeros(live, bool)
            e = self.head[s]
            todo = np.flatnonzero(e)
            e = e[todo]
            while len(todo):
                k = self.piece[e]
                size = self.size[k]
                x = best[todo, t + 1 - size] + self.score[k]
                better = x > top[todo]
                top[todo[better]] = x[better]
                which[todo[better]] = k[better]
                single[todo[size == 1]] = True
                e = self.link[e]
                more = e > 0
                todo, e = todo[more], e[more]
            x = best[:live, t] + self.unknown
            lost = ~single & (x > top)
            best[:live, t + 1] = np.where(lost, x, top)
            back[:live, t + 1] = np.where(lost, -1, which)
        at, out = sizes.copy(), np.full((n, width), -2, np.int32)
        todo, column = rows, width - 1
        while len(todo):
            k = back[todo, at[todo]]
            out[todo, column] = k
            at[todo] -= np.where(k >= 0, self.size[k], 1)
            todo = todo[at[todo] > 0]
            column -= 1
        return out


class Codec:
    """Encoder and decoder with remembered words."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.pool = text.Pool(np.int32)

    def _ids(self, word: str, pieces: np.ndarray | list[int]) -> np.ndarray:
        a = self.automaton
        pieces = np.asarray(pieces, np.int64)
        if (pieces >= 0).all():
            return a.id[pieces].astype(np.int32)
        ids, at = [], 0
        for k in pieces.tolist():
            if k >= 0:
                ids.append(int(a.id[k]))
                at += int(a.size[k])
            else:
                ids += [int(a.vocabulary.byte_ids[b]) for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
        return np.array(ids, np.int32)

    def _codes(self, word: str) -> list[int]:
        """Code points; blanks at the front are the mark, literal marks match nothing."""
        front = len(word) - len(word.lstrip(" "))
        return [ord(MARK)] * front + [_LITERAL if c == MARK else ord(c) for c in word[front:]]

    def _learn(self, words: list[str], first: int) -> None:
        """Solve new words, whose numbers begin at ``first``."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        lo = 0
        while lo < len(words):
            width = int(size[lo])
            hi = min(len(words), lo + max(1, CELLS // (width + 1)))
            if width > 48:  # rows of about one length keep the table full
                hi = max(lo + 1, min(hi, int(np.searchsorted(-size, -(width // 2), "left"))))
            group = order[lo:hi]
            if len(group) < FEW or width > 4096:
                group = group[: FEW - 1]
                each = [self._ids(words[i], self.automaton.one(self._codes(words[i]))) for i in group]
                self.pool.put(first + group, np.concatenate(each), np.array([len(x) for x in each]))
            else:
                self._solve(words, group, first)
            lo += len(group)

    def _solve(self, words: list[str], group: np.ndarray, first: int) -> None:
        """Learn words, longest first, side by side."""
        a = self.automaton
        part = [words[i] for i in group]
        size = np.array([len(w) for w in part])
        flat = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        flat[flat == ord(MARK)] = _LITERAL
        blank = flat == ord(" ")  # a word has blanks in front only
        flat[blank] = ord(MARK)
        codes = np.zeros((len(part), int(size[0])), np.int64)
        codes[np.repeat(np.arange(len(part)), size), np.arange(len(flat)) - np.repeat(begin, size)] = flat
        pieces = a.lanes(codes, size)
        odd = (pieces == -1).any(1)
        plain = pieces[~odd]
        there = plain >= 0
        self.pool.put(first + group[~odd], a.id[plain[there]], there.sum(1))
        for i in np.flatnonzero(odd):
            ids = self._ids(part[i], pieces[i][pieces[i] > -2])
            self.pool.put(np.array([first + group[i]]), ids, np.array([len(ids)]))

    @staticmethod
    def cut(t: str) -> list[str]:
        """A text with its blank in front, as words that no piece crosses."""
        if not t:
            return []
        if "  " in t or t[0] == " " or t[-1] == " ":
            return re.findall(r" +[^ ]*", " " + t)
        return (" " + t.replace(" ", "\x00 ")).split("\x00") if "\x00" not in t else re.findall(r" +[^ ]*", " " + t)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has."""
        if len(self.pool) > MEMORY:
            self.pool = text.Pool(np.int32)
        parts = [self.cut(t or "") for t in texts]
        which, new, first = self.pool.numbers([w for p in parts for w in p])
        if new:
            self._learn(new, first)
        return self.pool.gather(which, [len(p) for p in parts])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, n = self.encode_flat(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids."""
        return b"".join(map(self.automaton.vocabulary.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def codec_of(shared) -> Codec:
    """This worker's codec for a broadcast automaton."""
    held = codec_of.__dict__
    if shared.id not in held:
        held.clear()
        held[shared.id] = Codec(shared.value)
    return held[shared.id]


runtime.KEPT["pieces"] = codec_of.__dict__.clear


class _Shared:
    """A broadcast automaton with a name that stays equal between tasks."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.broadcast = spark.sparkContext.broadcast(Vocabulary.load(path))
        self.id = f"{spark.sparkContext.applicationId}-{self.broadcast._jbroadcast.id()}"

    def __getstate__(self) -> dict:
        return self.__dict__

    @property
    def value(self) -> Automaton:
        return Automaton(self.broadcast.value)


def encode(documents: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text, in one narrow pass."""
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    shared = _Shared(spark, model)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            for lo, hi, _, _ in text.doc_slices(b["text"]):
                flat, n = codec.encode_flat(b["text"].slice(lo, hi - lo).to_pylist())
                upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield runtime.out_batch(schema, doc_id=b["doc_id"].slice(lo, hi - lo), ids=pa.ListArray.from_arrays(pa.array(upto), pa.array(flat, pa.int32())))

    return runtime.need(documents, "doc_id", "text").mapInArrow(runtime.lean(run, "pieces"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` from the ids that ``encode`` gave."""
    spark = encoded.sparkSession
    runtime.arrow_limits(spark)
    shared = _Shared(spark, model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.broadcast.value.raw
        for b in batches:
            texts, held, lo = [], 0, 0
            for i, ids in enumerate(b["ids"]):
                t = b"".join(map(raw.__getitem__, ids.values.to_pylist() if ids.is_valid else [])).decode("utf-8", "surrogatepass")[1:]
                texts.append(t)
                held += len(t)
                if held > text.SLICE_BYTES or i == b.num_rows - 1:
                    yield runtime.out_batch(schema, doc_id=b["doc_id"].slice(lo, len(texts)), text=texts)
                    texts, held, lo = [], 0, i + 1

    return runtime.need(encoded, "doc_id", "ids").mapInArrow(runtime.lean(run), "doc_id long, text string")


def digests(documents: DataFrame, model: str) -> DataFrame:
    """Encode and decode every whole text: ids' number and checksum, and whether the text came back."""
    spark = documents.sparkSession
    runtime.arrow_limits(spark)
    shared = _Shared(spark, model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            for lo, hi, _, _ in text.doc_slices(b["text"]):
                texts = b["text"].slice(lo, hi - lo).to_pylist()
                found = codec.encode(texts)
                yield runtime.out_batch(
                    schema, doc_id=b["doc_id"].slice(lo, hi - lo), n_pieces=[len(x) for x in found],
                    ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in found],
                    round_trip=[codec.decode(x) == (t or "") for x, t in zip(found, texts, strict=True)],
                )

    return runtime.need(documents, "doc_id", "text").mapInArrow(runtime.lean(run, "pieces"), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
