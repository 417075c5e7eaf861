"""Token ids in binary files, coded with range asymmetric numeral systems.

Documents are dealt by ranges of ``doc_id``; each task tokenizes its range in
order and writes files of a bounded number of ids: a header with the documents'
ids and lengths, then a stream of ``rans`` whose frequency table all blocks of
the file share. Files get their final name by a rename, so a task that runs
twice leaves the same files; a manifest table names those that count.

Rows: a null text is an empty one and has the end id only. Rows that repeat a
``doc_id`` (or lack it; those come first) are kept; very many of them are dealt to
several tasks, and within a task they are ordered by their text. An empty table
makes no file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans, runtime, text

#: The id that ends each document, and ids of a file at most (longer documents get a file of their own).
END_ID, FILE_IDS = 1, 4 << 20
#: Parts into which rows of one id are dealt.
SALTS = 256
#: Words that the encoder remembers at most.
MEMORY = 700_000

_FILE = struct.Struct("<4sIQ")


class WordEncoder:
    """A tokenizer whose tokens never cross blanks, with the ids of text parts remembered.

    Texts of plain Latin letters are cut into the tokenizer's own pre-tokens,
    lower-cased as it does; others are cut at blanks. A part's ids are those the
    library gives it. Pre-tokens are sent to it many in one text, where the
    vocabulary's end-of-word mark tells them apart.
    """

    #: Characters for which the pattern below cuts as the tokenizer does: none beyond Latin Extended-A,
    #: nor the dotted capital I, which lower-cases to two.
    _OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]")
    _LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
    _NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
    _BLANK = "\t-\r \x85\xa0"
    _PART = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for w, i in vocab.items():
            self.ends[i] = w.endswith("</w>")
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.pool = text.Pool()

    def _plain(self, t: str) -> bool:
        """Is the text cut as the tokenizer does?"""
        return (t.isascii() or not self._OTHER.search(t)) and not any(x in t for x in self.special)

    def _cut(self, t: str, plain: bool) -> list[str]:
        if plain:
            return self._PART.findall(t.lower())
        return [w for w in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]

    def _learn(self, words: list[str], first: int, plain: bool) -> None:
        """Send new words to the library; ``plain`` ones are a pre-token each."""
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            groups = [part[i : i + 500] for i in range(0, len(part), 500)]
            for k, (group, e) in enumerate(zip(groups, self.lib.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True)):
                ids = np.array(e.ids, np.uint32)
                size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                whole = plain or not (any(" " in w for w in group) or any(len(self._PART.findall(w.lower())) != 1 for w in group if not w.isalpha()))
                if not whole or len(size) != len(group) or size.sum() != len(ids):
                    each = [x.ids for x in self.lib.encode_batch_fast(group, add_special_tokens=False)]
                    size, ids = np.array([len(x) for x in each]), np.array([i for x in each for i in x], np.uint32)
                at = first + lo + 500 * k
                self.pool.put(np.arange(at, at + len(group)), ids, size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        if len(self.pool) > MEMORY:
            self.pool = text.Pool()
        plain = [self._plain(t) for t in texts]
        cut = [self._cut(t, p) for t, p in zip(texts, plain, strict=True)]
        which, new, first = self.pool.numbers(list(chain.from_iterable(cut)))
        if new:
            self._learn(new, first, all(plain))
        return self.pool.gather(which, [len(ws) for ws in cut])


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


runtime.KEPT["tokens"] = encoder.cache_clear


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents' ids (with a flag for null) and lengths, then the coded ids."""
    known = np.array([i is not None for i in doc_ids], np.uint8)
    head = zlib.compress(np.array([i or 0 for i in doc_ids], "<i8").tobytes() + known.tobytes() + np.asarray(counts).astype("<u4").tobytes(), 6)
    return _FILE.pack(b"PTOK", len(head), len(doc_ids)) + head + rans.encode(ids)


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What ``pack`` was given."""
    magic, size, n = _FILE.unpack_from(raw)
    if magic != b"PTOK":
        raise rans.Corrupt("file")
    head = zlib.decompress(raw[_FILE.size : _FILE.size + size])
    known = np.frombuffer(head, np.uint8, n, 8 * n)
    doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(head, "<i8", n), known, strict=True)]
    return doc_ids, np.frombuffer(head, "<u4", n, 9 * n), rans.decode(raw[_FILE.size + size :])


def write_file(folder: str, name: str, raw: bytes) -> str:
    """Write below a folder of the shared store, under its final name only when complete."""
    store, path = runtime.filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(raw)
    store.move(temporary, f"{path}/{name}")
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    store, path = runtime.filesystem(uri)
    with store.open_input_stream(path) as f:
        return f.read()


MANIFEST = "part int, seq int, uri string, docs long, ids long"


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every whole text, in ascending doc_id order; the manifest of the files.

    The manifest's order by (part, seq) is the order of the documents.
    """
    runtime.arrow_limits(documents.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, ids, held, seq
            all_ids = np.concatenate(ids)
            uri = write_file(folder, f"tokens-{part:06d}-{seq:05d}.ptok", pack(docs, np.concatenate(counts), all_ids))
            row = runtime.out_batch(schema, part=[part], seq=[seq], uri=[uri], docs=[len(docs)], ids=[len(all_ids)])
            docs, counts, ids, held, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            for lo, hi, _, _ in text.doc_slices(b["text"]):
                got, n = enc.encode([t or "" for t in b["text"].slice(lo, hi - lo).to_pylist()])
                ends = np.cumsum(n)
                got = np.insert(got, ends, end_id)
                docs += b["doc_id"].slice(lo, hi - lo).to_pylist()
                counts.append(n + 1)
                ids.append(got)
                held += len(got)
                if held >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    rows = runtime.need(documents, "doc_id", "text").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    dealt = rows.repartitionByRange("doc_id", "salt").drop("salt").sortWithinPartitions("doc_id", "text")
    return runtime.written(dealt.mapInArrow(runtime.lean(run, "tokens"), MANIFEST), "token-manifest")


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents from the files: where each starts, its length, and the checksum of its ids.

    The manifest has one row for some four million ids, so its rows go through
    the driver, where their starts are summed up.
    """
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in manifest.orderBy("part", "seq").collect():
        rows.append((r["uri"], start))
        start += r["ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b["uri"].to_pylist(), b["start"].to_pylist(), strict=True):
                doc_ids, counts, ids = unpack(read_file(uri))
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                begin = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield runtime.out_batch(schema, doc_id=doc_ids, start=begin + start, n_tokens=counts.astype(np.int64), ids_crc32=crc)

    files = spark.createDataFrame(rows, "uri string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(runtime.lean(run), SCHEMA)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = runtime.table(spark, sf_dir, "documents")
    folder = runtime.scratch(spark, "token-files")
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder))


QUERIES = {"op5_token_files": op5_token_files}
ORACLE_SQL: dict[str, str] = {}
