"""WARC: write archives, normalise monolithic gzip files, read records by offset.

Pages become records of one gzip stream for each file. The normaliser inflates
such a stream once, piece by piece, rewrites every record as a gzip member of
its own and writes a sidecar index of offsets; readers then seek to any record.

Rows: a null page is an empty payload, and a page without a URL has no target
header. Payloads of at least ``MIN_REVISIT`` bytes that are equal have one
response, the page with the largest id (each row of it, if it is repeated);
others are revisits of it. Pages without an id are revisits if an equal page has
one. An empty table makes no file. The normaliser takes records without a
Content-Length as damage and raises ValueError, as for anything that is no record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: Payloads below this are never revisits.
MIN_REVISIT = 1000
#: Bytes of records of a file, before compression; bytes read or inflated at once.
FILE_BYTES, PIECE = 32 << 20, 1 << 20
LEVEL = 6
#: Parts into which rows of one digest are dealt, so that a hot payload is not one task's.
SALTS = 32
#: Pages bring no time of their own.
DATE = "1970-01-01T00:00:00Z"


@dataclass
class Record:
    """A WARC record: its header fields in order, and its block."""

    fields: list[tuple[str, str]]
    block: bytes

    def __getitem__(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)

    def dump(self) -> bytes:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.fields if k.lower() != "content-length") + f"Content-Length: {len(self.block)}\r\n\r\n"
        return head.encode() + self.block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, revisit: bool) -> Record:
    """The record of one page; ``digest`` is hexadecimal, ``length`` that of the full payload."""
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"), ("WARC-Date", DATE)]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return Record(fields, http if revisit else http + payload)


def parse(raw: bytes) -> tuple[Record, int] | None:
    """The record at the front and its bytes; None if it is not complete yet."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    size = next((v for k, v in fields if k.lower() == "content-length"), "")
    if not size.isdecimal():
        raise ValueError("a WARC record without a length")
    size = int(size)
    if len(raw) < end + 4 + size + 4:
        return None
    return Record(fields, bytes(raw[end + 4 : end + 4 + size])), end + 8 + size


def inflated(f) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members, each of bounded size."""
    z = zlib.decompressobj(31)
    while raw := f.read(PIECE):
        while raw:
            if z.eof:
                z = zlib.decompressobj(31)
            if out := z.decompress(raw, PIECE):
                yield out
            raw = z.unused_data if z.eof else z.unconsumed_tail
    if not z.eof:
        raise EOFError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of an inflated stream; at most one record and one piece are held."""
    held, at = bytearray(), 0
    wanted = 0
    for piece in pieces:
        held += piece
        if len(held) < wanted:
            continue
        while at < len(held):
            found = parse(bytes(held[at : at + (1 << 16)])) or parse(bytes(held[at:]))
            if not found:
                break
            yield found[0]
            at += found[1]
        del held[:at]
        at, wanted = 0, 2 * len(held) if len(held) > 4 * PIECE else 0
    while held[at:]:
        if not (found := parse(bytes(held[at:]))):
            raise EOFError("the last record is not complete")
        yield found[0]
        at += found[1]


class Store:
    """A file that gets its name only when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = runtime.filesystem(folder)
        if isinstance(self.fs, fs.LocalFileSystem):
            self.fs.create_dir(path, recursive=True)
        self.uri, self.final, self.temporary = f"{folder}/{name}", f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temporary), 0

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def done(self) -> str:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.uri


def classified(pages: DataFrame) -> DataFrame:
    """Pages with length, digest, whether they are revisits, and of which page.

    Equal payloads meet by digest: what is shuffled for that is a row for each
    digest and task. Rows of a digest are dealt into parts, to each of which the
    digest's row is sent.
    """
    html = F.coalesce("html", F.lit(""))
    rows = runtime.need(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    copies = rows.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").drop("rows")
    dealt = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt.hint("shuffle_hash"), ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "n", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


WRITTEN = "uri string, index_uri string, records long"
_WRITTEN = pa.schema([("uri", pa.string()), ("index_uri", pa.string()), ("records", pa.int64())])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write classified pages as WARC files of one gzip stream each; a row for each file."""
    runtime.arrow_limits(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, n, raw = TaskContext.get().partitionId(), 0, None, 0, 0
        z = None
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out, z, n, raw = Store(folder, f"pages-{part:06d}-{seq:05d}.warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                revisit = r["refers_to"] is not None and r["n"] >= MIN_REVISIT
                record = page_record(r["page_id"], r["url"], b"" if revisit else r["html"].encode("utf-8", "surrogatepass"), r["n"], r["digest"], r["refers_to"], revisit).dump()
                out.write(z.compress(record))
                n, raw = n + 1, raw + len(record)
                if raw >= FILE_BYTES:
                    out.write(z.flush())
                    yield runtime.out_batch(_WRITTEN, uri=[out.done()], index_uri=[None], records=[n])
                    out, seq = None, seq + 1
        if out is not None:
            out.write(z.flush())
            yield runtime.out_batch(_WRITTEN, uri=[out.done()], index_uri=[None], records=[n])

    return runtime.written(pages.mapInArrow(runtime.lean(run), WRITTEN), "warc-files")


def each_file(files: DataFrame) -> DataFrame:
    """The rows of a file list dealt so that tasks have one file each, up to 100,000 tasks."""
    return files.repartition(min(100_000, max(1, files.count())))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite monolithic gzip files with a member for each record, and a sidecar index of them.

    A line of the index is a JSON object: type, id, URI, offset and length of the member.
    """
    runtime.arrow_limits(files.sparkSession, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b["uri"].to_pylist():
                name = uri.rpartition("/")[2].removesuffix(".gz").removesuffix(".warc")
                store, path = runtime.filesystem(uri)
                out, index, n = Store(folder, f"{name}.warc.gz"), [], 0
                with store.open_input_stream(path, compression=None) as f:
                    for record in records(inflated(f)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(record.dump()) + z.flush()
                        index.append(json.dumps({"type": record["WARC-Type"], "id": record["WARC-Record-ID"], "uri": record["WARC-Target-URI"], "offset": out.size, "length": len(member)}))
                        out.write(member)
                        n += 1
                side = Store(folder, f"{name}.warc.idx.gz")
                side.write(zlib.compress("\n".join(index).encode(), 6, 31))
                yield runtime.out_batch(_WRITTEN, uri=[out.done()], index_uri=[side.done()], records=[n])

    return runtime.written(each_file(files).mapInArrow(runtime.lean(run), WRITTEN), "warc-members")


PAGES = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised files, each read at its offset, digests verified."""
    runtime.arrow_limits(files.sparkSession, 16)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def row(raw: bytes) -> dict:
        record, _ = parse(zlib.decompress(raw, 31))
        head, _, payload = record.block.partition(b"\r\n\r\n")
        digest = base64.b32decode(record["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        revisit = record["WARC-Type"] == "revisit"
        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"{record['WARC-Record-ID']}: the payload is damaged")
        number = lambda name: int(v) if (v := record[name]) is not None else None
        return {"page_id": number("X-Page-ID"), "url": record["WARC-Target-URI"], "payload": payload if payloads and not revisit else None, "payload_bytes": size, "payload_digest": digest, "record_type": record["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, side in zip(b["uri"].to_pylist(), b["index_uri"].to_pylist(), strict=True):
                store, path = runtime.filesystem(side)
                with store.open_input_stream(path, compression=None) as f:
                    lines = zlib.decompress(f.read(), 31).decode().splitlines()
                store, path = runtime.filesystem(uri)
                with store.open_input_file(path) as f:
                    found, held = [], 0
                    for line in map(json.loads, lines):
                        f.seek(line["offset"])
                        found.append(row(f.read(line["length"])))
                        held += len(found[-1]["payload"] or b"")
                        if held > 4 * PIECE or len(found) >= 1000:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema)

    return each_file(files).mapInArrow(runtime.lean(run), PAGES)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.scratch(spark, "warc")
    plain = write_archives(classified(runtime.table(spark, sf_dir, "pages")), f"{folder}/whole")
    members = normalise(plain, f"{folder}/members")
    runtime.discard(spark, f"{folder}/whole")
    return read_records(members, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {
    "op1_warc": """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
             CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
      FROM pages
    ), g AS (
      SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1
    )
    SELECT p.page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND p.page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND p.page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM p LEFT JOIN g USING (payload_digest)
    """
}
