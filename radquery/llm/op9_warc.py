"""WARC archives by way of a table of chunked records.

A payload becomes rows of a record id and a chunk number, each with the SHA-1 and the length of all up to there, so that
neither writing nor reading an archive holds a record whole. Of records with equal payloads (of at least ``least`` bytes),
that with the smallest page_id is stored as a response, and the others as revisits that refer to it.

A null html is an empty payload. Rows with equal page_id and payload all count as that response, and rows without page_id are
responses. A null url is an empty target. Of further columns nothing is read. No page: no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import AtomicFile, filesystem, files_for, new_dir, write_table

CHUNK_BYTES = 1 << 18
#: What a record has besides its payload, about.
HEADER_BYTES = 400
CHUNKS = "record long, page_id long, url string, chunk int, data binary, payload_bytes long, payload_digest string, last boolean"
#: A fixed date keeps a file the same when its task runs again.
DATE = "2000-01-01T00:00:00Z"


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def chunk_records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of each payload's chunks, one at least; payload_bytes and payload_digest are of the chunks so far."""

    def cut(batches):
        for batch in batches:
            rows, held = [], 0
            for record, page, url, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                whole, sha1 = memoryview(payload.as_buffer()), hashlib.sha1()
                for chunk, at in enumerate(range(0, max(1, len(whole)), chunk_bytes)):
                    data = bytes(whole[at : at + chunk_bytes])
                    sha1.update(data)
                    to = at + len(data)
                    rows.append((record.as_py(), page.as_py(), url.as_py(), chunk, data, to, _base32(sha1), to == len(whole)))
                    held += len(data)
                    if held > 16 * chunk_bytes:
                        yield _table(rows)
                        rows, held = [], 0
            if rows:
                yield _table(rows)

    binary = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    source = pages.select(F.monotonically_increasing_id(), F.col("page_id").cast("long"), F.coalesce("url", F.lit("")), binary)
    return source.mapInArrow(cut, CHUNKS)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    names = ("record", "page_id", "url", "chunk", "data", "payload_bytes", "payload_digest", "last")
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def find_revisits(chunks: DataFrame, least: int = 0) -> DataFrame:
    """A row for each record: record, page_id, url, payload_bytes, payload_digest, refers_to and refers_record."""
    records = chunks.where("last").select("record", "page_id", "url", "payload_bytes", "payload_digest")
    originals = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record"))).alias("original"))
    originals = write_table(originals, "originals")  # as a table, Spark knows its size, and can split a digest's rows in the join
    joined = records.join(originals, "payload_digest", "left")
    other = (F.col("page_id") != F.col("original.page_id")) & (F.col("payload_bytes") >= least)
    return joined.select(*records.columns, *(F.when(other, F.col(f"original.{k}")).alias(n) for k, n in (("page_id", "refers_to"), ("record", "refers_record"))))


def _uri(page: int | None, record: int) -> str:
    return f"<urn:radquery:page:{'' if page is None else page}:{record}>"


def _header(kind: str, lines: list[str], http: bytes, payload: int) -> bytes:
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *lines, f"Content-Length: {len(http) + payload}", "", ""]).encode() + http


def write_archives(chunks: DataFrame, records: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Writes gzip archives, a member for each record, and returns a row (path, records) for each; an action does the work."""
    if files is None:  # by the bytes of the payloads that are written
        size = records.agg(F.sum(F.when(F.col("refers_to").isNull(), F.col("payload_bytes"))).alias("n"), F.count("*").alias("records")).first()
        files = files_for((size["n"] or 0) + HEADER_BYTES * size["records"])
    heads = records.select("record", F.lit(-1).alias("chunk"), "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "refers_record", F.lit(None).cast("binary").alias("data"))
    bodies = chunks.select("record", "chunk", *(F.lit(None).cast(t).alias(n) for n, t in (("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"), ("refers_record", "long"))), "data")
    rows = heads.union(bodies).repartition(files, "record").sortWithinPartitions("record", "chunk")

    def write(batches):
        path, count, skip = f"{folder}/{TaskContext.get().partitionId():05d}.warc.gz", 0, True
        with AtomicFile(path) as out:
            gz = zlib.compressobj(3, zlib.DEFLATED, 31)
            out.write(gz.compress(_header("warcinfo", ["WARC-Record-ID: <urn:radquery:archive>", "Content-Type: application/warc-fields"], b"software: radquery\r\n", 0)))
            for batch in batches:
                for r in batch.to_pylist():
                    if r["chunk"] < 0:
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                        gz, count, skip = zlib.compressobj(3, zlib.DEFLATED, 31), count + 1, r["refers_to"] is not None
                        n, target = r["payload_bytes"], re.sub(r"[\r\n]", "", r["url"])
                        lines = [f"WARC-Record-ID: {_uri(r['page_id'], r['record'])}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}", "Content-Type: application/http; msgtype=response"]
                        if skip:
                            lines += [f"WARC-Refers-To: {_uri(r['refers_to'], r['refers_record'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
                        out.write(gz.compress(_header("revisit" if skip else "response", lines, http, 0 if skip else n)))
                    elif not skip:
                        out.write(gz.compress(r["data"]))
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        yield pa.record_batch([[path], [count]], names=["path", "records"])

    return rows.mapInArrow(write, "path string, records long")


class _Members:
    """Bytes of a file of gzip members, by exact counts or up to a separator, without holding more than asked for."""

    def __init__(self, stream):
        self.stream, self.gz, self.held, self.raw = stream, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        data = self.gz.unconsumed_tail or self.raw or self.stream.read(1 << 16)
        self.raw = b""
        if data:
            self.held += self.gz.decompress(data, 1 << 18)
        return bool(data)

    def until(self, end: bytes) -> bytes | None:
        while (at := self.held.find(end)) < 0:
            if not self._more():
                return None
        found = bytes(self.held[:at])
        del self.held[: at + len(end)]
        return found

    def take(self, n: int, most: int):
        while n:
            if not self.held and not self._more():
                raise EOFError("a record ends early")
            part = bytes(self.held[: min(n, most)])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_archives(archives: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """From archives' paths, stored, the chunk rows of all records: page_id, url, record_type, refers_to, chunk, data, payload_bytes and payload_digest so
    far, last. A revisit has one row without data, whose length and digest are those that its headers state."""

    def read(batches):
        names = ["page_id", "url", "record_type", "refers_to", "chunk", "data", "payload_bytes", "payload_digest", "last"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        batch = lambda rows: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        page = lambda uri: int(uri.split(":")[-2]) if uri and uri.split(":")[-2] else None
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            fs, local = filesystem(path)
            with fs.open_input_stream(local, compression=None) as stream:
                data, rows, held = _Members(stream), [], 0
                while (head := data.until(b"\r\n\r\n")) is not None:
                    if not (head := head.lstrip(b"\r\n")):
                        continue
                    f = _fields(head)
                    block = int(f["content-length"])
                    if f["warc-type"] == "warcinfo":
                        for _ in data.take(block, chunk_bytes):
                            pass
                        continue
                    http = data.until(b"\r\n\r\n")
                    length = int(_fields(http)["content-length"])
                    mine = (page(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], page(f.get("warc-refers-to")))
                    if f["warc-type"] == "revisit":
                        rows.append((*mine, 0, None, length, f["warc-payload-digest"].removeprefix("sha1:"), True))
                    else:
                        sha1, at = hashlib.sha1(), 0
                        for chunk, part in enumerate(data.take(length, chunk_bytes)):
                            sha1.update(part)
                            at += len(part)
                            rows.append((*mine, chunk, part if with_data else None, at, _base32(sha1), at == length))
                            held += len(part) if with_data else 0
                            if held > 16 * chunk_bytes or len(rows) >= 4096:
                                yield batch(rows)
                                rows, held = [], 0
                        if not length:
                            rows.append((*mine, 0, b"" if with_data else None, 0, _base32(sha1), True))
                        if f["warc-payload-digest"] != f"sha1:{_base32(sha1)}":
                            raise ValueError(f"{path}: {f['warc-record-id']} doesn't have its digest")
                if rows:
                    yield batch(rows)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, chunk int, data binary, payload_bytes long, payload_digest string, last boolean")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = write_table(chunk_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), "chunks")
    archives = write_archives(chunks, find_revisits(chunks), new_dir(spark, "archives"))
    read = read_archives(write_table(archives, "archives"), with_data=False)
    return read.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM f
"""
