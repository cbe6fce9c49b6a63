"""WARC archives: write, normalise, read back.

Pages are first written as monolithic gzip files, one stream a file, as crawlers' plain ``gzip`` leaves them. The
normaliser inflates each stream once from front to back, rewrites every record as a gzip member of its own and writes a
sidecar index of offsets, after which any record is one seek away. Records whose payload another record has already
become revisit records without payload. Archives lie in the folder of spark.checkpoint.dir, reached through
pyarrow.fs, under names that no two attempts share; only files that a finished task reported are ever read, so lost
executors and repeated tasks leave nothing but unread files behind.

Nulls: a null html is an empty payload; a null page_id sorts last and is written as "null". White space in a URL, which a
header cannot hold, is left out. Of rows that repeat a page_id and payload one is the response, the others revisit it.
Only page_id, url and html are read, so other columns cannot clash. Memory: one record at a time, inflated in pieces of
1 MB. Every archive is a task of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import shared_dir, stage, table

FILE_BYTES = 64 << 20
CHUNK = 1 << 20
LEAST_SHARED = 100
GZIP = 31  # zlib's window bits for a gzip wrapper
RECORDS = "file string, record int, page_id long, digest string, payload_bytes long"
INDEX = "file string, sidecar string, records int"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def header(kind: str, page: str, url: str, digest: str, block: int, more: tuple[str, ...] = ()) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", *more, "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


class Stream:
    """Records of an archive, inflated once; gzip members may follow each other."""

    def __init__(self, source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(GZIP), bytearray()

    def more(self) -> bool:
        """At most CHUNK bytes more, however small they were when packed."""
        raw = self.inflate.unconsumed_tail or self.inflate.unused_data or self.source.read(CHUNK)
        if not raw:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(GZIP)
        self.held += self.inflate.decompress(raw, CHUNK)
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self.more():
                    if self.held:
                        raise ValueError("the archive ends within a header")
                    return
            fields = dict(x.split(": ", 1) for x in self.take(end + 4).decode().strip().split("\r\n")[1:])
            block = self.take(int(fields["Content-Length"]) + 4)[:-4]
            yield fields, block


def writer(folder: str, whole: int = FILE_BYTES):
    """Task that writes its pages as monolithic archives and reports each record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, name, told, size = None, "", [], 0

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            files, ids, digests, sizes = [name] * len(told), *([x[k] for x in told] for k in range(3))
            return pa.record_batch([pa.array(files), pa.array(range(len(told)), pa.int32()), pa.array(ids, pa.int64()), pa.array(digests), pa.array(sizes, pa.int64())], ["file", "record", "page_id", "digest", "payload_bytes"])

        for batch in batches:
            for page, url, html in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, told, size = store.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), [], 0
                payload, head = (html.as_py() or "").encode(), b""
                digest = hashlib.sha256(payload).hexdigest()
                head = http_head(len(payload))
                target = "".join((url.as_py() or "").split())
                record = header("response", str(page.as_py() if page.is_valid else "null"), target, digest, len(head) + len(payload)) + head + payload + b"\r\n\r\n"
                out.write(squeeze.compress(record))
                told.append((page.as_py(), digest, len(payload)))
                size += len(record)
                if size >= whole:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def normaliser(source: str, target: str):
    """Task that rewrites archives record by record; its rows name a file and the records in it that are revisits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(source)
        to, bottom = fs.FileSystem.from_uri(target)
        to.create_dir(bottom, recursive=True)
        for batch in batches:
            for name, records, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                again = dict(zip(records, pages, strict=True))
                made, at, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with store.open_input_stream(f"{top}/{name}", compression=None) as raw, to.open_output_stream(f"{bottom}/{made}", compression=None) as out:
                    for k, (fields, block) in enumerate(Stream(raw).records()):
                        kind, page, digest = "response", fields["WARC-Record-ID"][10:-1], fields["WARC-Payload-Digest"][7:]
                        more: tuple[str, ...] = ()
                        if k in again:
                            kind, more = "revisit", (f"WARC-Refers-To: <urn:page:{again[k]}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                            block = block[: block.index(b"\r\n\r\n") + 4]
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(header(kind, page, fields["WARC-Target-URI"], digest, len(block), more) + block + b"\r\n\r\n") + squeeze.flush()
                        out.write(member)
                        index.append(f"{at}\t{len(member)}\t{page}\n")
                        at += len(member)
                with to.open_output_stream(f"{bottom}/{made}.idx", compression=None) as side:
                    side.write("".join(index).encode())
                yield pa.record_batch([pa.array([made]), pa.array([f"{made}.idx"]), pa.array([len(index)], pa.int32())], ["file", "sidecar", "records"])

    return run


def reader(folder: str):
    """Task that reads normalised archives through their sidecars, each record by its own offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        number = lambda x: None if x in (None, "null") else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{top}/{name}.idx", compression=None) as side:
                    places = [x.split("\t") for x in side.read().decode().splitlines()]
                with store.open_input_file(f"{top}/{name}") as raw:
                    for at, length, page in places:
                        raw.seek(int(at))
                        record = zlib.decompress(raw.read(int(length)), GZIP)
                        end = record.index(b"\r\n\r\n") + 4
                        fields = dict(x.split(": ", 1) for x in record[:end].decode().strip().split("\r\n")[1:])
                        head, payload = record[end:-4].split(b"\r\n\r\n", 1)
                        size, digest = int(head.rsplit(b": ", 1)[1]), fields["WARC-Payload-Digest"][7:]
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record of page {page} in {name}")
                        refers = fields.get("WARC-Refers-To")
                        rows.append((number(page), size, digest, fields["WARC-Type"], number(refers and refers[10:-1])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives of (page_id, url, html) rows; returns what was written where."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stage(rows.mapInArrow(writer(folder), RECORDS), "records")


def revisits(records: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Records whose payload the record of a smaller page holds: file, record, and that page."""
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("file").alias("first_file"), F.col("record").alias("first_record"))
    sized = records.where(F.col("payload_bytes") >= least)
    # written, so that the join has two plain shuffles and Spark can split the one with a payload of very many pages
    firsts = stage(sized.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "f.*"), "firsts")
    return sized.join(firsts, "digest").where(~((F.col("file") == F.col("first_file")) & (F.col("record") == F.col("first_record")))).select("file", "record", "page")


def dealt(files: DataFrame) -> DataFrame:
    """A row of files for each task: by ranges of their names, which all differ, as many as there are files."""
    return files.repartitionByRange(max(1, files.count()), "file")


def normalise(records: DataFrame, again: DataFrame, source: str, target: str) -> DataFrame:
    """Rewritten archives with sidecars; one row for each. A file's list is as bounded as the file."""
    found = again.groupBy("file").agg(F.collect_list(F.struct("record", "page")).alias("x"))
    plan = records.select("file").distinct().join(found, "file", "left").select("file", F.coalesce(F.col("x.record"), F.array().cast("array<int>")).alias("r"), F.coalesce(F.col("x.page"), F.array().cast("array<long>")).alias("p"))
    return stage(dealt(stage(plan, "plan")).mapInArrow(normaliser(source, target), INDEX), "index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    return dealt(index.select("file")).mapInArrow(reader(folder), READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = shared_dir(spark), shared_dir(spark)
    records = write_archives(table(spark, sf_dir, "pages"), source)
    index = normalise(records, revisits(records), source, target)
    return read_archives(index, target)


SQL = {
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM m
""",
}
