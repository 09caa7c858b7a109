"""Operator 9: WARC archives, one gzip member per record, and their sequential reader.

Records of equal payloads: the first by (page_id, row), a null page_id before all others, is the
``response``, the others are ``revisit`` records that name it. A payload below ``min_bytes`` is never
revisited. So one row of each group of equal payloads is the response, also where page_ids repeat or are
missing; every row stays a record of its own. Null html is an empty payload; a null url is written as
``urn:page:<id>``. Very long pages are read and written in blocks of bounded size once compressed. Other
columns are left out, whatever their names. An empty table gives no rows.

Which rows are revisits goes back to the parts that hold them, so payloads are never shuffled, and what
is grouped by payload is a digest and a place for each.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PART_BITS, ROW, SideTables, by_part, column, cut, numbered, only, open_fs, release, shared_dir

BLOCK, HEAD = 1 << 16, 1 << 20


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, page_id: int | None, url: str | None, digest: str, block: bytes, payload_bytes: int, refers_to: int | None = None) -> bytes:
    """The bytes of one WARC/1.1 record. Page ids travel in the record ids and a header of their own."""
    # Line ends would break the framing of the headers; a URL has none.
    target = "".join(c for c in (url or f"urn:page:{page_id}") if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {payload_bytes}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcReader:
    """Records of one archive in order, decompressed bit by bit.

    The members are inflated one after another from a forward-only stream. The headers end at the blank
    line, the block has as many bytes as Content-Length says, and two line ends close the member. At most
    ``block`` inflated bytes are held at a time. The digest of every response is computed again as its
    bytes go by; a revisit must have an empty block, so its digest is the one that was stated.
    Yields the headers, and the payload where ``payloads`` asks for it (else None).
    """

    def __init__(self, stream, block: int = BLOCK, payloads: bool = True):
        self.stream, self.block, self.payloads, self.waiting = stream, block, payloads, b""

    def _inflated(self):
        """The bytes of the next member, some at a time; nothing at the end of the archive."""
        self.waiting = self.waiting or self.stream.read(self.block)
        if not self.waiting:
            return
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.waiting:
                self.waiting = self.stream.read(self.block)
                if not self.waiting:
                    raise ValueError("the archive ends inside a gzip member")
            data = inflate.decompress(self.waiting, self.block)
            self.waiting = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            yield data

    def __iter__(self):
        while True:
            member_, head = self._inflated(), b""
            for data in member_:
                head += data
                if b"\r\n\r\n" in head or len(head) > HEAD:
                    break
            if not head:
                return
            head, mark, rest = head.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not mark or not first.startswith("WARC/"):
                raise ValueError("no WARC record where one must begin")
            headers = dict(line.split(": ", 1) for line in lines)
            left, sha, kept, tail = int(headers["Content-Length"]), hashlib.sha1(), [], b""
            for data in itertools.chain([rest], member_):
                own, after = data[:left], data[left:]
                left -= len(own)
                sha.update(own)
                if self.payloads:
                    kept.append(own)
                tail += after[:5]
            if left or tail != b"\r\n\r\n":
                raise ValueError("a record's end is not where Content-Length puts it")
            if headers["WARC-Type"] == "response":
                if f"sha1:{base64.b32encode(sha.digest()).decode()}" != headers["WARC-Payload-Digest"] or headers["Content-Length"] != headers["WARC-Payload-Length"]:
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")
            elif headers["Content-Length"] != "0":
                raise ValueError(f"the revisit {headers['WARC-Record-ID']} has a payload of its own")
            yield headers, b"".join(kept) if self.payloads else None


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write archives, one per task; the manifest (uri, n) names those of committed tasks."""
    pages = numbered(only(pages, page_id="long", url="string", html="string"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keys = pages.select(ROW, "page_id", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    place = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", ROW)
    # One small row for each payload that several rows share; its copies find it, and skewed ones are split.
    shared = keys.groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first")
    again = keys.join(shared, "sha").where(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW, F.col("first.named").alias("named"), F.coalesce("first.page_id", F.lit(0)).alias("first"))
    tables = SideTables.write(again.mapInArrow(by_part(ROW, "named", "first"), "part long, data binary"), 3, "revisits")

    def write(batches):
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n, part, refers = None, 0, None, {}
        for batch in batches:
            for row, page_id, url, html in zip(*(column(batch, c).to_pylist() for c in (ROW, "page_id", "url", "html"))):
                if out is None:
                    fs, path = open_fs(uri)
                    fs.create_dir(open_fs(folder)[1], recursive=True)
                    out = fs.open_output_stream(path)
                if row >> PART_BITS != part:
                    part = row >> PART_BITS
                    rows, named, first = tables.of(part)
                    refers = {r: f if k else None for r, k, f in zip(rows.tolist(), named.tolist(), first.tolist())}
                payload = (html or "").encode()
                if row in refers:
                    out.write(member(record("revisit", page_id, url, digest32(payload), b"", len(payload), refers[row])))
                else:
                    out.write(member(record("response", page_id, url, digest32(payload), payload, len(payload))))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n": np.array([n], np.int64)})

    done = cut(pages.mapInArrow(write, "uri string, n long"), "warc-manifest")
    release(pages)
    return done


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that the manifest names."""

    def read(batches):
        for batch in batches:
            for uri in column(batch, "uri").to_pylist():
                fs, path = open_fs(uri)
                rows = []
                with fs.open_input_stream(path) as stream:
                    for headers, _ in WarcReader(stream, payloads=False):
                        rows.append((_number(headers["WARC-Record-ID"]), int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"][5:], headers["WARC-Type"], _number(headers.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    uris = [r.uri for r in manifest.collect()]  # one per writing task
    return spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)), "uri").mapInArrow(read, _READ)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, shared_dir(spark, "warc"), min_bytes))
