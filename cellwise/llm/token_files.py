"""Operator 3: token-id files with a shared zstandard dictionary.

Each shard holds the documents of one doc_id range in ascending order, every document's ids
compressed as its own frame with one dictionary trained on serialized id arrays, then an offset
index, so that a short document is read with two small reads.

File layout (little-endian)::

    8 bytes  magic CWTOKID2
    32 bytes sha-256 of the dictionary
    1 byte   the width of an id: 2 bytes if the vocabulary and the end id allow it, else 4
    frames   one zstandard frame per document
    index    n records <q: doc_id, B: doc_id is null, Q: offset, I: frame bytes, I: n_tokens>
    footer   <Q: index offset, Q: n, 8 bytes magic>

Null texts are empty texts (one end id). Null doc_ids come first and stay null. Repeated doc_ids
keep one entry per row, in the order of a hash of their texts, by which one doc_id with many rows is
also dealt over several shards. Other columns are left out, whatever their names. Very long texts are
frames like all others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, only, open_fs, shared_dir, slices
from .tokens import encoder

MAGIC = b"CWTOKID2"
_FOOTER = "<QQ8s"
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
#: The dictionary is trained on about so many documents of at most so many bytes, chosen by hash;
#: it changes the file size only, never the ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 16_384, 64 << 10
#: Runs of text that a worker remembers from task to task.
RUNS = 1_000_000


def train_dictionary(docs: DataFrame, tokenizer_path: str, kind: str) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample (empty when too little text)."""
    short = docs.where(F.octet_length("text").between(1, SAMPLE_BYTES))  # null texts are none
    every = max(1, docs.count() // SAMPLE_DOCS)
    # Different texts only, in the order of their hashes, so the same table gives the same dictionary.
    hashed = short.select(F.xxhash64("text").alias("h"), "text").where(F.pmod("h", F.lit(every)) == 0)
    rows = hashed.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_DOCS).collect()
    if not rows:
        return b""
    ids, counts = encoder(tokenizer_path).encode([r.text for r in rows])
    samples = [x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def id_kind(tokenizer_path: str, end_id: int) -> str:
    return "<u2" if max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _shard_writer(tokenizer_path: str, dictionary: bytes, folder: str, end_id: int, kind: str):
    def write(batches):
        tokens, packer = encoder(tokenizer_path, RUNS), _compressor(dictionary)
        part = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.ids"
        out, index, offset = None, [], 8 + 32 + 1
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                ids, ends = tokens.with_end(column(piece, "text"), end_id)
                if out is None and len(piece):
                    fs, path = open_fs(uri)
                    fs.create_dir(open_fs(folder)[1], recursive=True)
                    out = fs.open_output_stream(path)
                    out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([int(kind[2])]))
                data = memoryview(ids.astype(kind).view(np.uint8))
                width = int(kind[2])
                at = [0, *(ends * width).tolist()]
                frames = [packer.compress(data[a:b]) for a, b in zip(at, at[1:])]
                doc_ids = column(piece, "doc_id")
                rows = np.zeros(len(piece), _ENTRY)
                rows["doc_id"], rows["null"] = doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False)
                rows["size"], rows["n_tokens"] = np.fromiter(map(len, frames), np.int64, len(frames)), np.diff(np.r_[0, ends])
                rows["offset"] = offset + np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
                offset += int(rows["size"].sum(dtype=np.int64))
                index.append(rows)
                out.write(b"".join(frames))
        if out is not None:
            table = np.concatenate(index)
            out.write(table.tobytes() + struct.pack(_FOOTER, offset, len(table), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_tokens": [int(table["n_tokens"].sum(dtype=np.int64))], "n_docs": [len(table)]}, schema=_MANIFEST_ARROW)

    return write


_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
_MANIFEST = "part int, uri string, n_tokens long, n_docs long"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> tuple[DataFrame, bytes]:
    """Write the shards; the manifest names those that tasks committed, and the dictionary is returned."""
    docs, kind = only(docs, doc_id="long", text="string"), id_kind(tokenizer_path, end_id)
    dictionary = train_dictionary(docs, tokenizer_path, kind)
    tie = F.xxhash64("text")
    ranged = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return cut(ranged.mapInArrow(_shard_writer(tokenizer_path, dictionary, folder, end_id, kind), _MANIFEST), "token-manifest"), dictionary


class ShardReader:
    """Random access to one shard; raises if the dictionary is not the one it was written with."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        if self.file.read(8) != MAGIC or self.file.read(32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        self.width = self.file.read(1)[0]
        size = self.file.size()
        self.file.seek(size - struct.calcsize(_FOOTER))
        at, self.n, magic = struct.unpack(_FOOTER, self.file.read(struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri}: the end of the file is missing")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(self.n * _ENTRY.itemsize), _ENTRY)
        self.unpacker = _decompressor(dictionary)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        entry = self.index[k]
        self.file.seek(int(entry["offset"]))
        return self._ids(self.file.read(int(entry["size"])), int(entry["n_tokens"]))

    def _ids(self, frame: bytes, count: int) -> np.ndarray:
        ids = np.frombuffer(self.unpacker.decompress(frame, max_output_size=self.width * count), f"<u{self.width}").astype("<u4")
        if len(ids) != count:
            raise ValueError("a frame does not hold the ids that the index states")
        return ids

    def __iter__(self):
        self.file.seek(8 + 32 + 1)
        for doc_id, null, _, size, count in self.index.tolist():
            yield (None if null else doc_id), self._ids(self.file.read(size), count)


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per document: its place in the stream of all ids, their number and checksum.

    The manifest has a row per shard, so its running sum on the driver grows with the number of
    partitions, not with documents.
    """
    shards, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        shards.append((row.uri, start))
        start += row.n_tokens

    def read(batches):
        for batch in batches:
            for uri, base in zip(column(batch, "uri").to_pylist(), column(batch, "base").to_pylist()):
                docs, starts, counts, sums = [], [], [], []
                for doc_id, ids in ShardReader(uri, dictionary):
                    docs.append(doc_id)
                    starts.append(base)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(shards, "uri string, base long")
    return listed.repartition(max(1, len(shards)), "uri").mapInArrow(read, _READ)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    manifest, dictionary = write_token_files(docs, tokenizer_path, shared_dir(spark, "token-files"), end_id)
    return read_token_files(spark, manifest, dictionary)
