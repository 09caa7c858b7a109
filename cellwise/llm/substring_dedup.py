"""Operator 2: substring dedup over a log-structured fingerprint index.

The index is a folder: segments of texts as they came, and sorted immutable runs of the fingerprints
(keys, see windows.py) of their windows, each run cut into the same ranges of keys. A new batch is
appended as a segment; its sorted fingerprints are merge-joined, range by range, with the runs of all
earlier batches, which are read in place and not dealt out again; what meets is remembered for the parts
that hold it; the batch's own run is written. More than ``FANOUT`` runs are compacted into one. A
manifest names all this, so a later job opens the index and goes on.

``repeats`` verifies: texts behind fingerprints that met are compared word by word, in one pass for all
batches since the last one. A window is removed where its word sequence also starts in an earlier
document, by (doc_id, row), a null doc_id before all others. Rows that share a doc_id, and rows without
one, are documents of their own. Null texts have no words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesview import Prefix, same_bytes, spans
from .common import PART_BITS, ROW, SideTables, column, cut, joined, open_fs, packed, release, shared_dir, shuffles, unpacked
from .windows import IS_WORD, RowRuns, Spec, by_bucket, covered, dealt, fingerprints, met, shares

WIDTH, ANCHOR, CHUNK, FANOUT, BATCHES = 50, 10, 4000, 4, 6


def occurs_before(data: list[bytes], n: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, spec: Spec) -> np.ndarray:
    """Whether the words of each window of each text also start in a document with a smaller (doc_id, row).

    Windows are grouped by hash; then each is compared, word by word, with the first of its group, and
    those that differ are grouped by their words instead.
    """
    raw = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))]
    begins, ends, firsts = spans(raw, offsets, IS_WORD)
    of = np.repeat(np.arange(len(n)), n)
    at = firsts[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    hashes = Prefix(Prefix(raw, 2).runs(begins, ends), 1).runs(at, at + spec.width)
    places = np.lexsort((row, doc))
    rank = np.empty(len(n), np.int64)
    rank[places] = np.cumsum(np.r_[False, (row[places][1:] != row[places][:-1])])
    own = rank[of]
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    counts = np.diff(np.r_[heads, len(order)])
    head = np.repeat(order[heads], counts)
    other = np.flatnonzero(order != head)
    a, b = at[order[other]], at[head[other]]
    equal = np.ones(len(other), bool)
    for k in range(spec.width):
        size = ends[a + k] - begins[a + k]
        fits = size == ends[b + k] - begins[b + k]
        fits[fits] = same_bytes(raw, begins[a[fits] + k], raw, begins[b[fits] + k], size[fits])
        equal &= fits
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], heads), counts)
    if not equal.all():
        words = lambda w: b" ".join(raw[begins[at[w] + k] : ends[at[w] + k]].tobytes() for k in range(spec.width))
        mixed = np.flatnonzero(np.isin(hashes, hashes[order[other[~equal]]])).tolist()
        by_words: dict[bytes, int] = {}
        for w in mixed:
            key = words(w)
            by_words[key] = min(by_words.get(key, int(own[w])), int(own[w]))
        for w in mixed:
            least[w] = by_words[words(w)]
    return least < own


def _store(folder: str, data: bytes) -> str:
    """A new file of the index."""
    uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.run"
    fs, path = open_fs(uri)
    fs.create_dir(open_fs(folder)[1], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)
    return uri


def _load(uri: str) -> list[np.ndarray]:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as file:
        return unpacked(file.read()) or [np.zeros(0, np.int64)] * 2


class FingerprintIndex:
    """An index in a folder: ``create`` or ``open`` it, ``add`` batches, ask for ``repeats``."""

    def __init__(self, spark: SparkSession, folder: str, state: dict):
        self.spark, self.folder, self.state = spark, folder, state
        self.spec = Spec(*state["spec"])

    @classmethod
    def create(cls, spark: SparkSession, folder: str, spec: Spec = Spec(True, WIDTH, ANCHOR), fanout: int = FANOUT) -> FingerprintIndex:
        state = {"spec": [spec.words, spec.width, spec.anchor], "buckets": 4 * shuffles(spark), "fanout": fanout, "parts": 0, "segments": [], "runs": [], "met": [], "version": 0}
        index = cls(spark, folder, state)
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index as its last saved manifest names it."""
        fs, path = open_fs(folder)
        newest = max(x.path for x in fs.get_file_info(FileSelector(path)) if x.base_name.startswith("manifest-"))
        with fs.open_input_stream(newest) as file:
            return cls(spark, folder, json.loads(file.read()))

    def _save(self) -> None:
        """A manifest is written whole under another name first; older ones stay readable until then."""
        fs, path = open_fs(self.folder)
        fs.create_dir(path, recursive=True)
        self.state["version"] += 1
        name = f"{path}/manifest-{self.state['version']:09d}"
        with fs.open_output_stream(f"{path}/.new") as out:
            out.write(json.dumps(self.state).encode())
        fs.move(f"{path}/.new", name)

    def append(self, rows: DataFrame) -> list[str]:
        """Write numbered texts to the log. Where there is a ``batch_`` column, a segment for each batch."""
        path = f"{self.folder}/texts-{uuid.uuid4().hex}"
        first = self.state["parts"]
        rows = rows.withColumn(ROW, F.monotonically_increasing_id() + F.lit(first << PART_BITS))
        if "batch_" not in rows.columns:
            rows.write.parquet(path)
            found = [path]
        else:
            rows.write.partitionBy("batch_").parquet(path)
            fs, at = open_fs(path)
            numbers = [int(x.base_name.removeprefix("batch_=")) for x in fs.get_file_info(FileSelector(at)) if x.base_name.startswith("batch_=")]
            found = [f"{path}/batch_={k}" for k in sorted(numbers)]  # none if there are no rows
        self.state["parts"] = first + rows.rdd.getNumPartitions() + 1
        return found

    def add(self, segment: str, schema) -> None:
        """Index a segment of the log: what meets is noted, the segment's run is written."""
        rows = self.spark.read.schema(schema).parquet(segment)
        buckets = self.state["buckets"]
        runs, folder = self.state["runs"], f"{self.folder}/run-{uuid.uuid4().hex}"

        def run(batches):
            for bucket, parts, blobs in by_bucket(batches):
                keys, of, often = met(parts, blobs)
                ours, theirs = [(keys[often], of[often])], []
                distinct = keys[np.r_[True, keys[1:] != keys[:-1]]]
                for files in runs:
                    if str(bucket) not in files:
                        continue
                    old, old_of = _load(files[str(bucket)])
                    old = old.view(np.uint64)
                    # Both sides are sorted: each key's place in the other one.
                    at = np.minimum(np.searchsorted(distinct, old), len(distinct) - 1)
                    hit = distinct[at] == old
                    theirs.append((old[hit], old_of[hit]))
                    at = np.minimum(np.searchsorted(old, keys), len(old) - 1)
                    hit = (old[at] == keys) & ~often
                    ours.append((keys[hit], of[hit]))
                found = shares(*(np.concatenate(x) for x in zip(*(ours + theirs))))
                uri = _store(folder, packed(keys, of))
                kinds = pa.array(np.zeros(len(found), np.int32))
                yield pa.RecordBatch.from_arrays([kinds, found["part"], found["data"], pa.array([None] * len(found), pa.string())], names=["bucket", "part", "data", "uri"])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([uri])], names=["bucket", "part", "data", "uri"])

        out = cut(dealt(fingerprints(rows, self.spec, buckets), buckets).mapInArrow(run, "bucket int, part long, data binary, uri string"), "met")
        # One file name for each range of keys.
        files = {str(r.bucket): r.uri for r in out.where("part = -1").select("bucket", "uri").collect()}
        self.state["runs"].append(files)
        self.state["segments"].append(segment)
        self.state["met"].append(out.cut_folder)
        if len(self.state["runs"]) > self.state["fanout"]:
            self.compact()
        self._save()

    def compact(self) -> None:
        """One run in place of all, merged range by range."""
        folder, runs = f"{self.folder}/run-{uuid.uuid4().hex}", self.state["runs"]
        named = [(int(b), [r[b] for r in runs if b in r]) for b in sorted({b for r in runs for b in r}, key=int)]

        def run(batches):
            for batch in batches:
                for bucket, uris in zip(column(batch, "bucket").to_pylist(), column(batch, "uris").to_pylist()):
                    keys, of = (np.concatenate(x) for x in zip(*map(_load, uris)))
                    order = np.lexsort((of, keys.view(np.uint64)))
                    keys, of = keys[order], of[order]
                    new = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_store(folder, packed(keys[new], of[new]))])], names=["bucket", "uri"])

        listed = self.spark.createDataFrame(named, "bucket int, uris array<string>").repartition(shuffles(self.spark), "bucket")
        self.state["runs"] = [{str(r.bucket): r.uri for r in listed.mapInArrow(run, "bucket int, uri string").collect()}]
        fs, _ = open_fs(self.folder)
        for files in runs:
            for uri in files.values():
                fs.delete_file(open_fs(uri)[1])

    def rows(self, schema) -> DataFrame:
        """All segments."""
        if not self.state["segments"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self.state["segments"])

    def repeats(self, schema, limit: int | None = None) -> SideTables:
        """Covered runs of words of the rows whose fingerprints met since the last call, verified."""
        if not self.state["met"]:
            return SideTables({}, 3)
        noted = self.spark.read.schema("bucket int, part long, data binary, uri string").parquet(*self.state["met"])
        keys = noted.where("part >= 0").select("part", "data")
        found = covered(self.rows(schema), keys, self.spec, occurs_before, CHUNK, False, limit)
        for path in self.state["met"]:
            fs, at = open_fs(path)
            fs.delete_dir(at)
        self.state["met"] = []
        self._save()
        return found


def indexed(docs: DataFrame, batches: int, fanout: int = FANOUT, limit: int | None = None) -> tuple[DataFrame, SideTables]:
    """Numbered rows of ``docs``, all their columns, and their covered runs of words."""
    spark = docs.sparkSession
    index = FingerprintIndex.create(spark, shared_dir(spark, "index"), fanout=fanout)
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for bound in sorted(set(bounds or [])):
        batch = batch + F.when(F.col("doc_id") > bound, 1).otherwise(0)
    segments = index.append(docs.withColumn("batch_", batch))
    schema = docs.withColumn(ROW, F.lit(0).cast("long")).schema
    for segment in segments:
        index.add(segment, schema)
    return index.rows(schema), index.repeats(schema, limit)


def _words(data: bytes, runs: list) -> tuple[int, list[bytes]]:
    words = data.split()
    kept, at = [], 0
    for low, high in runs:
        kept += words[at:low]
        at = high
    return len(words), kept + words[at:] if runs else words


def substring_dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, limit: int | None = None) -> DataFrame:
    """Word counts and the checksum of what is left of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, tables = indexed(docs, batches, fanout, limit)

    def digest(batches_):
        runs_of = RowRuns(tables)
        for batch in batches_:
            out = []
            for row, doc_id, text in zip(*(column(batch, c).to_pylist() for c in (ROW, "doc_id", "text"))):
                n, kept = _words((text or "").encode(), runs_of(row))
                out.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated words taken out of the texts (n_chars follows, where it is a column).

    Texts that lose nothing stay as they are; the others become their kept words, one space between. Every
    row stays, whatever its doc_id: null texts and texts without words as they are, a text all of whose
    words go as an empty one. Of rows with equal texts the first by (doc_id, row) keeps its words, a null
    doc_id before all others. Other columns stay as they are. An empty table gives no rows.
    """
    rows, tables = indexed(docs, batches)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches_):
        runs_of = RowRuns(tables)
        for batch in batches_:
            texts = []
            for row, text in zip(column(batch, ROW).to_pylist(), column(batch, "text").to_pylist()):
                runs = runs_of(row)
                texts.append(b" ".join(_words((text or "").encode(), runs)[1]).decode() if runs else text)
            rest = batch.select(names)
            yield rest.set_column(at, rest.schema.field(at), pa.array(texts, rest.schema.field(at).type))

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
