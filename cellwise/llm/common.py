"""What the operators of this subpackage share: tables, the shared folder, lineage cuts, byte views.

Everything that must outlive a task goes to ``spark.checkpoint.dir``, the folder that the cluster
says all executors share. A lost executor then costs its running tasks and no more.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in most contracts: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the given folder, read through Spark only."""
    # Python workers of a local session find this package where the driver found it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    bounded(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: The bytes of a batch that goes to Python, in place of Spark's default.
BATCH_BYTES, _BYTES = "4194304b", ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


def bounded(spark: SparkSession) -> None:
    """Bound the bytes of batches for Python more closely, unless the session has a bound of its own."""
    if spark.conf.get(*_BYTES) == _BYTES[1]:
        spark.conf.set(_BYTES[0], BATCH_BYTES)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset a temporary folder serves, which is
    right in one process only, so a session on several machines raises instead.
    """
    bounded(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cellwise-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends here. ``release`` deletes it."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return reread(spark, path, df.schema)


def reread(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that was written at ``path``."""
    again = spark.read.schema(schema).parquet(path)
    again.cut_folder = path
    return again


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; nothing that is still to be read may come from them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """The file system and path of a URI, usable from any executor."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri if not uri.startswith("file:") else "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Cut a batch into runs of rows with at most ``limit`` text bytes (one row at least)."""
    values = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pc.binary_length(values).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start, n = 0, len(batch)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one row, and the offsets of its elements (null: empty)."""
    values = values.fill_null("") if values.null_count else values
    if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = values.buffers()
    offs = np.frombuffer(offsets, dtype=width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def only(df: DataFrame, **casts: str) -> DataFrame:
    """Just the named columns with their types; others, whatever their names, are left out."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in casts.items()])


#: The column that ``numbered`` adds, and how far its partition number is shifted.
ROW, PART_BITS = "row_number_", 33


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a different number in each row, written out so that later reads see the same numbers.

    A number's upper bits name the partition that wrote the row: its part.
    """
    if any(name.lower() == ROW for name in df.columns):
        raise ValueError(f"a column is named {ROW}")
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers of one length, as compressed differences. Sorted ones get small."""
    planes = [np.diff(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return struct.pack("<I", len(arrays[0])) + zstandard.compress(b"".join(planes), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays that ``packed`` was given, as signed integers."""
    (n,) = struct.unpack_from("<I", data)
    raw = np.frombuffer(zstandard.decompress(data[4:]), np.uint8)
    return [np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel()) for x in raw.reshape(-1, 8 * n)] if n else []


def joined(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """The arrays of several blobs, one after another."""
    parts = [x for x in map(unpacked, blobs) if x]
    return [np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(columns)]


class SideTables:
    """A small table for every part of a numbered table, fetched by the tasks that read the part.

    It takes the place of a join on the row number, for which the texts would have to be shuffled. What
    the driver holds is a file name and a place for each part, as many as the input has partitions.
    """

    def __init__(self, places: dict[int, tuple[str, int, int]], columns: int):
        self.places, self.columns = places, columns

    @classmethod
    def write(cls, df: DataFrame, columns: int, tag: str) -> SideTables:
        """From rows (part, data), data being ``packed`` arrays; all rows of a part meet in one task."""
        folder = shared_dir(df.sparkSession, tag)

        def run(batches):
            uri, out, at = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0
            part, blobs, rows = None, [], []

            def put():
                nonlocal out, at
                if out is None:
                    fs, path = open_fs(uri)
                    fs.create_dir(open_fs(folder)[1], recursive=True)
                    out = fs.open_output_stream(path)
                data = packed(*joined(blobs, columns))
                out.write(data)
                rows.append((part, uri, at, len(data)))
                at += len(data)

            for batch in batches:
                for p, data in zip(column(batch, "part").to_pylist(), column(batch, "data").to_pylist()):
                    if p != part and blobs:
                        put()
                        blobs = []
                    part = p
                    blobs.append(data)
            if blobs:
                put()
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["part", "uri", "at", "size"])

        written = df.repartition(shuffles(df.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, "part long, uri string, at long, size long")
        return cls({r.part: (r.uri, r.at, r["size"]) for r in written.collect()}, columns)

    def of(self, part: int) -> list[np.ndarray]:
        """The arrays of a part, empty if it has none."""
        if part not in self.places:
            return [np.zeros(0, np.int64)] * self.columns
        uri, at, size = self.places[part]
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as file:
            file.seek(at)
            return unpacked(file.read(size)) or [np.zeros(0, np.int64)] * self.columns


def by_part(row: str, *columns: str):
    """For mapInArrow: row numbers, and whole numbers beside them, as (part, data)."""

    def run(batches):
        for batch in batches:
            arrays = [column(batch, c).to_numpy(zero_copy_only=False) for c in (row, *columns)]
            of = arrays[0] >> PART_BITS
            parts = np.unique(of)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([packed(*(a[of == p] for a in arrays)) for p in parts.tolist()], pa.binary())], names=["part", "data"])

    return run


def shuffles(spark: SparkSession) -> int:
    """The number of partitions that the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
