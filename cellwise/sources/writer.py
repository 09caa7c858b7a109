"""Batch-wise table writers: the schema is that of the first batch, and each batch is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaChanged


class BatchWriter:
    """Append batches below a path. A batch keeps its number, so writing it again replaces it.

    Memory is bounded by the tasks' own; ``rows_per_file`` bounds the files.
    """

    def __init__(self, path: str, rows_per_file: int = 0):
        self.path, self.rows_per_file = path.rstrip("/"), rows_per_file
        self.kinds: list[tuple[str, str]] | None = None
        self.count, self.closed = 0, False

    def write_batch(self, df: DataFrame, number: int | None = None) -> None:
        if self.closed:
            raise ValueError("the writer is finished")
        if self.kinds is None:
            self.kinds = df.dtypes
        elif df.dtypes != self.kinds:
            raise SchemaChanged(f"{df.dtypes} is not {self.kinds}")
        number = self.count if number is None else number
        writer = df.write.mode("overwrite")
        if self.rows_per_file:
            writer = writer.option("maxRecordsPerFile", self.rows_per_file)
        writer.parquet(f"{self.path}/batch={number}")
        self.count = max(self.count, number + 1)

    def finish(self) -> int:
        """No more batches; the number of batches written."""
        self.closed = True
        return self.count

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that is retried replaces itself."""
        return lambda df, number: self.write_batch(df, number)


def read_batches(spark, path: str) -> DataFrame:
    """All batches, with their number in ``batch``."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
