"""Histograms over streams: the partial sums are mergeable, so the state is one row a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis


def stream_cells(df: DataFrame, axis: Axis, x: Column | str, weight: Column | str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Running entries, content and sumw2 of every occupied cell, for update or complete mode."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    rows = df.select(*by, axis.find_bin(x).alias("ix"), w.alias("w")).where("ix is not null and w is not null")
    return rows.groupBy(*by, "ix").agg(F.count("*").alias("entries"), F.sum("w").alias("content"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))


def windowed_cells(df: DataFrame, axis: Axis, x: Column | str, time: str, length: str, late: str) -> DataFrame:
    """Cells per event-time window; rows later than ``late`` are dropped, so windows can be finished."""
    rows = df.withWatermark(time, late).select(time, axis.find_bin(x).alias("ix")).where("ix is not null")
    return rows.groupBy(F.window(time, length).alias("window"), "ix").agg(F.count("*").alias("entries"))


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain what a stream has now into an in-memory table; for small results such as cells."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
