"""The folder for checkpoints: the session's own setting, or a temporary one in a single process."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ensure_checkpoint(spark: SparkSession) -> None:
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='cellwise-')}")


def ship(spark: SparkSession) -> None:
    """Python workers of a local session find this package where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
