"""Named objects in folders: histograms, profiles, parameters, vectors, matrices, lists and maps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateName
from ..functions.axis import Axis
from ..operators.hist import Hist
from ..operators.profile import Profile


class Store:
    """A folder of objects, with one level of directories; a name is used once in each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _place(self, name: str, directory: str) -> str:
        if not name:
            raise ValueError("an object needs a name")
        if "/" in name or "/" in directory:
            raise ValueError("directories have one level")
        return f"{self.path}/{directory or '_'}/{name}"

    def keys(self, directory: str = "") -> list[str]:
        fs, where = self._file(f"{self.path}/{directory or '_'}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def directories(self) -> list[str]:
        fs, where = self._file(self.path)
        return sorted(n for s in fs.listStatus(where) if (n := s.getPath().getName()) != "_") if fs.exists(where) else []

    def write(self, name: str, value, directory: str = "") -> None:
        """Store an object; a name that is taken raises before anything is written."""
        place = self._place(name, directory)
        if name in self.keys(directory):
            raise DuplicateName(f"{directory}/{name}")
        meta: dict = {"class": type(value).__name__}
        if isinstance(value, (Hist, Profile)):
            meta |= {"axes": [[a.n, a.lo, a.hi, a.edges_, a.labels, a.title] for a in value.axes], "by": value.by, "tracked": value.tracked}
            value.cells.write.parquet(f"{place}/cells")
            value.stats.write.parquet(f"{place}/stats")
        elif isinstance(value, DataFrame):
            meta["class"] = "Table"
            value.write.parquet(f"{place}/cells")
        else:
            meta["value"] = value
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{place}/meta")

    def read(self, name: str, directory: str = ""):
        place = self._place(name, directory)
        if name not in self.keys(directory):
            raise KeyError(f"{directory}/{name}")
        meta = json.loads(self.spark.read.text(f"{place}/meta").first()[0])
        if meta["class"] == "Table":
            return self.spark.read.parquet(f"{place}/cells")
        if meta["class"] not in ("Hist", "Profile"):
            return meta["value"]
        kind = Hist if meta["class"] == "Hist" else Profile
        axes = tuple(Axis(n, lo, hi, tuple(e) if e else None, tuple(lab) if lab else None, t) for n, lo, hi, e, lab, t in meta["axes"])
        return kind(axes, self.spark.read.parquet(f"{place}/cells"), self.spark.read.parquet(f"{place}/stats"), tuple(meta["by"]), meta["tracked"])

    def listing(self) -> DataFrame:
        """Directory, name and class of every object."""
        rows = [(d, n, json.loads(self.spark.read.text(f"{self._place(n, d)}/meta").first()[0])["class"]) for d in ["", *self.directories()] for n in self.keys(d)]
        return self.spark.createDataFrame(rows, "directory string, name string, class string")


def symmetric(spark: SparkSession, upper: list[list[float]]) -> DataFrame:
    """A symmetric matrix (i, j, v) from the rows of its upper triangle."""
    cells = [(i, i + k, float(v)) for i, row in enumerate(upper) for k, v in enumerate(row)]
    table = spark.createDataFrame(cells, "i int, j int, v double")
    return table.unionByName(table.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def latest(keys: DataFrame) -> DataFrame:
    """Of (name, cycle, payload) rows the payload of each name's highest cycle."""
    return keys.groupBy("name").agg(F.max("cycle").alias("cycle"), F.max_by("payload", "cycle").alias("payload"))
