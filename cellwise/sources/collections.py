"""Collections of objects: mixed lists, string-keyed maps, stacks of histograms; vectors and matrices."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BinningMismatch
from ..operators.hist import Hist


@dataclass
class ObjectList:
    """An ordered list of objects of any class."""

    objects: list[Any] = field(default_factory=list)

    def add(self, value: Any) -> ObjectList:
        self.objects.append(value)
        return self

    def items(self, kind: type) -> list[Any]:
        """The members of a class, in order."""
        return [v for v in self.objects if isinstance(v, kind)]

    def class_names(self) -> list[str]:
        return [type(v).__name__ for v in self.objects]


@dataclass
class ObjectMap:
    """Objects by name; a name that is set again is replaced where it stands."""

    objects: dict[str, Any] = field(default_factory=dict)

    def insert(self, key: str, value: Any) -> ObjectMap:
        self.objects[key] = value
        return self

    def get(self, key: str) -> Any | None:
        return self.objects.get(key)

    def string_keys(self) -> list[str]:
        return list(self.objects)

    def values(self) -> list[Any]:
        return list(self.objects.values())


def stack(hists: list[Hist]) -> DataFrame:
    """The cells of several histograms of the same axes, with their place in the stack."""
    for h in hists[1:]:
        if not all(a.same_binning(b) for a, b in zip(hists[0].axes, h.axes)):
            raise BinningMismatch("a stack has one set of axes")
    parts = [h.dense().select(F.lit(k).alias("ordinal"), *h.by, "cell", *h.keys, "content") for k, h in enumerate(hists)]
    return reduce(DataFrame.unionByName, parts)


def stacked(hists: list[Hist]) -> DataFrame:
    """Running sums up the stack, cell by cell."""
    from pyspark.sql import Window

    h = hists[0]
    order = Window.partitionBy(*h.by, "cell").orderBy("ordinal")  # one row a member
    return stack(hists).withColumn("upto", F.sum("content").over(order))


def vector(spark: SparkSession, values: list[float]) -> DataFrame:
    """(i, v) of a vector."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


def matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """(i, j, v) of a matrix; rows must be of one length."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("the rows differ in length")
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i int, j int, v double")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices, as a join and a grouped sum."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("p")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
