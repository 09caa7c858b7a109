"""Graphs: point tables with optional errors, and formulas that go with them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    """A formula text; parameters ``[0]`` are written ``[p0]``."""

    name: str
    text: str
    params: tuple[float, ...] = ()

    @property
    def normal(self) -> str:
        return re.sub(r"\[(\d+)\]", r"[p\1]", self.text)

    @property
    def npar(self) -> int:
        return len(set(re.findall(r"\[p(\d+)\]", self.normal)))

    def expression(self) -> str:
        """The formula with its parameters put in, as SQL over ``x``."""
        return re.sub(r"\[p(\d+)\]", lambda m: f"({self.params[int(m[1])]!r}D)", self.normal)


def normalize(column):
    """``[0]`` to ``[p0]`` in a column of formulas."""
    return F.regexp_replace(column, r"\[(\d+)\]", r"[p$1]")


@dataclass(frozen=True)
class Graph:
    """Points (i, x, y[, z]) with errors ex_lo, ex_hi, ey_lo, ey_hi and layers of further y errors."""

    points: DataFrame
    functions: tuple[Formula, ...] = ()
    layers: tuple[str, ...] = field(default=())

    @staticmethod
    def of(spark: SparkSession, x: list[float], y: list[float], ex=None, ey=None, z=None) -> Graph:
        """``ex`` and ``ey``: a number a point, or a (low, high) pair a point."""
        if len(x) != len(y):
            raise ValueError("as many x as y")
        pair = lambda e, k: (0.0, 0.0) if e is None else tuple(map(float, e[k])) if isinstance(e[k], tuple) else (float(e[k]),) * 2
        rows = [(k, float(x[k]), float(y[k]), *pair(ex, k), *pair(ey, k), *([float(z[k])] if z else [])) for k in range(len(x))]
        kinds = "i int, x double, y double, ex_lo double, ex_hi double, ey_lo double, ey_hi double" + (", z double" if z else "")
        return Graph(spark.createDataFrame(rows, kinds))

    def with_function(self, f: Formula) -> Graph:
        return Graph(self.points, (*self.functions, f), self.layers)

    def add_y_error(self, name: str, errors: list[tuple[float, float]]) -> Graph:
        table = self.points.sparkSession.createDataFrame([(k, (float(a), float(b))) for k, (a, b) in enumerate(errors)], f"i int, `{name}` struct<lo:double,hi:double>")
        return Graph(self.points.join(table, "i", "left"), self.functions, (*self.layers, name))

    def fit_points(self) -> DataFrame:
        """(x, y, sigma): the mean of the two y errors, or 1 where there is none."""
        sigma = (F.col("ey_lo") + F.col("ey_hi")) / 2
        return self.points.select("x", "y", F.when(sigma > 0, sigma).otherwise(1.0).alias("sigma"))
