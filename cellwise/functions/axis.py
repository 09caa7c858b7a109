"""Axes: bins as metadata on the driver, binning as Column expressions on the executors.

Bin 0 is underflow, bins 1..n lie in range, bin n + 1 is overflow. Intervals are half-open, NaN
overflows, and a null coordinate has no bin.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Axis:
    """``n`` bins on [lo, hi), or the bins between ``edges``; bins may carry labels."""

    n: int
    lo: float
    hi: float
    edges_: tuple[float, ...] | None = None
    labels: tuple[str, ...] | None = None
    title: str = ""

    @staticmethod
    def reg(n: int, lo: float, hi: float, title: str = "") -> Axis:
        if n < 1 or not lo < hi:
            raise ValueError("a uniform axis needs a bin and lo < hi")
        return Axis(int(n), float(lo), float(hi), title=title)

    @staticmethod
    def var(edges: list[float], title: str = "") -> Axis:
        edges = tuple(float(e) for e in edges)
        if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:])):
            raise ValueError("a variable axis needs two or more ascending edges")
        return Axis(len(edges) - 1, edges[0], edges[-1], edges, title=title)

    @staticmethod
    def labelled(labels: list[str], title: str = "") -> Axis:
        return Axis(len(labels), 0.0, float(len(labels)), labels=tuple(labels), title=title)

    @property
    def step(self) -> float:
        return (self.hi - self.lo) / self.n

    @property
    def cells(self) -> int:
        return self.n + 2

    def edges(self) -> list[float]:
        return [self.edge(i) for i in range(self.n + 1)]

    def edge(self, i: int) -> float:
        i = max(0, min(self.n, i))
        return self.edges_[i] if self.edges_ else (self.hi if i == self.n else self.lo + self.step * i)

    def bin_low_edge(self, i: int) -> float:
        return self.edge(i - 1)

    def bin_width(self, i: int) -> float:
        return self.edge(i) - self.edge(i - 1) if 1 <= i <= self.n else 0.0

    def bin_center(self, i: int) -> float:
        return 0.5 * (self.edge(i - 1) + self.edge(i)) if 1 <= i <= self.n else 0.0

    def find(self, x: float) -> int:
        """The bin of a number, on the driver."""
        if x < self.lo:
            return 0
        if math.isnan(x) or x >= self.hi:
            return self.n + 1
        if self.edges_:
            return min(bisect.bisect_right(self.edges_, x), self.n)
        return min(1 + math.floor((x - self.lo) / self.step), self.n)

    def find_bin(self, x: Column | str) -> Column:
        """The bin of a column. A labelled axis looks strings up; unknown ones overflow."""
        if self.labels:
            at = F.array_position(F.array(*map(F.lit, self.labels)), _col(x).cast("string")).cast("int")
            return F.when(_col(x).isNull(), None).when(at == 0, self.n + 1).otherwise(at)
        x = _col(x).cast("double")
        if not self.edges_:
            inside = F.least((F.floor((x - self.lo) / F.lit(self.step)) + 1).cast("int"), F.lit(self.n))
        elif len(self.edges_) <= 64:
            inside = F.least(reduce(add, [F.when(x >= e, 1).otherwise(0) for e in self.edges_]), F.lit(self.n))
        else:
            table = F.array(*map(F.lit, self.edges_))
            inside = F.least(F.size(F.filter(table, lambda e: e <= x)), F.lit(self.n))
        return F.when(x.isNull(), None).when(F.isnan(x) | (x >= self.hi), self.n + 1).when(x < self.lo, 0).otherwise(inside)

    def in_range(self, bin_: Column | str) -> Column:
        return _col(bin_).between(1, self.n)

    def center(self, bin_: Column | str) -> Column:
        """The bin's centre; 0 for flow bins."""
        return F.when(self.in_range(bin_), 0.5 * (self._edge(_col(bin_) - 1) + self._edge(_col(bin_)))).otherwise(F.lit(0.0))

    def width(self, bin_: Column | str) -> Column:
        return F.when(self.in_range(bin_), self._edge(_col(bin_)) - self._edge(_col(bin_) - 1)).otherwise(F.lit(0.0))

    def low_edge(self, bin_: Column | str) -> Column:
        return self._edge(F.greatest(F.lit(0), F.least(F.lit(self.n), _col(bin_) - 1)))

    def label(self, bin_: Column | str) -> Column:
        return F.get(F.array(*map(F.lit, self.labels or ())), _col(bin_) - 1)

    def _edge(self, i: Column) -> Column:
        if self.edges_:
            return F.get(F.array(*map(F.lit, self.edges_)), i)
        return F.when(i >= self.n, F.lit(self.hi)).otherwise(F.lit(self.lo) + F.lit(self.step) * i)

    def same_binning(self, other: Axis) -> bool:
        return self.n == other.n and self.edges() == other.edges() and self.labels == other.labels

    def merged(self, group: int) -> Axis:
        """The axis with ``group`` bins made one; bins left over at the top go to overflow."""
        n = self.n // group
        if self.edges_:
            return Axis.var([self.edge(i * group) for i in range(n + 1)], self.title)
        return Axis.reg(n, self.lo, self.edge(n * group), self.title)

    def part(self, first: int, last: int) -> Axis:
        """Bins first..last as an axis."""
        return Axis.var([self.edge(i) for i in range(first - 1, last + 1)], self.title)
