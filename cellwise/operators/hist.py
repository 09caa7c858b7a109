"""Histograms of one to three axes as cell tables, and their algebra.

A histogram is two small DataFrames over one aggregation of the rows: ``cells`` (occupied cells with
``content`` and ``sumw2``) and ``stats`` (``entries`` and the moment sums of rows that lie in range on
every axis). Both may be grouped: every operator works per value of the ``by`` columns. Rows with a
null coordinate or weight are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BinningMismatch
from ..functions.axis import Axis

NAMES = ("x", "y", "z")


def moment_names(dims: int) -> list[str]:
    """The moment sums of a histogram: tsumw, tsumw2, then firsts, seconds and cross terms."""
    own = NAMES[:dims]
    cross = [a + b for k, a in enumerate(own) for b in own[k + 1 :]]
    return ["tsumw", "tsumw2", *[f"tsumw{a}{s}" for a in own for s in ("", "2")], *[f"tsumw{c}" for c in cross]]


@dataclass(frozen=True)
class Hist:
    axes: tuple[Axis, ...]
    cells: DataFrame
    stats: DataFrame
    by: tuple[str, ...] = ()
    tracked: bool = False
    name: str = ""

    @property
    def dims(self) -> int:
        return len(self.axes)

    @property
    def keys(self) -> list[str]:
        return [f"i{a}" for a in NAMES[: self.dims]]

    @property
    def moments(self) -> list[str]:
        return moment_names(self.dims)

    def err2(self) -> Column:
        """The squared error of a cell: sumw2 where errors are tracked, else |content|."""
        return F.col("sumw2") if self.tracked else F.abs("content")

    def in_range(self) -> Column:
        return reduce(and_, [a.in_range(k) for a, k in zip(self.axes, self.keys)])

    def check(self, other: Hist) -> None:
        if self.dims != other.dims or not all(a.same_binning(b) for a, b in zip(self.axes, other.axes)) or self.by != other.by:
            raise BinningMismatch("the histograms have different axes or groups")

    def cell(self) -> Column:
        """The global cell number, x fastest."""
        out = F.lit(0)
        for a, k in reversed(list(zip(self.axes, self.keys))):
            out = out * a.cells + F.col(k)
        return out

    def dense(self) -> DataFrame:
        """Every cell, flow included, with zeros where nothing was filled."""
        total = 1
        for a in self.axes:
            total *= a.cells
        spark = self.cells.sparkSession
        if self.by:
            grid = self.stats.select(*self.by).distinct().select(*self.by, F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("cell"))
        else:
            grid = spark.range(total).select(F.col("id").cast("int").alias("cell"))
        rest = F.col("cell")
        for a, k in zip(self.axes, self.keys):
            grid = grid.withColumn(k, (rest % a.cells).cast("int"))
            rest = F.floor(rest / a.cells)
        joined = grid.join(self.cells, [*self.by, *self.keys], "left")
        filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("content", "sumw2")]
        return joined.select(*self.by, "cell", *self.keys, *filled)

    # ---- algebra

    def scale(self, c: float) -> Hist:
        """Contents and moments by c, squared errors by c * c; entries stay."""
        cells = self.cells.withColumn("content", F.col("content") * c).withColumn("sumw2", F.col("sumw2") * (c * c))
        stats = self.stats.select(*self.by, "entries", *[(F.col(m) * (c * c if m == "tsumw2" else c)).alias(m) for m in self.moments])
        return replace(self, cells=cells, stats=stats)

    def add(self, other: Hist, c: float = 1.0) -> Hist:
        """self + c * other. Errors become tracked if other tracks them or c is not 1."""
        self.check(other)
        track = self.tracked or other.tracked or c != 1.0
        mine = self.cells.select(*self.by, *self.keys, "content", self.err2().alias("sumw2"))
        theirs = other.cells.select(*self.by, *self.keys, (F.col("content") * c).alias("content"), (other.err2() * (c * c)).alias("sumw2"))
        cells = mine.unionByName(theirs).groupBy(*self.by, *self.keys).agg(F.sum("content").alias("content"), F.sum("sumw2").alias("sumw2"))
        scaled = other.stats.select(*self.by, *[(F.col(m) * (c * c if m == "tsumw2" else c)).alias(m) for m in ("entries", *self.moments)])
        stats = self.stats.unionByName(scaled).groupBy(*self.by).agg(*[F.sum(m).alias(m) for m in ("entries", *self.moments)])
        return replace(self, cells=cells, stats=stats, tracked=track)

    def _pairs(self, other: Hist) -> DataFrame:
        self.check(other)
        keys = [*self.by, *self.keys]
        a = self.cells.select(*keys, F.col("content").alias("c1"), self.err2().alias("e1"))
        b = other.cells.select(*keys, F.col("content").alias("c2"), other.err2().alias("e2"))
        zeros = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c1", "e1", "c2", "e2")]
        return a.join(b, keys, "full_outer").select(*keys, *zeros)

    def multiply(self, other: Hist) -> Hist:
        """Cell by cell; entries and moments stay those of self."""
        content = F.col("c1") * F.col("c2")
        error = F.col("e1") * F.col("c2") * F.col("c2") + F.col("e2") * F.col("c1") * F.col("c1")
        cells = self._pairs(other).select(*self.by, *self.keys, content.alias("content"), error.alias("sumw2"))
        return replace(self, cells=cells, tracked=True)

    def divide(self, other: Hist) -> Hist:
        """Cell by cell, 0 where the divisor is 0."""
        some = F.col("c2") != 0
        square = F.col("c2") * F.col("c2")
        content = F.when(some, F.try_divide("c1", "c2")).otherwise(0.0)
        error = F.when(some, F.try_divide(F.col("e1") * square + F.col("e2") * F.col("c1") * F.col("c1"), square * square)).otherwise(0.0)
        cells = self._pairs(other).select(*self.by, *self.keys, content.alias("content"), error.alias("sumw2"))
        return replace(self, cells=cells, tracked=True)

    def sumw2(self) -> Hist:
        """Track errors from now on, starting from |content|."""
        return self if self.tracked else replace(self, cells=self.cells.withColumn("sumw2", F.abs("content")), tracked=True)

    def reset(self) -> Hist:
        zero = [F.lit(0.0).alias(m) for m in ("entries", *self.moments)]
        return replace(self, cells=self.cells.limit(0), stats=self.stats.select(*self.by, *zero))

    def integral(self) -> DataFrame:
        """The sum over cells in range."""
        return self._sum(self.in_range(), "integral")

    def total(self) -> DataFrame:
        """The sum over all cells, flow included."""
        return self._sum(F.lit(True), "total")

    def _sum(self, which: Column, name: str) -> DataFrame:
        return self.cells.groupBy(*self.by).agg(F.coalesce(F.sum(F.when(which, F.col("content"))), F.lit(0.0)).alias(name))

    def stored_as(self, kind: str) -> Hist:
        """Contents in a narrower storage type; integers truncate and saturate."""
        bounds = {"int8": 127, "int16": 32767, "int32": 2**31 - 1, "int64": 2**63 - 1}
        if kind == "double":
            return self
        if kind == "float":
            value = F.col("content").cast("float").cast("double")
        else:
            top = bounds[kind]
            content = F.col("content")
            value = F.when(F.isnan(content), 0.0).when(content >= float(top), float(top)).when(content <= float(-top - 1), float(-top - 1)).otherwise(F.when(content < 0, F.ceil(content)).otherwise(F.floor(content)).cast("double"))
        return replace(self, cells=self.cells.withColumn("content", value))


def fill(df: DataFrame, axes: list[Axis], coords: list[Column | str], weight: Column | str | None = None, by: tuple[str, ...] = (), track: bool = False, name: str = "") -> Hist:
    """Fill a histogram from rows: one scan, one partial and final aggregation on the cell."""
    axes, dims = tuple(axes), len(axes)
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    keys = [f"i{a}" for a in NAMES[:dims]]
    # A labelled axis has no numbers; its moments use bin centres.
    values = [(a.center(a.find_bin(c)) if a.labels else (F.col(c) if isinstance(c, str) else c).cast("double")) for a, c in zip(axes, coords)]
    rows = df.select(*by, w.alias("w"), *[v.alias(n) for v, n in zip(values, NAMES)], *[a.find_bin(c).alias(k) for a, c, k in zip(axes, coords, keys)])
    rows = rows.where(reduce(and_, [F.col(k).isNotNull() for k in [*keys, "w"]]))
    ok = reduce(and_, [a.in_range(k) for a, k in zip(axes, keys)])
    terms = {"tsumw": F.col("w"), "tsumw2": F.col("w") * F.col("w")}
    for k, a in enumerate(NAMES[:dims]):
        terms[f"tsumw{a}"] = F.col("w") * F.col(a)
        terms[f"tsumw{a}2"] = F.col("w") * F.col(a) * F.col(a)
        for b in NAMES[k + 1 : dims]:
            terms[f"tsumw{a}{b}"] = F.col("w") * F.col(a) * F.col(b)
    # Moments of flow cells are never used, and a NaN there must not spread.
    partial = rows.groupBy(*by, *keys).agg(
        F.count("*").cast("double").alias("entries"), F.sum("w").alias("content"), F.sum(F.col("w") * F.col("w")).alias("sumw2"),
        *[F.sum(F.when(ok, t).otherwise(0.0)).alias(n) for n, t in terms.items()],
    )
    names = ["entries", *moment_names(dims)]
    stats = partial.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    cells = partial.select(*by, *keys, "content", "sumw2")
    return Hist(axes, cells, stats, tuple(by), track, name)


def merge(hists: list[Hist]) -> Hist | None:
    """The sum of histograms with the same axes; nothing for an empty list."""
    return reduce(lambda a, b: a.add(b), hists) if hists else None


def merge_groups(h: Hist, *drop: str) -> Hist:
    """Add up groups: ``drop`` leaves the ``by`` columns."""
    by = tuple(b for b in h.by if b not in drop)
    cells = h.cells.groupBy(*by, *h.keys).agg(F.sum("content").alias("content"), F.sum("sumw2").alias("sumw2"))
    stats = h.stats.groupBy(*by).agg(*[F.sum(m).alias(m) for m in ("entries", *h.moments)])
    return replace(h, cells=cells, stats=stats, by=by)


def fill_many(df: DataFrame, specs: dict[str, tuple[Axis, Column | str, Column | str | None]], by: tuple[str, ...] = ()) -> DataFrame:
    """Several one-dimensional histograms in one scan: name, ix, entries, content, sumw2.

    ``specs`` names an axis, a coordinate and a weight (None: 1) each. Every row gives one small struct
    a histogram, which the partial aggregation folds before anything is shuffled.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    cells = F.array(*[
        F.struct(F.lit(name).alias("name"), axis.find_bin(x).alias("ix"), (F.lit(1.0) if w is None else col(w)).cast("double").alias("w"))
        for name, (axis, x, w) in specs.items()
    ])
    rows = df.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").where("ix is not null and w is not null")
    return rows.groupBy(*by, "name", "ix").agg(F.count("*").alias("entries"), F.sum("w").alias("content"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))
