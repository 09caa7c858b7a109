"""Profiles, efficiencies, sparse and polygon-binned histograms."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BinningMismatch
from ..functions.axis import Axis
from .hist import NAMES

ERROR_MODES = ("mean", "spread", "spread_i", "spread_g")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Profile:
    """Sums of a value in the cells of one to three axes: sumw, sumwy, sumwy2 and, if tracked, sumw2."""

    axes: tuple[Axis, ...]
    cells: DataFrame
    stats: DataFrame
    by: tuple[str, ...] = ()
    tracked: bool = False

    @property
    def keys(self) -> list[str]:
        return [f"i{a}" for a in NAMES[: len(self.axes)]]

    def effective(self) -> Column:
        """Effective entries of a bin: (sum w)^2 / sum w^2 where tracked, else sum w."""
        if not self.tracked:
            return F.col("sumw")
        return F.when(F.col("sumw2") > 0, F.try_divide(F.col("sumw") * F.col("sumw"), F.col("sumw2"))).otherwise(0.0)

    def values(self, mode: str = "mean") -> DataFrame:
        """The mean of each occupied bin and its error in one of four modes."""
        if mode not in ERROR_MODES:
            raise ValueError(f"the mode must be one of {ERROR_MODES}")
        mean = F.try_divide("sumwy", "sumw")
        spread = F.abs(F.try_divide("sumwy2", "sumw") - mean * mean)
        neff = self.effective()
        of_mean = F.when(neff > 0, F.sqrt(F.try_divide(spread, neff))).otherwise(0.0)
        error = {
            "mean": of_mean,
            "spread": F.sqrt(spread),
            "spread_i": F.when(spread <= 0, F.when(neff > 0, F.try_divide(F.lit(1.0), F.sqrt(12.0 * neff))).otherwise(0.0)).otherwise(of_mean),
            "spread_g": F.try_divide(F.lit(1.0), F.sqrt(F.abs("sumw"))),
        }[mode]
        some = F.col("sumw") != 0
        return self.cells.select(*self.by, *self.keys, "sumw", F.when(some, mean).otherwise(0.0).alias("mean"), F.when(some, error).otherwise(0.0).alias("error"))

    def add(self, other: Profile) -> Profile:
        if self.by != other.by or len(self.axes) != len(other.axes) or not all(a.same_binning(b) for a, b in zip(self.axes, other.axes)):
            raise BinningMismatch("the profiles have different axes or groups")
        up = lambda a, b, keys: a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in a.columns if c not in keys])
        return replace(self, cells=up(self.cells, other.cells, [*self.by, *self.keys]), stats=up(self.stats, other.stats, list(self.by)))


def profile(df: DataFrame, axes: list[Axis], coords: list[Column | str], value: Column | str, weight: Column | str | None = None, by: tuple[str, ...] = (), limits: tuple[float, float] | None = None, track: bool = False) -> Profile:
    """Fill a profile. Rows whose value lies outside ``limits`` are not counted at all."""
    keys = [f"i{a}" for a in NAMES[: len(axes)]]
    w = F.lit(1.0) if weight is None else _col(weight).cast("double")
    rows = df.select(*by, w.alias("w"), _col(value).cast("double").alias("v"), *[_col(c).cast("double").alias(n) for c, n in zip(coords, NAMES)], *[a.find_bin(c).alias(k) for a, c, k in zip(axes, coords, keys)])
    rows = rows.where(reduce(and_, [F.col(k).isNotNull() for k in [*keys, "w", "v"]]))
    if limits and limits[0] < limits[1]:
        rows = rows.where(F.col("v").between(*limits) & ~F.isnan("v"))
    ok = reduce(and_, [a.in_range(k) for a, k in zip(axes, keys)])
    wv = F.col("w") * F.col("v")
    terms = {"tsumw": F.col("w"), "tsumw2": F.col("w") * F.col("w"), "tsumwv": wv, "tsumwv2": wv * F.col("v")}
    for n in NAMES[: len(axes)]:
        terms |= {f"tsumw{n}": F.col("w") * F.col(n), f"tsumw{n}2": F.col("w") * F.col(n) * F.col(n)}
    partial = rows.groupBy(*by, *keys).agg(
        F.count("*").cast("double").alias("entries"), F.sum("w").alias("sumw"), F.sum(wv).alias("sumwy"), F.sum(wv * F.col("v")).alias("sumwy2"), F.sum(F.col("w") * F.col("w")).alias("sumw2"),
        *[F.sum(F.when(ok, t).otherwise(0.0)).alias(n) for n, t in terms.items()],
    )
    stats = partial.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("entries", *terms)])
    return Profile(tuple(axes), partial.select(*by, *keys, "sumw", "sumwy", "sumwy2", "sumw2"), stats, tuple(by), track)


def efficiency(df: DataFrame, axis: Axis, x: Column | str, passed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Per bin how many rows there are, how many pass, and the share (0 where there is none)."""
    rows = df.select(*by, axis.find_bin(x).alias("ix"), F.coalesce(passed, F.lit(False)).alias("passed")).where("ix is not null")
    out = rows.groupBy(*by, "ix").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return out.withColumn("efficiency", F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)))


def sparse(df: DataFrame, axes: list[Axis], coords: list[Column | str], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the occupied cells of any number of axes, flow included."""
    keys = [f"b{k}" for k in range(len(axes))]
    rows = df.select(*by, *[a.find_bin(c).alias(k) for a, c, k in zip(axes, coords, keys)])
    rows = rows.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    return rows.groupBy(*by, *keys).agg(F.count("*").alias("content"))


def pack_bins(axes: list[Axis]) -> Column:
    """The bins b0, b1, … of a sparse cell in the bits of one long, b0 lowest."""
    out, shift = F.lit(0).cast("long"), 0
    for k, a in enumerate(axes):
        out = out + F.call_function("shiftleft", F.col(f"b{k}").cast("long"), F.lit(shift))
        shift += (a.n + 1).bit_length()
    return out


def unpack_bins(code: Column, axes: list[Axis]) -> list[Column]:
    """The bins that ``pack_bins`` put into ``code``."""
    out, shift = [], 0
    for a in axes:
        bits = (a.n + 1).bit_length()
        out.append(F.call_function("shiftright", code, F.lit(shift)).bitwiseAND((1 << bits) - 1).cast("int"))
        shift += bits
    return out


Polygon = list[tuple[float, float]]


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Polygon:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def polygon_area(points: Polygon) -> float:
    """Shoelace formula."""
    return 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])))


def in_polygon(points: Polygon, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the outline an odd number of times; False under 3 corners."""
    if len(points) < 3:
        return F.lit(False)
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(points, points[-1:] + points[:-1]):
        if y0 == y1:
            continue
        crosses = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < F.lit(x1 - x0) * (y - y0) / F.lit(y1 - y0) + x0)
        inside = inside != crosses
    box = x.between(min(p[0] for p in points), max(p[0] for p in points)) & y.between(min(p[1] for p in points), max(p[1] for p in points))
    return box & inside


def poly_fill(df: DataFrame, polygons: list[Polygon], x: Column | str, y: Column | str, weight: Column | str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Contents of polygon bins 1, 2, … (the first that contains a point takes it); bin 0 counts misses.

    The polygons are part of the expression, so points need no join.
    """
    x, y = _col(x).cast("double"), _col(y).cast("double")
    w = F.lit(1.0) if weight is None else _col(weight).cast("double")
    which = F.lit(0)
    for k in range(len(polygons), 0, -1):
        which = F.when(in_polygon(polygons[k - 1], x, y), k).otherwise(which)
    rows = df.where(x.isNotNull() & y.isNotNull() & w.isNotNull()).select(*by, which.alias("bin"), w.alias("w"), x.alias("x"), y.alias("y"))
    hit = F.col("bin") > 0
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("entries"), F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("content"))
