"""Histograms made from histograms: rebinned, sliced, accumulated, projected, profiled."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import Axis
from .hist import NAMES, Hist
from .profile import Profile


def _regroup(h: Hist, axes: tuple[Axis, ...], maps: list[Column], keys: list[str] | None = None) -> DataFrame:
    named = [m.cast("int").alias(f"i{a}") for m, a in zip(maps, NAMES)]
    rows = h.cells.select(*h.by, *named, "content", "sumw2")
    keys = [f"i{a}" for a in NAMES[: len(axes)]]
    return rows.groupBy(*h.by, *keys).agg(F.sum("content").alias("content"), F.sum("sumw2").alias("sumw2"))


def rebin(h: Hist, *groups: int) -> Hist:
    """Make ``groups[k]`` bins of axis k one. Bins left over at the top go to overflow; moments stay."""
    if len(groups) != h.dims:
        raise ValueError("one group size for each axis")
    groups = tuple(max(1, g) if h.dims == 1 else max(1, min(g, a.n)) for g, a in zip(groups, h.axes))
    if any(g > a.n for g, a in zip(groups, h.axes)):
        raise ValueError("a group is larger than the axis")
    axes = tuple(a.merged(g) for a, g in zip(h.axes, groups))
    maps = []
    for a, g, k, fresh in zip(h.axes, groups, h.keys, axes):
        i = F.col(k)
        maps.append(F.when(i == 0, 0).when(i > fresh.n * g, fresh.n + 1).otherwise(F.floor((i - 1) / g) + 1))
    return replace(h, axes=axes, cells=_regroup(h, axes, maps))


def slice_range(h: Hist, lo: float, hi: float) -> Hist:
    """The bins from that of ``lo`` to that of ``hi``, both kept; what lies outside becomes flow.

    Moments come from bin centres; entries stay.
    """
    (axis,) = h.axes
    a, b = (max(1, min(axis.n, axis.find(v))) for v in (lo, hi))
    a, b = min(a, b), max(a, b)
    part = axis.part(a, b)
    i = F.col("ix")
    cells = _regroup(h, (part,), [F.when(i < a, 0).when(i > b, b - a + 2).otherwise(i - a + 1)])
    inside = F.when(part.in_range("ix"), F.col("content")).otherwise(0.0)
    x = part.center("ix")
    error = F.when(part.in_range("ix"), h.err2()).otherwise(0.0)
    sums = cells.groupBy(*h.by).agg(F.sum(inside).alias("tsumw"), F.sum(error).alias("tsumw2"), F.sum(inside * x).alias("tsumwx"), F.sum(inside * x * x).alias("tsumwx2"))
    entries = h.stats.select(*h.by, "entries")
    stats = entries.join(sums, list(h.by)) if h.by else entries.join(F.broadcast(sums))  # one row each
    return replace(h, axes=(part,), cells=cells, stats=stats)


def cumulative(h: Hist, forward: bool = True) -> Hist:
    """Running sums of the bins in range, upwards or downwards; flow is zero and errors go."""
    order = Window.partitionBy(*h.by).orderBy("ix" if forward else F.col("ix").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # A group has at most as many rows as its axis has bins.
    rows = h.dense().where(h.in_range())
    cells = rows.select(*h.by, "ix", F.sum("content").over(order).alias("content"), F.lit(0.0).alias("sumw2"))
    return replace(h, cells=cells, tracked=False)


def project(h: Hist, onto: str) -> Hist:
    """Sum the axes that ``onto`` (such as "x" or "xz") leaves out, over their bins in range."""
    kept = [NAMES.index(a) for a in onto]
    gone = [k for k in range(h.dims) if k not in kept]
    rows = h.cells.where(reduce(and_, [h.axes[k].in_range(h.keys[k]) for k in gone]))
    axes = tuple(h.axes[k] for k in kept)
    cells = _regroup(replace(h, cells=rows), axes, [F.col(h.keys[k]) for k in kept])
    names = {"tsumw": "tsumw", "tsumw2": "tsumw2"}
    for new, k in zip(NAMES, kept):
        names |= {f"tsumw{new}": f"tsumw{NAMES[k]}", f"tsumw{new}2": f"tsumw{NAMES[k]}2"}
    if len(kept) == 2:
        names["tsumwxy"] = "tsumw" + "".join(NAMES[k] for k in sorted(kept))
    stats = h.stats.select(*h.by, "entries", *[F.col(old).alias(new) for new, old in names.items()])
    return replace(h, axes=axes, cells=cells, stats=stats)


def profile_of(h: Hist, along: str) -> Profile:
    """The profile of the other axis' bin centres along x or y of a two-dimensional histogram."""
    keep, other = (0, 1) if along == "x" else (1, 0)
    y = h.axes[other].center(h.keys[other])
    w = F.col("content")
    rows = h.cells.where(h.axes[other].in_range(h.keys[other]))
    cells = rows.groupBy(*h.by, F.col(h.keys[keep]).alias("ix")).agg(
        F.sum(w).alias("sumw"), F.sum(w * y).alias("sumwy"), F.sum(w * y * y).alias("sumwy2"), F.lit(0.0).alias("sumw2")
    )
    names = {"tsumw": "tsumw", "tsumw2": "tsumw2", "tsumwx": f"tsumw{along}", "tsumwx2": f"tsumw{along}2"}
    value = "y" if along == "x" else "x"
    names |= {"tsumwv": f"tsumw{value}", "tsumwv2": f"tsumw{value}2"}
    stats = h.stats.select(*h.by, "entries", *[F.col(o).alias(n) for n, o in names.items()])
    return Profile((h.axes[keep],), cells, stats, h.by)


__all__ = ["cumulative", "profile_of", "project", "rebin", "slice_range"]
