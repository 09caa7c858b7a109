"""Numbers from histograms: accessors, moments, extrema, interpolation, quantiles, tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi_square_prob, kolmogorov_prob
from .hist import NAMES, Hist


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(b != 0, F.try_divide(a, b)), F.lit(0.0))


def bins(h: Hist) -> DataFrame:
    """Content, variance and error of every cell, flow included."""
    variance = F.greatest(F.col("sumw2") if h.tracked else F.col("content"), F.lit(0.0))
    return h.dense().withColumn("variance", variance).withColumn("error", F.sqrt(variance))


def counts(h: Hist) -> DataFrame:
    """Effective counts of the bins in range: value^2 / variance where weighted, else the value."""
    value = F.col("content")
    effective = F.when(F.col("variance") > 0, F.try_divide(value * value, F.col("variance"))).otherwise(value) if h.tracked else value
    return bins(h).where(h.in_range()).select(*h.by, *h.keys, effective.alias("count"))


def density(h: Hist) -> DataFrame:
    """Contents over the width and the sum of a one-dimensional histogram."""
    total = F.sum("content").over(Window.partitionBy(*h.by))  # at most one row a bin
    rows = h.dense().where(h.in_range())
    return rows.select(*h.by, "ix", _ratio(F.col("content"), h.axes[0].width("ix") * total).alias("density"))


def summary(h: Hist) -> DataFrame:
    """Entries, effective entries, and the mean and standard deviation along each axis."""
    w = F.col("tsumw")
    out = [F.col("entries"), _ratio(w * w, F.col("tsumw2")).alias("effective_entries")]
    for a in NAMES[: h.dims]:
        mean = _ratio(F.col(f"tsumw{a}"), w)
        out += [mean.alias(f"mean_{a}"), F.sqrt(F.greatest(_ratio(F.col(f"tsumw{a}2"), w) - mean * mean, F.lit(0.0))).alias(f"std_{a}")]
    return h.stats.select(*h.by, *out)


def extremum(h: Hist, largest: bool = True) -> DataFrame:
    """The cell in range with the largest or smallest content; the first wins ties, x outermost."""
    value = F.col("content") if largest else -F.col("content")
    order = F.struct(value.alias("v"), *[(-F.col(k)).alias(k) for k in h.keys])
    best = h.dense().where(h.in_range()).groupBy(*h.by).agg(F.max_by(F.struct("cell", "content"), order).alias("best"))
    return best.select(*h.by, "best.cell", "best.content")


def at(h: Hist, x: float) -> DataFrame:
    """The content of the bin of ``x``, flow included."""
    return h.dense().where(F.col("ix") == h.axes[0].find(x)).select(*h.by, "ix", "content")


def integral_range(h: Hist, lo: float, hi: float) -> DataFrame:
    """The sum of the bins from that of ``lo`` to that of ``hi``, both included."""
    axis = h.axes[0]
    a, b = (max(1, min(axis.n, axis.find(v))) for v in (lo, hi))
    return h.cells.groupBy(*h.by).agg(F.coalesce(F.sum(F.when(F.col("ix").between(min(a, b), max(a, b)), F.col("content"))), F.lit(0.0)).alias("integral"))


def interpolate(h: Hist, points: DataFrame) -> DataFrame:
    """Contents between bin centres, linear, for the ``x`` of ``points``; the ends stay level.

    The histogram has one row a bin, so it is the side that is sent to the points.
    """
    if h.by:
        raise ValueError("interpolation takes one histogram")
    axis = h.axes[0]
    x = F.col("x")
    own = F.least(F.greatest(axis.find_bin("x"), F.lit(1)), F.lit(axis.n))
    left = F.when(x <= axis.center(own), own - 1).otherwise(own)
    left = F.when(x <= axis.bin_center(1), 1).when(x >= axis.bin_center(axis.n), axis.n).otherwise(left)
    cells = h.dense().select("ix", "content")
    after = cells.select((F.col("ix") - 1).alias("ix"), F.col("content").alias("next"))
    pairs = F.broadcast(cells.join(after, "ix", "left"))
    joined = points.withColumn("ix", left).join(pairs, "ix", "left")
    x0, x1 = axis.center("ix"), axis.center(F.col("ix") + 1)
    flat = (x <= axis.bin_center(1)) | (x >= axis.bin_center(axis.n))
    y = F.col("content") + (x - x0) * F.try_divide(F.col("next") - F.col("content"), x1 - x0)
    return joined.select("x", F.when(flat, F.col("content")).otherwise(y).alias("y"))


def quantiles(h: Hist, probs: list[float]) -> DataFrame:
    """Where the running share of the contents in range reaches each probability.

    A probability that equals a share at a bin's end gives that bin's centre (0 for the share before
    the first bin). An empty histogram gives the lower end of the axis.
    """
    axis = h.axes[0]
    upto = Window.partitionBy(*h.by).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*h.by)
    rows = h.dense().where(h.in_range()).withColumn("total", F.sum("content").over(whole)).withColumn("sum", F.sum("content").over(upto))
    rows = rows.withColumn("hi", _ratio(F.col("sum"), F.col("total"))).withColumn("lo", _ratio(F.col("sum") - F.col("content"), F.col("total")))
    rows = rows.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.partitionBy(*h.by).orderBy("ix")))
    p = F.explode(F.array(*map(F.lit, probs))).alias("p")
    # Row ix stands for the share before bin ix: the last one that does not exceed p counts.
    rows = rows.select(*h.by, "ix", "lo", "hi", "total", p).where((F.col("lo") <= F.col("p")) | (F.col("ix") == 1))
    last = rows.groupBy(*h.by, "p").agg(F.max_by(F.struct("ix", "lo", "hi", "total"), "ix").alias("b")).select(*h.by, "p", "b.*")
    inside = axis.low_edge("ix") + F.coalesce(F.try_divide(F.col("p") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * axis.width("ix")
    x = F.when(F.col("total") <= 0, F.lit(axis.lo)).when(F.col("lo") == F.col("p"), axis.center(F.col("ix") - 1)).otherwise(inside)
    return last.select(*h.by, "p", x.alias("x"))


@dataclass(frozen=True)
class TestResult:
    statistic: float
    ndf: int
    p_value: float


def _both(a: Hist, b: Hist) -> DataFrame:
    rows = a._pairs(b).where(a.in_range())
    if not a.tracked:
        rows = rows.withColumn("e1", F.greatest("c1", F.lit(0.0)))
    if not b.tracked:
        rows = rows.withColumn("e2", F.greatest("c2", F.lit(0.0)))
    whole = Window.partitionBy(*a.by)  # one row a bin
    return rows.withColumn("s1", F.sum("c1").over(whole)).withColumn("s2", F.sum("c2").over(whole)).withColumn("v2", F.sum("e2").over(whole))


def chi2_table(a: Hist, b: Hist, kind: str = "UU") -> DataFrame:
    """chi2 and ndf per group: both counts (UU), counts against weights (UW) or both weighted (WW)."""
    c1, c2, s1, s2, e1, e2, v2 = (F.col(n) for n in ("c1", "c2", "s1", "s2", "e1", "e2", "v2"))
    filled = (c1 != 0) | (c2 != 0)
    if kind == "UU":
        used = filled
        delta = s2 * c1 - s1 * c2
        term = F.try_divide(delta * delta, c1 + c2) * F.when(s1 * s2 > 0, F.try_divide(F.lit(1.0), s1 * s2)).otherwise(1.0)
    elif kind == "WW":
        used = (e1 != 0) | (e2 != 0)
        delta = s1 * c2 - s2 * c1
        below = s1 * s1 * e2 + s2 * s2 * e1
        term = F.when(below > 0, F.try_divide(delta * delta, below)).otherwise(0.0)
    elif kind == "UW":
        bare = (c2 == 0) & (e2 == 0)
        used = filled & ~(bare & ~((v2 > 0) & (s2 > 0)))
        var = F.when(bare, F.try_divide(v2, s2)).otherwise(e2)
        first = s2 * c2 - s1 * var
        share = F.try_divide(first + F.sqrt(first * first + 4.0 * s2 * s2 * c1 * var), 2.0 * s2 * s2)
        n1, n2 = share * s1, share * s2
        term = F.when(n1 > 0, F.try_divide((c1 - n1) * (c1 - n1), n1)).otherwise(0.0) + F.when(var > 0, F.try_divide((c2 - n2) * (c2 - n2), var)).otherwise(0.0)
    else:
        raise ValueError("kind is UU, UW or WW")
    rows = _both(a, b).where(used).withColumn("term", term)
    return rows.groupBy(*a.by).agg(F.sum("term").alias("chi2"), F.greatest(F.count("*") - 1, F.lit(0)).alias("ndf"))


def chi2_test(a: Hist, b: Hist, kind: str = "UU") -> TestResult:
    row = chi2_table(a, b, kind).first()
    chi2, ndf = (row.chi2 or 0.0, row.ndf) if row else (0.0, 0)
    return TestResult(chi2, ndf, chi_square_prob(chi2, ndf))


def kolmogorov_table(a: Hist, b: Hist) -> DataFrame:
    """Distance of the running shares, and z, per group; zeros if a sum is not positive."""
    upto = Window.partitionBy(*a.by).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    s1, s2 = F.col("s1"), F.col("s2")
    some = (s1 > 0) & (s2 > 0)
    rows = _both(a, b).withColumn("d", F.abs(_ratio(F.sum("c1").over(upto), s1) - _ratio(F.sum("c2").over(upto), s2)))
    out = rows.groupBy(*a.by).agg(F.max("d").alias("d"), F.max("s1").alias("s1"), F.max("s2").alias("s2"))
    distance = F.when(some, F.col("d")).otherwise(0.0)
    return out.select(*a.by, distance.alias("distance"), (distance * F.sqrt(F.when(some, F.try_divide(s1 * s2, s1 + s2)).otherwise(0.0))).alias("z"))


def kolmogorov_test(a: Hist, b: Hist) -> TestResult:
    row = kolmogorov_table(a, b).first()
    return TestResult(row.distance, 0, kolmogorov_prob(row.z) if row.distance else 0.0)
