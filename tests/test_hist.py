import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.errors import BinningMismatch
from cellwise.functions.axis import Axis
from cellwise.functions.special import chi_square_prob, igam, igamc, kolmogorov_prob
from cellwise.operators import derive, fit, hist, profile, stats
from cellwise.plans.builder import Hist


def fill(spark, axis, xs, ws=None, **more):
    rows = [(float(x), float(w)) for x, w in zip(xs, ws or [1] * len(xs))]
    return hist.fill(spark.createDataFrame(rows, "x double, w double"), [axis], ["x"], "w" if ws else None, **more)


def contents(h):
    return [r.content for r in h.dense().orderBy("cell").collect()]


def analysis(spark, second=False):
    """Counts i (21 - i) in bins 1..20, or the same a little off."""
    axis, rows = Axis.reg(20, 0, 20), []
    for i in range(1, 21):
        n = i * (21 - i) + ((3 if i % 3 else -2) if second else 0)
        rows.append((i - 0.5, float(n)))
    h = hist.fill(spark.createDataFrame(rows, "x double, w double"), [axis], ["x"], "w")
    return h


def weighted(h, extra):
    """Errors sqrt(content) + extra."""
    e = F.sqrt("content") + extra
    return hist.replace(h, cells=h.cells.withColumn("sumw2", e * e), tracked=True)


def test_moments_and_extrema(spark):
    h = fill(spark, Axis.reg(4, 0, 4), [0.5, 0.5, 1.5, 2.5, 2.5, 2.5])
    assert contents(h) == [0, 2, 1, 3, 0, 0]
    s = stats.summary(h).first()
    assert s.mean_x == pytest.approx(10 / 6) and s.effective_entries == 6 and s.entries == 6
    assert stats.extremum(h).first().cell == 3 and stats.extremum(h, False).first().cell == 4


def test_weights_and_variable_edges(spark):
    h = fill(spark, Axis.reg(3, 0, 3), [0.5, 0.5, 1.5], [2, 3, 1], track=True)
    rows = h.dense().orderBy("cell").collect()
    assert (rows[1].content, rows[1].sumw2) == (5, 13)
    v = fill(spark, Axis.var([0, 1, 4, 10]), [0.5, 2, 3.9, 5, -1, 99])
    assert contents(v) == [1, 1, 2, 1, 1] and v.stats.first().entries == 6


def test_nulls_are_skipped_and_nan_overflows(spark):
    df = spark.createDataFrame([(0.5, 1.0), (None, 1.0), (0.5, None), (float("nan"), 1.0)], "x double, w double")
    h = hist.fill(df, [Axis.reg(1, 0, 1)], ["x"], "w")
    assert contents(h) == [0, 1, 1] and h.stats.first().tsumwx == 0.5


def test_empty_table(spark):
    h = fill(spark, Axis.reg(2, 0, 2), [])
    assert contents(h) == [0, 0, 0, 0] and stats.summary(h).first().mean_x == 0


def test_add_scale_merge(spark):
    axis = Axis.reg(4, 0, 4)
    a = fill(spark, axis, [0.5, 0.5, 1.5], [2, 3, 1], track=True)
    both = hist.merge([a, a])
    rows = both.scale(2).dense().orderBy("cell").collect()
    assert (rows[1].content, rows[1].sumw2) == (20, 104) and both.stats.first().entries == 6
    assert hist.merge([]) is None
    with pytest.raises(BinningMismatch):
        a.add(fill(spark, Axis.reg(5, 0, 4), [1]))


def test_divide_by_empty_bin(spark):
    axis = Axis.reg(2, 0, 2)
    q = fill(spark, axis, [0.5, 1.5]).divide(fill(spark, axis, [0.5]))
    assert contents(q) == [0, 1, 0, 0]


def test_rebin_cumulative_projection(spark):
    axis = Axis.reg(6, 0, 6)
    h = fill(spark, axis, [i - 0.5 for i in range(1, 7)], list(range(1, 7)))
    assert contents(derive.rebin(h, 2)) == [0, 3, 7, 11, 0]
    assert contents(derive.rebin(h, 4)) == [0, 10, 11]
    four = fill(spark, Axis.reg(4, 0, 4), [0.5, 1.5, 2.5, 3.5], [1, 2, 3, 4])
    assert contents(derive.cumulative(four)) == [0, 1, 3, 6, 10, 0] and contents(derive.cumulative(four, False)) == [0, 10, 9, 7, 4, 0]
    df = spark.createDataFrame([(0.5, 0.5, 1.0), (0.5, 1.5, 1.0), (1.5, 0.5, 3.0)], "x double, y double, w double")
    h2 = hist.fill(df, [Axis.reg(2, 0, 2)] * 2, ["x", "y"], "w")
    assert contents(derive.project(h2, "x")) == [0, 2, 3, 0] and contents(derive.project(h2, "y")) == [0, 4, 1, 0]
    with pytest.raises(ValueError):
        derive.rebin(four, 9)


def test_extremum_of_two_axes_is_a_global_cell(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (1.5, 1.5)], "x double, y double")
    assert stats.extremum(hist.fill(df, [Axis.reg(2, 0, 2)] * 2, ["x", "y"])).first().cell == 10


def test_interpolation(spark):
    points = spark.createDataFrame([(float(x),) for x in (5, 5.5, 10.3, 0.7, 0, 100)], "x double")
    got = {r.x: r.y for r in stats.interpolate(analysis(spark), points).collect()}
    assert got == pytest.approx({5: 85, 5.5: 90, 10.3: 110, 0.7: 23.6, 0: 20, 100: 20})


def test_quantiles(spark):
    got = [r.x for r in stats.quantiles(analysis(spark), [0.0, 0.1, 0.25, 0.5, 0.75, 0.9]).orderBy("p").collect()]
    assert got == pytest.approx([0, 3.617647059, 6.357142857, 9.5, 13.64285714, 16.38235294])


def test_compatibility(spark):
    a, b = analysis(spark), analysis(spark, True)
    uu = stats.chi2_test(a, b)
    assert (uu.statistic, uu.ndf) == (pytest.approx(1.011360147), 19) and uu.p_value == pytest.approx(0.9999999991, abs=1e-9)
    assert stats.chi2_test(a, weighted(b, 1), "UW").statistic == pytest.approx(0.8701929209)
    assert stats.chi2_test(weighted(a, 0), weighted(b, 1), "WW").statistic == pytest.approx(0.8722408911)
    ks = stats.kolmogorov_test(a, b)
    assert ks.statistic == pytest.approx(0.003143353462) and ks.p_value == 1.0


def test_special_functions():
    assert igam(1, 2) == pytest.approx(1 - math.exp(-2)) and igamc(2.5, 0.5) + igam(2.5, 0.5) == pytest.approx(1)
    assert chi_square_prob(0, 3) == 1 and chi_square_prob(5, 0) == 0 and chi_square_prob(3.841458820694124, 1) == pytest.approx(0.05)
    assert kolmogorov_prob(1.0) == pytest.approx(0.26999967) and kolmogorov_prob(0.1) == 1 and kolmogorov_prob(7) == 0
    assert kolmogorov_prob(0.7549) == pytest.approx(kolmogorov_prob(0.7551), abs=1e-3)


def test_profile(spark):
    df = spark.createDataFrame([(0.5, 10.0), (0.5, 20.0), (1.5, 5.0), (2.5, 30.0)], "x double, y double")
    p = profile.profile(df, [Axis.reg(4, 0, 4)], ["x"], "y")
    assert {r.ix: r.mean for r in p.values().collect()} == {1: 15, 2: 5, 3: 30}
    s = p.stats.first()
    assert s.tsumwx / s.tsumw == 1.25
    spread = {r.ix: r.error for r in p.values("spread_i").collect()}
    assert spread[1] == pytest.approx(5 / math.sqrt(2)) and spread[2] == pytest.approx(1 / math.sqrt(12))
    assert p.add(p).stats.first().entries == 8


def test_efficiency_and_sparse(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (1.5, None), (9.0, True)], "x double, ok boolean")
    got = {r.ix: (r.total, r.passed, r.efficiency) for r in profile.efficiency(df, Axis.reg(2, 0, 2), "x", F.col("ok")).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0), 3: (1, 1, 1.0)}
    axes = [Axis.reg(2, 0, 2), Axis.reg(3, 0, 3)]
    cells = profile.sparse(df.select("x", F.lit(1.0).alias("y")), axes, ["x", "y"])
    back = cells.select("b0", "b1", *[c.alias(f"u{k}") for k, c in enumerate(profile.unpack_bins(profile.pack_bins(axes), axes))]).collect()
    assert all((r.b0, r.b1) == (r.u0, r.u1) for r in back)


def test_polygons(spark):
    shapes = [profile.rectangle(0, 0, 1, 1), profile.rectangle(1, 1, 2, 2), [(2.0, 2.0), (3.0, 2.0), (2.5, 3.0)]]
    df = spark.createDataFrame([(0.5, 0.5, 1.0), (1.5, 1.5, 4.0), (2.5, 2.3, 1.0), (2.5, 2.3, 1.0), (10.0, 10.0, 1.0)], "x double, y double, w double")
    rows = {r.bin: (r.entries, r.content) for r in profile.poly_fill(df, shapes, "x", "y", "w").collect()}
    assert rows == {0: (1, 0.0), 1: (1, 1.0), 2: (1, 4.0), 3: (2, 2.0)}
    assert profile.polygon_area(shapes[2]) == 0.5


def test_partitions_do_not_change_contents(spark):
    xs = [37 * i % 100 + 0.5 for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    a, b = (hist.fill(df.repartition(n), [Axis.reg(100, 0, 100)], ["x"]) for n in (1, 7))
    assert contents(a) == contents(b) == [0] + [10] * 100 + [0]


def test_gaussian_fit(spark):
    rows = [(k, -5 + 0.2 * (k - 0.5)) for k in range(1, 51)]
    data = [(x, float(math.floor(1000 * math.exp(-0.5 * ((x - 0.5) / 1.3) ** 2) + 0.5))) for _, x in rows]
    h = hist.fill(spark.createDataFrame(data, "x double, w double"), [Axis.reg(50, -5, 5)], ["x"], "w")
    got = fit.fit_hist(h, fit.Model.gaussian())
    assert got.valid
    for a, b in zip(got.params, (1000.827893, 0.498833, 1.297287)):  # to 5e-3 of 1 + |b|, as the constants are stated
        assert abs(a - b) <= 5e-3 * (1 + abs(b))
    x = np.array([v for v, _ in data])
    w = np.array([c for _, c in data])
    same = fit.fit(x, w, np.sqrt(w), fit.Model.gaussian().with_params(900, 0, 1), minimizer="simplex")
    assert same.params == pytest.approx(got.params, rel=1e-5)
    fixed = fit.fit_hist(h, fit.Model.gaussian().fix("mean", 0.5), estimate=False)
    assert fixed.params[1] == 0.5 and fixed.errors[1] == 0


def test_fit_of_too_few_points_is_invalid():
    r = fit.fit([1.0], [1.0], [1.0], fit.Model.gaussian())
    assert not r.valid and math.isnan(r.p_value())


def test_builder_and_storage(spark):
    df = spark.createDataFrame([(0.5, 300.7), (0.5, -500.2)], "x double, w double")
    h = Hist.reg(1, 0, 1).weight().storage("int8").fill(df.where("w > 0"), "x", weight="w")
    assert contents(h) == [0, 127, 0]
    assert contents(Hist.reg(1, 0, 1).storage("int16").fill(df.where("w < 0"), "x", weight="w")) == [0, -500, 0]
    with pytest.raises(ValueError):
        Hist.reg(1, 0, 1).fill(df, "x", "w")
