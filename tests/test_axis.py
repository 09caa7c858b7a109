import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwise.functions.axis import Axis

AXES = [Axis.reg(10, 0, 1), Axis.reg(10, 0, 0.1), Axis.var([0, 1, 4, 10]), Axis.var([k / 10 for k in range(100)])]


@pytest.mark.parametrize("axis", AXES, ids=range(len(AXES)))
def test_column_finds_the_driver_s_bin(spark, axis):
    xs = [-1.0, 0.0, 0.05, 0.1, 0.3, 0.7, 0.99, 1.0, 3.999, 4.0, 9.89, 9.9, 10.0, 1e9, -1e300, float("inf"), float("-inf"), *axis.edges()]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", axis.find_bin("x").alias("b")).collect()
    assert all(r.b == axis.find(r.x) for r in rows)


def test_nan_overflows_and_null_has_no_bin(spark):
    axis = Axis.reg(4, 0, 4)
    rows = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(axis.find_bin("x").alias("b")).collect()
    assert [r.b for r in rows] == [5, None] and axis.find(math.nan) == 5


def test_not_width_bucket():
    axis = Axis.reg(10, 0, 1)
    assert (axis.find(0.3), axis.find(0.7)) == (3, 7)


def test_geometry(spark):
    axis = Axis.var([0, 1, 4, 10])
    rows = spark.range(5).select(F.col("id").cast("int").alias("i")).select("i", axis.center("i").alias("c"), axis.width("i").alias("w"), axis.low_edge("i").alias("l")).collect()
    assert [(r.c, r.w, r.l) for r in rows] == [(axis.bin_center(i), axis.bin_width(i), axis.bin_low_edge(i)) for i in range(5)]
    assert (axis.bin_center(0), axis.bin_width(4)) == (0, 0)


def test_same_binning_and_bad_edges():
    assert Axis.reg(4, 0, 4).same_binning(Axis.var([0, 1, 2, 3, 4])) and not Axis.reg(4, 0, 4).same_binning(Axis.reg(4, 0, 5))
    for edges in ([1], [0, 0], [2, 1]):
        with pytest.raises(ValueError):
            Axis.var(edges)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50), st.floats(-1e3, 1e3), st.floats(0.01, 1e3), st.floats(-3e3, 3e3))
def test_bins_cover_the_line(n, lo, size, x):
    axis = Axis.reg(n, lo, lo + size)
    i = axis.find(x)
    assert 0 <= i <= n + 1 and (i == 0) == (x < axis.lo) and (i == n + 1) == (x >= axis.hi)
