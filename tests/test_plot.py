import xml.etree.ElementTree as ET

from cellwise.functions.axis import Axis
from cellwise.operators import hist, profile
from cellwise.operators.graph import Graph
from cellwise.plans.plot import Axes, nice_step, stack, tick_labels, ticks


def test_ticks():
    assert [nice_step(s) for s in (1, 10, 6, 0.3, 0)] == [0.2, 2, 1, 0.05, 1]
    assert ticks(0, 10) == [0, 2, 4, 6, 8, 10] and tick_labels([0, 0.5, 1]) == ["0.0", "0.5", "1.0"]
    assert tick_labels([0, 2e6]) == ["0", "2e+06"] and tick_labels([]) == []


def test_pictures_are_well_formed(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (1.5, 0.5)], "x double, y double")
    axis = Axis.reg(2, 0, 2)
    one = Axes(title="a < b").hist(hist.fill(df, [axis], ["x"]), errors=True).function(lambda x: x, 0, 2)
    one.profile(profile.profile(df, [axis], ["x"], "y")).errorbar(Graph.of(spark, [1], [1], ey=[0.5]).points)
    two = Axes().hist2d(hist.fill(df, [axis, axis], ["x", "y"]))
    root = ET.fromstring(stack([one, two, Axes()]))
    assert len(root.findall(".//{*}rect")) == 3 + 3 and len(root.findall(".//{*}circle")) == 2 + 2 + 1
