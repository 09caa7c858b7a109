import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwise.errors import DuplicateName, SchemaChanged
from cellwise.functions.axis import Axis
from cellwise.operators import hist
from cellwise.operators.graph import Formula, Graph, normalize
from cellwise.sources import blocks, events
from cellwise.sources.collections import ObjectList, ObjectMap, matrix, multiply, stacked, vector
from cellwise.sources.shared import ensure_checkpoint
from cellwise.sources.store import Store, latest, symmetric
from cellwise.sources.writer import BatchWriter, read_batches
from cellwise.streaming.fill import run_once, stream_cells


def test_entries_follow_the_order(spark):
    ensure_checkpoint(spark)
    df = spark.createDataFrame([(k,) for k in range(100, 0, -1)], "k int").repartition(5)
    rows = events.with_entry(df, "k").orderBy("k").collect()
    assert [r.entry for r in rows] == list(range(100))


def test_chain_friend_alias_and_lists(spark):
    a = spark.createDataFrame([(k, float(k)) for k in range(5)], "entry int, x double")
    assert events.chain(a, a).count() == 10
    with pytest.raises(SchemaChanged):
        events.chain(a, a.select("entry"))
    twice = events.alias(events.friend(a, a.select("entry", (F.col("x") * 100).alias("y"))), z="x + y")
    assert [r.z for r in twice.orderBy("entry").collect()] == [101.0 * k for k in range(5)]
    picks = spark.createDataFrame([(0,), (2,), (2,), (4,)], "entry int")
    assert sorted(r.entry for r in events.select_entries(a, picks).collect()) == [0, 2, 4]
    for lo, hi, n in ((1, 4, 3), (3, 100, 2), (2, 2, 0), (10, 20, 0)):
        assert events.entry_range(a, lo, hi).count() == n


def test_jagged_variant_map_and_late_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, []), (2, [3.0, 4.0, 5.0])], "k int, y array<double>")
    assert [(r.k, r["index"], r.value) for r in events.flat(df, "y", "k").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0), (2, 2, 5.0)]
    v = spark.createDataFrame([(1, 7, None), (2, None, 0.5), (None, None, None)], "t int, a int, b double")
    assert [tuple(r.v) for r in events.variant(v, "v", "t", "a", "b").collect()] == [(1, 7, None), (2, None, 0.5), (0, None, None)]
    old, new = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(3, 3.5), (4, 4.5)], "x int, y double")
    assert [(r.x, r.y) for r in events.extend(old, new).orderBy("x").collect()] == [(1, 0.0), (2, 0.0), (3, 3.5), (4, 4.5)]
    m = events.map_of(spark.createDataFrame([(["a", "b"], [1, 2])], "k array<string>, v array<int>"), "m", "k", "v").first().m
    assert m == {"a": 1, "b": 2}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/objects")
    h = hist.fill(spark.createDataFrame([(0.5,), (1.5,)], "x double"), [Axis.var([0, 1, 4])], ["x"], track=True)
    store.write("h", h)
    store.write("h", h, "sub")
    store.write("p", {"value": 3.5})
    again = store.read("h", "sub")
    assert again.axes == h.axes and again.tracked and sorted(again.dense().collect()) == sorted(h.dense().collect())
    assert store.keys() == ["h", "p"] and store.directories() == ["sub"] and store.read("p") == {"value": 3.5}
    assert sorted((r.directory, r["class"]) for r in store.listing().collect()) == [("", "Hist"), ("", "dict"), ("sub", "Hist")]
    with pytest.raises(DuplicateName):
        store.write("h", h)
    with pytest.raises(ValueError):
        store.write("", h)
    with pytest.raises(KeyError):
        store.read("none")


def test_matrix_keys_and_graphs(spark):
    assert sorted(tuple(r) for r in symmetric(spark, [[1, 2], [3]]).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]
    keys = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "name string, cycle int, payload string")
    assert {r.name: r.payload for r in latest(keys).collect()} == {"a": "new", "b": "x"}
    g = Graph.of(spark, [0, 1], [1, 2], ey=[(0.1, 0.3), (0.0, 0.0)]).add_y_error("sys", [(0.1, 0.2), (0.3, 0.4)])
    assert [r.sigma for r in g.fit_points().orderBy("x").collect()] == [0.2, 1.0]
    f = Formula("f", "[0]*x + [1]", (2.0, 1.0))
    assert f.npar == 2 and f.normal == "[p0]*x + [p1]"
    assert [r.y for r in g.points.selectExpr(f"{f.expression()} as y").orderBy("y").collect()] == [1.0, 3.0]
    assert spark.createDataFrame([("[0]+[12]",)], "f string").select(normalize("f")).first()[0] == "[p0]+[p12]"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(list(blocks.TAGS)))
def test_blocks_round_trip(data, codec):
    for payload in (data, data * 5):
        assert blocks.decompress(blocks.compress(payload, codec), len(payload)) == payload


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 500))
def test_blocks_reject_rubbish(data, size):
    try:
        blocks.decompress(data, size)
    except Exception as e:
        assert not isinstance(e, (MemoryError, SystemExit))


def test_lz4_matches():
    # literals "ab", then a match of eight bytes two back, then literals "xyz12"
    assert blocks.lz4_decode(bytes([0x24]) + b"ab" + bytes([2, 0]) + bytes([0x50]) + b"xyz12", 15) == b"ab" + b"ab" * 4 + b"xyz12"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    axis = Axis.reg(10, 0, 30)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.ix: r.content for r in run_once(stream_cells(stream, axis, "x"), f"cells_{os.getpid()}").collect()}
    want = {r.ix: r.content for r in hist.fill(df, [axis], ["x"]).cells.collect()}
    assert got == want


def test_batches(spark, tmp_path):
    writer = BatchWriter(f"file://{tmp_path}/t", rows_per_file=2)
    for k in range(3):
        writer.write_batch(spark.createDataFrame([(k * 4 + i, float(i)) for i in range(4)], "x int, y double"))
    writer.write_batch(spark.createDataFrame([(8, 0.5)], "x int, y double"), 2)  # again, in place of the third
    with pytest.raises(SchemaChanged):
        writer.write_batch(spark.createDataFrame([(1,)], "x int"))
    assert writer.finish() == 3 and sorted(r.x for r in read_batches(spark, writer.path).collect()) == [*range(8), 8]
    with pytest.raises(ValueError):
        writer.write_batch(spark.createDataFrame([(1, 1.0)], "x int, y double"))


def test_stream_into_batches(spark, tmp_path):
    spark.range(20).repartition(4).write.parquet(f"{tmp_path}/in")
    writer = BatchWriter(f"file://{tmp_path}/out")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(writer.sink()).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.id for r in read_batches(spark, writer.path).collect()) == list(range(20)) and writer.count > 1


def test_collections(spark):
    some = ObjectList([1, "a"]).add(2)
    assert some.items(int) == [1, 2] and some.class_names() == ["int", "str", "int"]
    named = ObjectMap().insert("k", 1).insert("l", 2).insert("k", 3)
    assert named.get("k") == 3 and named.get("z") is None and named.string_keys() == ["k", "l"] and named.values() == [3, 2]
    h = hist.fill(spark.createDataFrame([(0.5,), (0.5,), (1.5,)], "x double"), [Axis.reg(2, 0, 2)], ["x"])
    assert [(r.ordinal, r.upto) for r in stacked([h, h]).where("cell = 1").orderBy("ordinal").collect()] == [(0, 2.0), (1, 4.0)]
    a = matrix(spark, [[1, 2], [3, 4]])
    assert sorted(tuple(r) for r in multiply(a, a).collect()) == [(0, 0, 7.0), (0, 1, 10.0), (1, 0, 15.0), (1, 1, 22.0)]
    assert [r.v for r in vector(spark, [1, 2]).orderBy("i").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError):
        matrix(spark, [[1], [1, 2]])
