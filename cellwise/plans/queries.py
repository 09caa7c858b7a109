"""Queries over the provided tables, one an operator, with the SQL that states the same result.

Doubles are rounded well above the noise of summation order, on a grid no coarser than their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axis import Axis
from ..operators import derive, fit, hist, profile, stats
from ..operators.graph import normalize
from ..sources import events
from ..sources.shared import ensure_checkpoint, ship
from ..streaming import fill as streaming
from .builder import Hist

PRICE, QTY, DISC, TAX = Axis.reg(100, 0, 100_000), Axis.reg(25, 1, 51), Axis.reg(10, 0, 0.1), Axis.reg(4, 0, 0.08)
COARSE, BALANCE = Axis.reg(20, 0, 100_000), Axis.reg(20, 0, 8000)
EDGES = [0.0, 1000.0, 5000.0, 20000.0, 50000.0, 75000.0, 110000.0]
FLAGS = ["A", "N"]
POLYGONS = [profile.rectangle(0, 0, 10, 20000), [(10.0, 0.0), (40.0, 0.0), (40.0, 60000.0)], [(20.0, 50000.0), (60.0, 50000.0), (60.0, 110000.0), (20.0, 110000.0)]]
DISCOUNTED = "1 - l_discount"


def read(spark, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- SQL pieces


def d(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def sql_bin(x: str, a: Axis) -> str:
    if a.edges_:
        inside = " + ".join(f"(CASE WHEN {x} >= {d(e)} THEN 1 ELSE 0 END)" for e in a.edges_)
        inside = f"LEAST({inside}, {a.n})"
    else:
        inside = f"LEAST(CAST(FLOOR(({x} - {d(a.lo)}) / {d(a.step)}) AS INTEGER) + 1, {a.n})"
    return f"CAST(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR {x} >= {d(a.hi)} THEN {a.n + 1} WHEN {x} < {d(a.lo)} THEN 0 ELSE {inside} END AS INTEGER)"


def sql_center(i: str, a: Axis) -> str:
    return f"({d(a.lo)} + {d(a.step)} * ({i} - 0.5))"


def sql_cells(x: str, a: Axis, weight: str = "1.0", table: str = "lineitem", where: str = "TRUE") -> str:
    """Dense cells of one axis as a subquery: ix, content, sumw2."""
    return f"""(SELECT CAST(g.i AS INTEGER) AS ix, COALESCE(f.content, 0) AS content, COALESCE(f.sumw2, 0) AS sumw2 FROM range({a.cells}) g(i)
      LEFT JOIN (SELECT {sql_bin(x, a)} AS ix, SUM(CAST({weight} AS DOUBLE)) AS content, SUM(CAST({weight} AS DOUBLE) * CAST({weight} AS DOUBLE)) AS sumw2 FROM {table} WHERE {where} GROUP BY 1) f ON f.ix = g.i)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- fills


@query(f"SELECT ix, ROUND(content, 4) AS content, ROUND(sumw2, 4) AS sumw2 FROM {sql_cells('l_extendedprice', PRICE, DISCOUNTED)}")
def th1_fill_weighted_sumw2(spark, sf_dir):
    h = hist.fill(items(spark, sf_dir), [PRICE], ["l_extendedprice"], F.expr(DISCOUNTED), track=True)
    return rounded(h.dense().select("ix", "content", "sumw2"), 4, "content", "sumw2")


@query(f"SELECT ix, CAST(content AS DOUBLE) AS content FROM {sql_cells('l_discount', DISC)}")
def th1_fill_uniform(spark, sf_dir):
    return hist.fill(items(spark, sf_dir), [DISC], ["l_discount"]).dense().select("ix", "content")


@query(f"SELECT ix, CAST(content AS DOUBLE) AS content FROM {sql_cells('l_extendedprice', Axis.var(EDGES))}")
def th1_fill_variable(spark, sf_dir):
    return Hist.var(EDGES).fill(items(spark, sf_dir), "l_extendedprice").dense().select("ix", "content")


@query(f"SELECT ix, CAST(content AS DOUBLE) AS content FROM {sql_cells('c_acctbal', BALANCE, table='customer')}")
def th1_fill_underflow(spark, sf_dir):
    return hist.fill(read(spark, sf_dir, "customer"), [BALANCE], ["c_acctbal"]).dense().select("ix", "content")


@query("SELECT CAST(CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#13' THEN 3 ELSE 4 END AS INTEGER) AS ix, CAST(COUNT(*) AS DOUBLE) AS content FROM part GROUP BY 1")
def th1_fill_labels(spark, sf_dir):
    h = Hist.labels(["Brand#11", "Brand#12", "Brand#13"]).fill(read(spark, sf_dir, "part"), "p_brand")
    return h.cells.select("ix", "content")


@query(f"SELECT {sql_bin('l_quantity', QTY)} AS ix, {sql_bin('l_extendedprice', COARSE)} AS iy, ROUND(SUM({DISCOUNTED}), 4) AS content FROM lineitem GROUP BY 1, 2")
def th2_fill(spark, sf_dir):
    h = hist.fill(items(spark, sf_dir), [QTY, COARSE], ["l_quantity", "l_extendedprice"], F.expr(DISCOUNTED))
    return rounded(h.cells.select("ix", "iy", "content"), 4, "content")


@query(f"SELECT {sql_bin('l_quantity', QTY)} AS ix, {sql_bin('l_extendedprice', COARSE)} AS iy, {sql_bin('l_discount', DISC)} AS iz, CAST(COUNT(*) AS DOUBLE) AS content FROM lineitem GROUP BY 1, 2, 3")
def th3_fill(spark, sf_dir):
    return hist.fill(items(spark, sf_dir), [QTY, COARSE, DISC], ["l_quantity", "l_extendedprice", "l_discount"]).cells.select("ix", "iy", "iz", "content")


def _profile_sql(mode: str) -> str:
    spread = "ABS(s2 / sw - (s / sw) * (s / sw))"
    error = {"mean": f"SQRT({spread} / sw)", "spread": f"SQRT({spread})", "spread_i": f"CASE WHEN {spread} <= 0 THEN 1 / SQRT(12 * sw) ELSE SQRT({spread} / sw) END", "spread_g": "1 / SQRT(sw)"}[mode]
    return f"SELECT ix, ROUND(s / sw, 5) AS mean, ROUND({error}, 5) AS error FROM (SELECT {sql_bin('l_quantity', QTY)} AS ix, CAST(COUNT(*) AS DOUBLE) AS sw, SUM(l_discount) AS s, SUM(l_discount * l_discount) AS s2 FROM lineitem GROUP BY 1)"


def _profile(mode):
    def run(spark, sf_dir):
        p = Hist.reg(25, 1, 51).profile().fill(items(spark, sf_dir), "l_quantity", "l_discount")
        return rounded(p.values(mode).select("ix", "mean", "error"), 5, "mean", "error")

    run.__name__ = f"tprofile_{mode}"
    return run


for _mode in profile.ERROR_MODES:
    query(_profile_sql(_mode))(_profile(_mode))


@query(f"SELECT ix, iy, ROUND(s / sw, 6) AS mean FROM (SELECT {sql_bin('l_quantity', QTY)} AS ix, {sql_bin('l_extendedprice', COARSE)} AS iy, SUM({DISCOUNTED}) AS sw, SUM(({DISCOUNTED}) * l_tax) AS s FROM lineitem GROUP BY 1, 2)")
def tprofile2d_weighted(spark, sf_dir):
    p = profile.profile(items(spark, sf_dir), [QTY, COARSE], ["l_quantity", "l_extendedprice"], "l_tax", F.expr(DISCOUNTED))
    return rounded(p.values().select("ix", "iy", "mean"), 6, "mean")


@query(f"SELECT {sql_bin('l_quantity', QTY)} AS ix, {sql_bin('l_discount', DISC)} AS iy, {sql_bin('l_tax', TAX)} AS iz, ROUND(AVG(l_extendedprice), 3) AS mean FROM lineitem GROUP BY 1, 2, 3")
def tprofile3d(spark, sf_dir):
    p = profile.profile(items(spark, sf_dir), [QTY, DISC, TAX], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(p.values().select("ix", "iy", "iz", "mean"), 3, "mean")


@query(f"SELECT {sql_bin('l_quantity', QTY)} AS ix, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 3) AS mean FROM lineitem WHERE l_extendedprice BETWEEN 10000 AND 50000 GROUP BY 1")
def tprofile_limits(spark, sf_dir):
    p = profile.profile(items(spark, sf_dir), [QTY], ["l_quantity"], "l_extendedprice", limits=(10_000, 50_000))
    return rounded(p.values().select("ix", F.col("sumw").cast("long").alias("n"), "mean"), 3, "mean")


@query(f"SELECT ROUND(SUM(CASE WHEN ix BETWEEN 1 AND 25 THEN l_quantity END) / COUNT(CASE WHEN ix BETWEEN 1 AND 25 THEN 1 END), 6) AS mean, COUNT(*) AS entries FROM (SELECT {sql_bin('l_quantity', QTY)} AS ix, l_quantity FROM lineitem)")
def tprofile_moments(spark, sf_dir):
    p = profile.profile(items(spark, sf_dir), [QTY], ["l_quantity"], "l_extendedprice")
    return p.stats.select(F.round(F.try_divide("tsumwx", "tsumw"), 6).alias("mean"), F.col("entries").cast("long").alias("entries"))


@query(f"SELECT {sql_bin('l_quantity', QTY)} AS ix, COUNT(*) AS total, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS passed, ROUND(COUNT(*) FILTER (WHERE l_returnflag = 'R') / CAST(COUNT(*) AS DOUBLE), 8) AS efficiency FROM lineitem GROUP BY 1")
def efficiency(spark, sf_dir):
    return rounded(profile.efficiency(items(spark, sf_dir), QTY, "l_quantity", F.col("l_returnflag") == "R"), 8, "efficiency")


_SPARSE = ", ".join(f"{sql_bin(x, a)} AS b{k}" for k, (x, a) in enumerate((("l_quantity", QTY), ("l_extendedprice", COARSE), ("l_discount", DISC), ("l_tax", TAX))))


@query(f"SELECT {_SPARSE}, COUNT(*) AS content FROM lineitem GROUP BY 1, 2, 3, 4")
def thnsparse(spark, sf_dir):
    return profile.sparse(items(spark, sf_dir), [QTY, COARSE, DISC, TAX], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(f"SELECT b0 + b1 * 32 + CAST(b2 AS BIGINT) * 1024 AS code, b0, b1, b2, COUNT(*) AS content FROM (SELECT {_SPARSE} FROM lineitem) GROUP BY 1, 2, 3, 4")
def thnsparse_packed(spark, sf_dir):
    axes = [QTY, COARSE, DISC]
    cells = profile.sparse(items(spark, sf_dir), axes, ["l_quantity", "l_extendedprice", "l_discount"]).select(profile.pack_bins(axes).alias("code"), "content")
    return cells.select("code", *[c.alias(f"b{k}") for k, c in enumerate(profile.unpack_bins(F.col("code"), axes))], "content")


def _sql_inside(points, x: str, y: str) -> str:
    tests = []
    for (x0, y0), (x1, y1) in zip(points, points[-1:] + points[:-1]):
        if y0 != y1:
            tests.append(f"(CASE WHEN (({d(y0)} > {y}) <> ({d(y1)} > {y})) AND ({x} < {d(x1 - x0)} * ({y} - {d(y0)}) / {d(y1 - y0)} + {d(x0)}) THEN 1 ELSE 0 END)")
    return f"(({' + '.join(tests)}) % 2 = 1)"


_POLY = "CASE " + " ".join(f"WHEN {_sql_inside(p, 'l_quantity', 'l_extendedprice')} THEN {k}" for k, p in enumerate(POLYGONS, 1)) + " ELSE 0 END"


@query(f"SELECT bin, COUNT(*) AS entries, ROUND(SUM(CASE WHEN bin > 0 THEN {DISCOUNTED} ELSE 0 END), 4) AS content FROM (SELECT CAST({_POLY} AS INTEGER) AS bin, l_discount FROM lineitem) GROUP BY 1")
def th2poly(spark, sf_dir):
    return rounded(profile.poly_fill(items(spark, sf_dir), POLYGONS, "l_quantity", "l_extendedprice", F.expr(DISCOUNTED)), 4, "content")


@query(f"SELECT 'price' AS name, {sql_bin('l_extendedprice', COARSE)} AS ix, COUNT(*) AS entries, ROUND(SUM({DISCOUNTED}), 4) AS content FROM lineitem GROUP BY 2 UNION ALL SELECT 'quantity', {sql_bin('l_quantity', QTY)}, COUNT(*), CAST(COUNT(*) AS DOUBLE) FROM lineitem GROUP BY 2 UNION ALL SELECT 'discount', {sql_bin('l_discount', DISC)}, COUNT(*), ROUND(SUM(l_tax), 4) FROM lineitem GROUP BY 2")
def fill_many(spark, sf_dir):
    specs = {"price": (COARSE, "l_extendedprice", F.expr(DISCOUNTED)), "quantity": (QTY, "l_quantity", None), "discount": (DISC, "l_discount", "l_tax")}
    return rounded(hist.fill_many(items(spark, sf_dir), specs).select("name", "ix", "entries", "content"), 4, "content")


# ---- algebra


def price(spark, sf_dir, where: str = "true", weight: str | None = None, by=(), track=False):
    return hist.fill(items(spark, sf_dir).where(where), [PRICE], ["l_extendedprice"], F.expr(weight) if weight else None, by, track)


@query(f"SELECT l_returnflag, {sql_bin('l_extendedprice', PRICE)} AS ix, CAST(COUNT(*) AS DOUBLE) AS content FROM lineitem GROUP BY 1, 2")
def hist_by_group(spark, sf_dir):
    return price(spark, sf_dir, by=("l_returnflag",)).cells.select("l_returnflag", "ix", "content")


@query(f"SELECT {sql_bin('l_extendedprice', PRICE)} AS ix, CAST(COUNT(*) AS DOUBLE) AS content FROM lineitem GROUP BY 1")
def hist_merge_groups(spark, sf_dir):
    return hist.merge_groups(price(spark, sf_dir, by=("l_returnflag",)), "l_returnflag").cells.select("ix", "content")


@query(f"SELECT ix, CAST(content AS DOUBLE) AS content FROM {sql_cells('l_extendedprice', PRICE)}")
def hist_merge(spark, sf_dir):
    parts = [price(spark, sf_dir, f"l_returnflag = '{f}'") for f in ("A", "N", "R")]
    return hist.merge(parts).dense().select("ix", "content")


_A = sql_cells("l_extendedprice", PRICE, DISCOUNTED, where="l_linestatus = 'F'")
_B = sql_cells("l_extendedprice", PRICE, where="l_linestatus = 'O'")


def _ab(spark, sf_dir):
    return price(spark, sf_dir, "l_linestatus = 'F'", DISCOUNTED, track=True), price(spark, sf_dir, "l_linestatus = 'O'")


@query(f"SELECT ix, ROUND(content * 2.5, 4) AS content, ROUND(sumw2 * 6.25, 4) AS sumw2 FROM {_A}")
def hist_scale(spark, sf_dir):
    return rounded(_ab(spark, sf_dir)[0].scale(2.5).dense().select("ix", "content", "sumw2"), 4, "content", "sumw2")


@query(f"SELECT a.ix, ROUND(a.content - 0.5 * b.content, 4) AS content, ROUND(a.sumw2 + 0.25 * b.content, 4) AS sumw2 FROM {_A} a JOIN {_B} b ON a.ix = b.ix")
def hist_add_scaled(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return rounded(a.add(b, -0.5).dense().select("ix", "content", "sumw2"), 4, "content", "sumw2")


@query(f"SELECT a.ix, ROUND(a.content * b.content, 2) AS content, ROUND(a.sumw2 * b.content * b.content + b.content * a.content * a.content, 1) AS sumw2 FROM {_A} a JOIN {_B} b ON a.ix = b.ix")
def hist_multiply(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    out = a.multiply(b).dense().select("ix", "content", "sumw2")
    return rounded(rounded(out, 2, "content"), 1, "sumw2")


@query(f"SELECT a.ix, CASE WHEN b.content = 0 THEN 0 ELSE ROUND(a.content / b.content, 7) END AS content, CASE WHEN b.content = 0 THEN 0 ELSE ROUND((a.sumw2 * b.content * b.content + b.content * a.content * a.content) / (b.content * b.content * b.content * b.content), 7) END AS sumw2 FROM {_A} a JOIN {_B} b ON a.ix = b.ix")
def hist_divide(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return rounded(a.divide(b).dense().select("ix", "content", "sumw2"), 7, "content", "sumw2")


@query(f"SELECT ROUND(SUM(content) FILTER (WHERE ix BETWEEN 1 AND 100), 3) AS integral, ROUND(SUM(content), 3) AS total FROM {_A}")
def hist_integral(spark, sf_dir):
    a = _ab(spark, sf_dir)[0]
    return rounded(a.cells.agg(F.sum(F.when(a.in_range(), F.col("content"))).alias("integral"), F.sum("content").alias("total")), 3, "integral", "total")


@query(f"SELECT ix, CAST(LEAST(TRUNC(content), 127) AS DOUBLE) AS content FROM {_A}")
def hist_stored_int8(spark, sf_dir):
    return _ab(spark, sf_dir)[0].stored_as("int8").dense().select("ix", "content")


# ---- derived histograms


@query(f"SELECT CAST(CASE WHEN ix = 0 THEN 0 WHEN ix > 98 THEN 15 ELSE FLOOR((ix - 1) / 7.0) + 1 END AS INTEGER) AS ix, ROUND(SUM(content), 4) AS content, ROUND(SUM(sumw2), 4) AS sumw2 FROM {_A} GROUP BY 1")
def rebin(spark, sf_dir):
    return rounded(derive.rebin(_ab(spark, sf_dir)[0], 7).dense().select("ix", "content", "sumw2"), 4, "content", "sumw2")


_Q2 = f"SELECT {sql_bin('l_quantity', QTY)} AS ix, {sql_bin('l_extendedprice', COARSE)} AS iy, CAST(COUNT(*) AS DOUBLE) AS content FROM lineitem GROUP BY 1, 2"
_Q3 = f"SELECT {sql_bin('l_quantity', QTY)} AS ix, {sql_bin('l_extendedprice', COARSE)} AS iy, {sql_bin('l_discount', DISC)} AS iz, CAST(COUNT(*) AS DOUBLE) AS content FROM lineitem GROUP BY 1, 2, 3"


def _sql_group(k: str, n: int, g: int) -> str:
    return f"CAST(CASE WHEN {k} = 0 THEN 0 WHEN {k} > {n // g * g} THEN {n // g + 1} ELSE FLOOR(({k} - 1) / {float(g)}) + 1 END AS INTEGER)"


def _h2(spark, sf_dir):
    return hist.fill(items(spark, sf_dir), [QTY, COARSE], ["l_quantity", "l_extendedprice"])


def _h3(spark, sf_dir):
    return hist.fill(items(spark, sf_dir), [QTY, COARSE, DISC], ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"SELECT {_sql_group('ix', 25, 4)} AS ix, {_sql_group('iy', 20, 3)} AS iy, SUM(content) AS content FROM ({_Q2}) GROUP BY 1, 2")
def rebin2d(spark, sf_dir):
    return derive.rebin(_h2(spark, sf_dir), 4, 3).cells.select("ix", "iy", "content")


@query(f"SELECT {_sql_group('ix', 25, 5)} AS ix, {_sql_group('iy', 20, 4)} AS iy, {_sql_group('iz', 10, 3)} AS iz, SUM(content) AS content FROM ({_Q3}) GROUP BY 1, 2, 3")
def rebin3d(spark, sf_dir):
    return derive.rebin(_h3(spark, sf_dir), 5, 4, 3).cells.select("ix", "iy", "iz", "content")


@query(f"SELECT CAST(CASE WHEN ix < 21 THEN 0 WHEN ix > 61 THEN 42 ELSE ix - 20 END AS INTEGER) AS ix, ROUND(SUM(content), 4) AS content FROM {_A} GROUP BY 1")
def slice_range(spark, sf_dir):
    return rounded(derive.slice_range(_ab(spark, sf_dir)[0], 20_000, 60_000).dense().select("ix", "content"), 4, "content")


@query(f"SELECT ROUND(SUM(content), 4) AS tsumw, ROUND(SUM(content * {sql_center('ix', PRICE)}) / SUM(content), 4) AS mean FROM {_A} WHERE ix BETWEEN 21 AND 61")
def slice_moments(spark, sf_dir):
    h = derive.slice_range(_ab(spark, sf_dir)[0], 20_000, 60_000)
    return h.stats.select(F.round("tsumw", 4).alias("tsumw"), F.round(F.try_divide("tsumwx", "tsumw"), 4).alias("mean"))


def _cumulative(forward: bool):
    def run(spark, sf_dir):
        return rounded(derive.cumulative(_ab(spark, sf_dir)[0], forward).dense().select("ix", "content"), 3, "content")

    run.__name__ = "cumulative_forward" if forward else "cumulative_backward"
    return run


for _forward, _order in ((True, "ix"), (False, "ix DESC")):
    query(f"SELECT ix, ROUND(SUM(content) OVER (ORDER BY {_order} ROWS UNBOUNDED PRECEDING), 3) AS content FROM {_A} WHERE ix BETWEEN 1 AND 100 UNION ALL SELECT ix, CAST(0 AS DOUBLE) FROM {_A} WHERE ix IN (0, 101)")(_cumulative(_forward))


def _projection(onto: str, of):
    def run(spark, sf_dir):
        h = derive.project(of(spark, sf_dir), onto)
        return h.cells.select(*h.keys, "content")

    run.__name__ = f"projection_{onto}" if of is _h2 else f"projection3_{onto}"
    return run


_RANGE = {"x": "ix BETWEEN 1 AND 25", "y": "iy BETWEEN 1 AND 20", "z": "iz BETWEEN 1 AND 10"}
for _source, _of, _axes in ((_Q2, _h2, "xy"), (_Q3, _h3, "xyz")):
    for _onto in ("x", "y") if _axes == "xy" else ("x", "y", "z", "xy", "xz", "yz"):
        _cols = ", ".join(f"i{a} AS i{n}" for a, n in zip(_onto, "xy"))
        _cond = " AND ".join(_RANGE[a] for a in _axes if a not in _onto)
        query(f"SELECT {_cols}, SUM(content) AS content FROM ({_source}) WHERE {_cond} GROUP BY {', '.join(f'i{a}' for a in _onto)}")(_projection(_onto, _of))


@query(f"SELECT ROUND(SUM(l_extendedprice) / COUNT(*), 4) AS mean_x, COUNT(*) AS n FROM lineitem WHERE l_extendedprice >= 0 AND l_extendedprice < 100000 AND {sql_bin('l_quantity', QTY)} BETWEEN 1 AND 25")
def projection_moments(spark, sf_dir):
    s = derive.project(_h2(spark, sf_dir), "y").stats
    return s.select(F.round(F.try_divide("tsumwx", "tsumw"), 4).alias("mean_x"), F.col("tsumw").cast("long").alias("n"))


for _along, _keep, _other, _axis in (("x", "ix", "iy", COARSE), ("y", "iy", "ix", QTY)):

    def _profile_of(along):
        def run(spark, sf_dir):
            p = derive.profile_of(_h2(spark, sf_dir), along).values()
            return rounded(p.select("ix", "mean"), 4, "mean")

        run.__name__ = f"profile_{along}"
        return run

    query(f"SELECT {_keep} AS ix, ROUND(SUM(content * {sql_center(_other, _axis)}) / SUM(content), 4) AS mean FROM ({_Q2}) WHERE {_other} BETWEEN 1 AND {_axis.n} GROUP BY {_keep}")(_profile_of(_along))


# ---- statistics


@query(f"""SELECT CAST(COUNT(*) AS DOUBLE) AS entries, ROUND(SUM(w) * SUM(w) / SUM(w * w), 2) AS effective_entries, ROUND(SUM(w * x) / SUM(w), 3) AS mean_x, ROUND(SQRT(SUM(w * x * x) / SUM(w) - (SUM(w * x) / SUM(w)) * (SUM(w * x) / SUM(w))), 3) AS std_x
  FROM (SELECT {DISCOUNTED} AS w, l_extendedprice AS x FROM lineitem WHERE l_linestatus = 'F') WHERE x < 100000""".replace("CAST(COUNT(*) AS DOUBLE) AS entries, ", ""))
def mean_std(spark, sf_dir):
    return rounded(rounded(stats.summary(_ab(spark, sf_dir)[0]).drop("entries"), 3, "mean_x", "std_x"), 2, "effective_entries")


@query(f"SELECT CAST(ix AS INTEGER) AS cell, CAST(content AS DOUBLE) AS content FROM {_B} WHERE ix BETWEEN 1 AND 100 ORDER BY content DESC, ix LIMIT 1")
def maximum_bin(spark, sf_dir):
    return stats.extremum(_ab(spark, sf_dir)[1])


@query(f"SELECT CAST(ix AS INTEGER) AS cell, CAST(content AS DOUBLE) AS content FROM {_B} WHERE ix BETWEEN 1 AND 100 ORDER BY content, ix LIMIT 1")
def minimum_bin(spark, sf_dir):
    return stats.extremum(_ab(spark, sf_dir)[1], largest=False)


@query(f"SELECT CAST(ix + 27 * iy AS INTEGER) AS cell, content FROM ({_Q2}) WHERE {_RANGE['x']} AND {_RANGE['y']} ORDER BY content DESC, ix, iy LIMIT 1")
def maximum_bin_2d(spark, sf_dir):
    return stats.extremum(_h2(spark, sf_dir))


@query(f"SELECT ix, ROUND(content / (1000 * SUM(content) OVER ()), 10) AS density FROM {_B} WHERE ix BETWEEN 1 AND 100")
def density(spark, sf_dir):
    return rounded(stats.density(_ab(spark, sf_dir)[1]), 10, "density")


@query(f"SELECT ix, ROUND(CASE WHEN sumw2 > 0 THEN content * content / sumw2 ELSE content END, 5) AS count FROM {_A} WHERE ix BETWEEN 1 AND 100")
def counts(spark, sf_dir):
    return rounded(stats.counts(_ab(spark, sf_dir)[0]), 5, "count")


@query(f"SELECT ix, ROUND(SQRT(sumw2), 6) AS error FROM {_A}")
def bin_errors(spark, sf_dir):
    return rounded(stats.bins(_ab(spark, sf_dir)[0]).select("ix", "error"), 6, "error")


@query(f"SELECT ROUND(SUM(content), 4) AS integral FROM {_A} WHERE ix BETWEEN 11 AND 51")
def integral_range(spark, sf_dir):
    return rounded(stats.integral_range(_ab(spark, sf_dir)[0], 10_000, 50_000), 4, "integral")


@query(f"SELECT ix, ROUND(content, 4) AS content FROM {_A} WHERE ix = 13")
def content_at(spark, sf_dir):
    return rounded(stats.at(_ab(spark, sf_dir)[0], 12_345.0), 4, "content")


@query(f"""SELECT x, ROUND(CASE WHEN x <= 500 THEN (SELECT content FROM {_B} WHERE ix = 1) WHEN x >= 99500 THEN (SELECT content FROM {_B} WHERE ix = 100)
  ELSE a.content + (x - (500 + 1000.0 * (l - 1))) * (b.content - a.content) / 1000 END, 5) AS y
  FROM (SELECT CAST(x AS DOUBLE) AS x, CAST(GREATEST(1, CEIL((x - 500) / 1000.0)) AS INTEGER) AS l FROM (SELECT UNNEST([-5, 250, 1700, 12500, 33333, 50000, 99700, 200000]) AS x))
  LEFT JOIN {_B} a ON a.ix = l LEFT JOIN {_B} b ON b.ix = l + 1""")
def interpolate(spark, sf_dir):
    points = spark.createDataFrame([(float(x),) for x in (-5, 250, 1700, 12500, 33333, 50000, 99700, 200000)], "x double")
    return rounded(stats.interpolate(_ab(spark, sf_dir)[1], points), 5, "y")


_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"""WITH c AS (SELECT ix, SUM(content) OVER (ORDER BY ix) / SUM(content) OVER () AS hi FROM {_B} WHERE ix BETWEEN 1 AND 100),
  k AS (SELECT ix, COALESCE(LAG(hi) OVER (ORDER BY ix), 0) AS lo, hi FROM c), p AS (SELECT UNNEST({_PROBS})::DOUBLE AS p),
  b AS (SELECT p, MAX(ix) AS ix FROM p JOIN k ON k.lo <= p.p GROUP BY p)
  SELECT p, ROUND(1000.0 * (ix - 1) + 1000.0 * (p - lo) / (hi - lo), 3) AS x FROM b JOIN k USING (ix)""")
def quantiles(spark, sf_dir):
    return rounded(stats.quantiles(_ab(spark, sf_dir)[1], _PROBS), 3, "x")


_PAIR = f"(SELECT a.ix, a.content AS c1, a.sumw2 AS e1, b.content AS c2, b.sumw2 AS e2, SUM(a.content) OVER () AS s1, SUM(b.content) OVER () AS s2 FROM {_B} a JOIN {_A} b ON a.ix = b.ix WHERE a.ix BETWEEN 1 AND 100)"
_F = sql_cells("l_extendedprice", PRICE, where="l_linestatus = 'F'")
_UU = f"(SELECT a.ix, a.content AS c1, b.content AS c2, SUM(a.content) OVER () AS s1, SUM(b.content) OVER () AS s2 FROM {_B} a JOIN {_F} b ON a.ix = b.ix WHERE a.ix BETWEEN 1 AND 100)"


@query(f"SELECT ROUND(SUM((s2 * c1 - s1 * c2) * (s2 * c1 - s1 * c2) / (c1 + c2) / (s1 * s2)), 5) AS chi2, COUNT(*) - 1 AS ndf FROM {_UU} WHERE c1 <> 0 OR c2 <> 0")
def chi2_uu(spark, sf_dir):
    b = price(spark, sf_dir, "l_linestatus = 'F'")
    return rounded(stats.chi2_table(_ab(spark, sf_dir)[1], b, "UU"), 5, "chi2")


@query(f"SELECT ROUND(SUM((s1 * c2 - s2 * c1) * (s1 * c2 - s2 * c1) / (s1 * s1 * e2 + s2 * s2 * e1)), 5) AS chi2, COUNT(*) - 1 AS ndf FROM {_PAIR} WHERE e1 <> 0 OR e2 <> 0")
def chi2_ww(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return rounded(stats.chi2_table(b, a, "WW"), 5, "chi2")


@query(f"""SELECT ROUND(SUM(CASE WHEN q * s1 > 0 THEN (c1 - q * s1) * (c1 - q * s1) / (q * s1) ELSE 0 END + CASE WHEN e2 > 0 THEN (c2 - q * s2) * (c2 - q * s2) / e2 ELSE 0 END), 5) AS chi2, COUNT(*) - 1 AS ndf
  FROM (SELECT *, ((s2 * c2 - s1 * e2) + SQRT((s2 * c2 - s1 * e2) * (s2 * c2 - s1 * e2) + 4 * s2 * s2 * c1 * e2)) / (2 * s2 * s2) AS q
    FROM (SELECT ix, c1, c2, s1, s2, CASE WHEN c2 = 0 AND e2 = 0 THEN SUM(e2) OVER () / s2 ELSE e2 END AS e2 FROM {_PAIR}) WHERE c1 <> 0 OR c2 <> 0)""")
def chi2_uw(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return rounded(stats.chi2_table(b, a, "UW"), 5, "chi2")


@query(f"SELECT ROUND(MAX(dd), 8) AS distance, ROUND(MAX(dd) * SQRT(MAX(s1) * MAX(s2) / (MAX(s1) + MAX(s2))), 6) AS z FROM (SELECT ABS(SUM(c1) OVER (ORDER BY ix) / s1 - SUM(c2) OVER (ORDER BY ix) / s2) AS dd, s1, s2 FROM {_UU})")
def kolmogorov(spark, sf_dir):
    b = price(spark, sf_dir, "l_linestatus = 'F'")
    return rounded(rounded(stats.kolmogorov_table(_ab(spark, sf_dir)[1], b), 8, "distance"), 6, "z")


# ---- fits

_PTS = f"(SELECT {sql_center('ix', PRICE)} / 1000 AS x, content AS y, SQRT(content) AS s FROM {_B} WHERE ix BETWEEN 1 AND 100 AND content > 0)"


def _points(spark, sf_dir):
    return fit.points(_ab(spark, sf_dir)[1]).withColumn("x", F.col("x") / 1000)


@query(f"SELECT ROUND((sxx * sy - sx * sxy) / (s0 * sxx - sx * sx), 6) AS p0, ROUND((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx), 6) AS p1 FROM (SELECT SUM(1 / (s * s)) AS s0, SUM(x / (s * s)) AS sx, SUM(y / (s * s)) AS sy, SUM(x * x / (s * s)) AS sxx, SUM(x * y / (s * s)) AS sxy FROM {_PTS})")
def fit_line(spark, sf_dir):
    return rounded(fit.fit_line(_points(spark, sf_dir)).select("p0", "p1"), 6, "p0", "p1")


@query(f"SELECT MAX(y) AS constant, ROUND(SUM(x * y) / SUM(y), 6) AS mean, ROUND(SQRT(SUM(x * x * y) / SUM(y) - (SUM(x * y) / SUM(y)) * (SUM(x * y) / SUM(y))), 6) AS sigma FROM {_PTS}")
def gaussian_seed(spark, sf_dir):
    return rounded(fit.seed_table(_points(spark, sf_dir)), 6, "mean", "sigma")


_CURVE = "(100 * EXP(-0.5 * ((x - 38.0) / 24.0) * ((x - 38.0) / 24.0)))"


@query(f"SELECT ROUND(SUM((y - f) * (y - f) / (s * s)), 4) AS chi2, ROUND(SUM((y - f) * (y - f) / f), 3) AS pearson, ROUND(SUM(2 * (f - y + y * LN(y / f))), 4) AS likelihood FROM (SELECT *, {_CURVE} AS f FROM {_PTS})")
def fit_costs(spark, sf_dir):
    rows = _points(spark, sf_dir).where("y > 0")
    costs = fit.cost_table(rows, fit.curve("gaussian", F.col("x"), [100.0, 38.0, 24.0]))
    return rounded(rounded(costs, 4, "chi2", "likelihood"), 3, "pearson")


@query(f"""SELECT l_returnflag, ROUND((n * sxy - sx * sy) / (n * sxx - sx * sx), 4) AS p1 FROM (SELECT l_returnflag, CAST(COUNT(*) AS DOUBLE) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy
  FROM (SELECT l_returnflag, 2.0 * {sql_bin('l_quantity', QTY)} AS x, AVG(l_extendedprice) / 1000 AS y FROM lineitem WHERE l_quantity < 51 GROUP BY 1, 2) GROUP BY 1)""")
def fit_groups(spark, sf_dir):
    p = profile.profile(items(spark, sf_dir), [QTY], ["l_quantity"], "l_extendedprice", by=("l_returnflag",))
    rows = p.values().where(QTY.in_range("ix")).select("l_returnflag", QTY.center("ix").alias("x"), (F.col("mean") / 1000).alias("y"), F.lit(1.0).alias("sigma"))
    return rounded(fit.fit_groups(rows, ["l_returnflag"], fit.Model.polynomial(1)).select("l_returnflag", "p1"), 4, "p1")


@query()
def fit_gaussian(spark, sf_dir):
    found = fit.fit_hist(_ab(spark, sf_dir)[1], fit.Model.gaussian(), "likelihood")
    return spark.createDataFrame([(found.valid, found.ndf, *[round(v, 3) for v in found.params])], "valid boolean, ndf int, constant double, mean double, sigma double")


# ---- event tables


@query("SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS entry, o_orderkey FROM orders")
def entry_index(spark, sf_dir):
    ensure_checkpoint(spark)
    return events.with_entry(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def friend_join(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return events.friend(o.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice"), c.select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


@query("SELECT event_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM events WHERE value > 50)")
def entry_list(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return events.select_entries(e.select("event_id", "event_type"), e.where("value > 50"), "event_id")


@query("SELECT s_suppkey AS k, s_name AS name, 0 AS part FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer")
def chain_union(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    return events.chain(s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


@query("SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 300")
def entry_range(spark, sf_dir):
    return events.entry_range(read(spark, sf_dir, "events"), 100, 300, "event_id").select("event_id", "user_id")


@query("SELECT event_id, value * 2 AS twice, value * 2 + 1 AS more FROM events")
def alias(spark, sf_dir):
    return events.alias(read(spark, sf_dir, "events").select("event_id", "value"), twice="value * 2", more="value * 2 + 1").drop("value")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS index, ROUND(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, UNNEST(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def jagged_flat(spark, sf_dir):
    out = events.flat(read(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return out.select("vec_id", "index", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT label, ROUND(SUM(CAST(v AS DOUBLE)), 4) AS total, COUNT(*) AS n FROM (SELECT label, UNNEST(embedding) AS v FROM embeddings) GROUP BY 1")
def jagged_sum(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return events.flat(e, "embedding", "label").groupBy("label").agg(F.round(F.sum(F.col("value").cast("double")), 4).alias("total"), F.count("*").alias("n"))


@query("SELECT o_custkey, COUNT(*) AS members, MAX(o_totalprice) AS top FROM orders GROUP BY 1")
def arrays_zip_struct(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("key"), F.collect_list("o_totalprice").alias("price"))
    z = events.zip_members(o, "order", "key", "price")
    return z.select("o_custkey", F.size("order").cast("long").alias("members"), F.array_max(F.col("order.price")).alias("top"))


@query("SELECT s_suppkey AS k, s_acctbal AS balance, '' AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def late_column_default(spark, sf_dir):
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    new = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return events.extend(old, new)


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 ELSE 0 END AS tag, CASE WHEN event_type = 'click' THEN user_id END AS user, CASE WHEN event_type = 'view' THEN value END AS amount FROM events")
def variant_struct(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).alias("t"), F.col("user_id").alias("user"), F.col("value").alias("amount"))
    return events.variant(e, "v", "t", "user", "amount").select("event_id", "v.tag", "v.user", "v.amount")


@query("SELECT COUNT(*) AS rows, COUNT(quality) AS labelled, COUNT(*) FILTER (WHERE quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id)")
def optional_null(spark, sf_dir):
    j = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("rows"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


@query("SELECT o_orderpriority AS k, COUNT(*) AS n FROM orders GROUP BY 1")
def map_column(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    one = n.agg(F.collect_list(F.struct("o_orderpriority", "n")).alias("r")).select(F.col("r.o_orderpriority").alias("k"), F.col("r.n").alias("v"))
    return events.map_of(one, "m", "k", "v").select(F.explode("m").alias("k", "n"))


@query("SELECT n_name, REGEXP_REPLACE('[0]*x + [1] ' || n_name, '\\[(\\d+)\\]', '[p\\1]', 'g') AS formula FROM nation")
def normalize_formula(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name", normalize(F.concat(F.lit("[0]*x + [1] "), "n_name")).alias("formula"))


@query(f"SELECT event_type, {sql_bin('value', Axis.reg(20, 0, 100))} AS ix, COUNT(*) AS entries FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def stream_fill(spark, sf_dir):
    whole = read(spark, sf_dir, "events")
    schema = T.StructType([f for f in whole.schema if f.name in ("event_type", "value")])
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    cells = streaming.stream_cells(stream, Axis.reg(20, 0, 100), "value", by=("event_type",))
    return streaming.run_once(cells, "cellwise_stream_fill").select("event_type", "ix", "entries")


# ---- flagship


@query(f"""SELECT r_name, {sql_bin('l_extendedprice', COARSE)} AS ix, ROUND(SUM(l_extendedprice * ({DISCOUNTED})), 2) AS content, COUNT(*) AS entries FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def region_hist(spark, sf_dir):
    li = items(spark, sf_dir).select("l_orderkey", "l_extendedprice", "l_discount")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")  # 25 and 5 rows by definition
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = rows.select("r_name", COARSE.find_bin("l_extendedprice").alias("ix"), (F.col("l_extendedprice") * F.expr(DISCOUNTED)).alias("w"))
    return cells.groupBy("r_name", "ix").agg(F.round(F.sum("w"), 2).alias("content"), F.count("*").alias("entries"))
