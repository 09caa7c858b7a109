"""Curve fits: costs as aggregations, minimisation over the few points of a histogram or group.

A histogram has one point a bin, so points may come to the driver; many groups are fitted in parallel
with ``fit_groups``, one group's points to a call.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi_square_prob
from .hist import Hist
from .stats import bins

METHODS = ("chi2", "pearson", "likelihood")


@dataclass(frozen=True)
class Model:
    """A curve with named parameters; limits and fixed ones are part of it."""

    function: Callable[[np.ndarray, np.ndarray], np.ndarray]
    names: tuple[str, ...]
    start: tuple[float, ...]
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    fixed: frozenset[str] = frozenset()
    seed: Callable[[np.ndarray, np.ndarray], tuple[float, ...]] | None = None

    @staticmethod
    def gaussian() -> "Model":
        return Model(_gaussian, ("constant", "mean", "sigma"), (1.0, 0.0, 1.0), seed=gaussian_seed)

    @staticmethod
    def exponential() -> "Model":
        return Model(_exponential, ("constant", "slope"), (0.0, -1.0))

    @staticmethod
    def polynomial(degree: int) -> "Model":
        return Model(_polynomial, tuple(f"p{k}" for k in range(degree + 1)), (0.0,) * (degree + 1))

    def with_params(self, *values: float) -> "Model":
        return replace(self, start=tuple(map(float, values)))

    def limit(self, name: str, lo: float = -math.inf, hi: float = math.inf) -> "Model":
        return replace(self, limits=self.limits | {name: (lo, hi)})

    def fix(self, name: str, value: float) -> "Model":
        start = tuple(value if n == name else v for n, v in zip(self.names, self.start))
        return replace(self, start=start, fixed=self.fixed | {name})

    def estimate_from(self, x: np.ndarray, y: np.ndarray) -> "Model":
        return self.with_params(*self.seed(x, y)) if self.seed and len(x) else self

    def eval(self, x, params=None):
        return self.function(np.asarray(x, float), np.asarray(self.start if params is None else params, float))


def _gaussian(x, p):
    return p[0] * np.exp(-0.5 * ((x - p[1]) / (p[2] or 1e-300)) ** 2)


def _exponential(x, p):
    return np.exp(np.clip(p[0] + p[1] * x, -700, 700))


def _polynomial(x, p):
    return np.polynomial.polynomial.polyval(x, p)


def gaussian_seed(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Peak, and mean and width weighted by y."""
    w = np.maximum(y, 0)
    total = w.sum()
    if total <= 0:
        return 1.0, 0.0, 1.0
    mean = float((w * x).sum() / total)
    return float(y.max()), mean, math.sqrt(max(float((w * x * x).sum() / total) - mean * mean, 0.0)) or 1.0


@dataclass(frozen=True)
class FitResult:
    names: tuple[str, ...]
    params: tuple[float, ...]
    errors: tuple[float, ...]
    covariance: tuple[tuple[float, ...], ...]
    cost: float
    ndf: int
    valid: bool

    def chi2_per_ndf(self) -> float:
        return self.cost / self.ndf if self.valid and self.ndf else math.nan

    def p_value(self) -> float:
        return chi_square_prob(self.cost, self.ndf) if self.valid and self.ndf else math.nan


def cost(model: Model, x, y, sigma, params, method: str) -> float:
    f = model.eval(x, params)
    if method == "chi2":
        return float((((y - f) / sigma) ** 2).sum())
    f = np.maximum(f, 1e-300)
    if method == "pearson":
        return float(((y - f) ** 2 / f).sum())
    return float(2 * (f - y + np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / f), 0)).sum())


def simplex(value: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """The downhill simplex of Nelder and Mead: no derivatives, for costs that have none."""
    n = len(start)
    corners = [start] + [start + np.eye(n)[k] * (0.1 * abs(start[k]) or 0.1) for k in range(n)]
    costs = [value(c) for c in corners]
    for _ in range(rounds):
        order = np.argsort(costs, kind="stable")
        corners, costs = [corners[i] for i in order], [costs[i] for i in order]
        if abs(costs[-1] - costs[0]) <= 1e-14 * (abs(costs[0]) + 1e-14) and max(np.abs(c - corners[0]).max() for c in corners) <= 1e-10 * (np.abs(corners[0]).max() + 1):
            break
        middle, worst = np.mean(corners[:-1], axis=0), corners[-1]
        trial = middle + (middle - worst)
        cost_ = value(trial)
        if cost_ < costs[0]:
            far = middle + 2 * (middle - worst)
            cost_far = value(far)
            corners[-1], costs[-1] = (far, cost_far) if cost_far < cost_ else (trial, cost_)
        elif cost_ < costs[-2]:
            corners[-1], costs[-1] = trial, cost_
        else:
            near = middle + 0.5 * ((trial if cost_ < costs[-1] else worst) - middle)
            cost_near = value(near)
            if cost_near < min(cost_, costs[-1]):
                corners[-1], costs[-1] = near, cost_near
            else:
                corners = [corners[0]] + [corners[0] + 0.5 * (c - corners[0]) for c in corners[1:]]
                costs = [costs[0]] + [value(c) for c in corners[1:]]
    return corners[int(np.argmin(costs))]


def fit(x, y, sigma, model: Model, method: str = "chi2", span: tuple[float, float] | None = None, minimizer: str = "newton") -> FitResult:
    """Minimise the cost, by damped Newton steps or a simplex that such steps finish.

    Too few points, or a failed search, give an invalid result of NaNs.
    """
    if method not in METHODS:
        raise ValueError(f"the method is one of {METHODS}")
    x, y, sigma = (np.asarray(v, float) for v in (x, y, sigma))
    use = np.ones(len(x), bool) if span is None else (x >= span[0]) & (x <= span[1])
    use &= (sigma > 0) if method == "chi2" else True
    x, y, sigma = x[use], y[use], sigma[use]
    free = [k for k, n in enumerate(model.names) if n not in model.fixed]
    ndf = len(x) - len(free)
    bad = FitResult(model.names, (math.nan,) * len(model.names), (math.nan,) * len(model.names), (), math.nan, max(ndf, 0), False)
    if ndf < 0 or not len(x):
        return bad
    low, high = (np.array([model.limits.get(n, (-math.inf, math.inf))[side] for n in model.names]) for side in (0, 1))
    p = np.clip(np.array(model.start, float), low, high)
    value = lambda q: cost(model, x, y, sigma, q, method)
    if minimizer == "simplex" and free:

        def inside(q):
            whole = p.copy()
            whole[free] = q
            return value(np.clip(whole, low, high))

        p[free] = simplex(inside, p[free])
        p = np.clip(p, low, high)
    step = lambda q: np.maximum(np.abs(q), 1e-3) * 1e-5

    def slopes(q):
        h, out = step(q), np.zeros((len(x), len(free)))
        for j, k in enumerate(free):
            up, down = q.copy(), q.copy()
            up[k] += h[k]
            down[k] -= h[k]
            out[:, j] = (model.eval(x, up) - model.eval(x, down)) / (2 * h[k])
        return out

    def scales(q):
        """The first and second derivative of the cost by the curve's value."""
        f = model.eval(x, q)
        if method == "chi2":
            return 2 * (f - y) / sigma**2, 2 / sigma**2
        f = np.maximum(f, 1e-300)
        return (1 - (y / f) ** 2, 2 * y * y / f**3 + 1e-12) if method == "pearson" else (2 * (1 - y / f), 2 * np.maximum(y, 1e-12) / f**2)

    now, damp = value(p), 1e-3
    for _ in range(500):  # damped Gauss-Newton
        j = slopes(p)
        first, second = scales(p)
        gradient, curve = j.T @ first, (j * second[:, None]).T @ j
        for _ in range(40):
            try:
                move = np.linalg.solve(curve + damp * np.diag(np.maximum(np.diag(curve), 1e-300)), gradient)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            trial = p.copy()
            trial[free] -= move
            trial = np.clip(trial, low, high)
            then = value(trial)
            if math.isfinite(then) and then <= now:
                break
            damp *= 4
        else:
            break
        done = now - then <= 1e-13 * max(1.0, abs(now)) and np.all(np.abs(trial - p) <= 1e-9 * (np.abs(p) + 1e-9))
        p, now, damp = trial, then, max(damp / 8, 1e-12)
        if done:
            break
    if not math.isfinite(now):
        return bad
    j = slopes(p)
    _, second = scales(p)
    small = 2 * np.linalg.pinv((j * second[:, None]).T @ j)
    whole = np.zeros((len(p), len(p)))
    whole[np.ix_(free, free)] = small
    return FitResult(model.names, tuple(p.tolist()), tuple(np.sqrt(np.maximum(np.diag(whole), 0)).tolist()), tuple(map(tuple, whole.tolist())), now, ndf, True)


def points(h: Hist) -> DataFrame:
    """(x, y, sigma) of a one-dimensional histogram: bin centres, contents, errors."""
    return bins(h).where(h.in_range()).select(*h.by, h.axes[0].center("ix").alias("x"), F.col("content").alias("y"), F.col("error").alias("sigma"))


def fit_hist(h: Hist, model: Model, method: str = "chi2", span=None, estimate: bool = True) -> FitResult:
    """Fit the bins of one histogram (at most as many rows as bins come to the driver)."""
    rows = points(h).toPandas().sort_values("x")
    x, y = rows.x.to_numpy(), rows.y.to_numpy()
    return fit(x, y, rows.sigma.to_numpy(), model.estimate_from(x, y) if estimate else model, method, span)


def fit_groups(rows: DataFrame, by: list[str], model: Model, method: str = "chi2", span=None) -> DataFrame:
    """One fit a group of (x, y, sigma) rows: parameters, errors, cost, ndf, valid."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in by}
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in by] + [f"{n} double, {n}_error double" for n in model.names] + ["cost double", "ndf long", "valid boolean"])

    def one(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("x")
        x, y = data.x.to_numpy(float), data.y.to_numpy(float)
        r = fit(x, y, data.sigma.to_numpy(float), model.estimate_from(x, y), method, span)
        values = [v for pair in zip(r.params, r.errors) for v in pair]
        return pd.DataFrame([[*key, *values, r.cost, r.ndf, r.valid]])

    return rows.select(*by, "x", "y", "sigma").groupBy(*by).applyInPandas(one, schema)


def curve(kind: str, x: Column, params: list[float]) -> Column:
    """A built-in curve as a Column."""
    p = [F.lit(float(v)) for v in params]
    if kind == "gaussian":
        z = (x - p[1]) / p[2]
        return p[0] * F.exp(-0.5 * z * z)
    if kind == "exponential":
        return F.exp(p[0] + p[1] * x)
    out = F.lit(0.0)
    for v in reversed(p):
        out = out * x + v
    return out


def cost_table(rows: DataFrame, f: Column, by: list[str] | None = None) -> DataFrame:
    """The three costs of (x, y, sigma) rows at given parameters, as one aggregation."""
    y, s, g = F.col("y"), F.col("sigma"), F.greatest(f, F.lit(1e-300))
    chi2 = F.when(s > 0, F.try_divide((y - f) * (y - f), s * s))
    log = F.when(y > 0, y * F.ln(F.try_divide(F.when(y > 0, y).otherwise(1.0), g))).otherwise(0.0)
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(chi2), F.lit(0.0)).alias("chi2"), F.sum(F.try_divide((y - g) * (y - g), g)).alias("pearson"), F.sum(2.0 * (g - y + log)).alias("likelihood"))


def fit_line(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weighted straight line by its normal equations: one aggregation, no iteration."""
    w = F.try_divide(F.lit(1.0), F.col("sigma") * F.col("sigma"))
    x, y = F.col("x"), F.col("y")
    sums = rows.where("sigma > 0").groupBy(*(by or [])).agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count("*").alias("n"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.select(*(by or []), F.try_divide(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det).alias("p0"), F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), det).alias("p1"), F.sqrt(F.try_divide("sxx", det)).alias("p0_error"), F.sqrt(F.try_divide("s", det)).alias("p1_error"), (F.col("n") - 2).alias("ndf"))


def seed_table(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The Gaussian seed as one aggregation over (x, y)."""
    w = F.greatest("y", F.lit(0.0))
    a = rows.groupBy(*(by or [])).agg(F.max("y").alias("constant"), F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"))
    mean = F.try_divide("wx", "w")
    return a.select(*(by or []), "constant", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("wxx", "w") - mean * mean, F.lit(0.0))).alias("sigma"))
