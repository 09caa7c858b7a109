"""Probabilities of the chi-square and Kolmogorov distributions, from their textbook series."""

from __future__ import annotations

import math


def ln_gamma(a: float) -> float:
    return math.lgamma(a)


def igam(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 0.0
    if x > 1 and x > a:
        return 1.0 - igamc(a, x)
    term = total = 1.0 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def igamc(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 1.0
    if x < 1 or x < a:
        return 1.0 - igam(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):  # Lentz's continued fraction
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square_prob(chi2: float, ndf: int) -> float:
    """P(chi-square of ndf degrees > chi2)."""
    if ndf <= 0:
        return 0.0
    return 1.0 if chi2 <= 0 else igamc(ndf / 2, chi2 / 2)


def kolmogorov_prob(z: float) -> float:
    """P(Kolmogorov's statistic > z): the theta series, in the form that converges for z."""
    z = abs(z)
    if z < 0.2:
        return 1.0
    if z < 0.755:
        scale = math.sqrt(2 * math.pi) / z
        return 1.0 - scale * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)) for k in (1, 2, 3))
    if z >= 6.8116:
        return 0.0
    terms = max(1, min(4, round(3 / z)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, terms + 1))))
