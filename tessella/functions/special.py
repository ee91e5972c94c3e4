"""Special functions as column expressions and, for UDFs, on arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation to the inverse normal distribution.
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
PPF_TAIL = 0.02425


def _horner(cs: list[float], x: Column, last: float | None = None) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out if last is None else out * x + last


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function, within 1.2e-9; null outside (0, 1)."""
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    tail = lambda x: _horner(PPF_C, x) / _horner(PPF_D, x, 1.0)
    mid = _horner(PPF_A, r) * q / _horner(PPF_B, r, 1.0)
    return F.when((p <= 0) | (p >= 1), None).when(p < PPF_TAIL, tail(low)).when(p > 1 - PPF_TAIL, -tail(high)).otherwise(mid)


def digamma(x: Column) -> Column:
    """Digamma for x > 0: six recurrence steps, then the asymptotic series."""
    y = x + 6
    z = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    out = series
    for k in range(6):
        out = out - 1 / (x + k)
    return out


def digamma_sql(x: str) -> str:
    y = f"(({x}) + 6)"
    z = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 0.5 / {y} - {z} * (1.0/12 - {z} * (1.0/120 - {z} * (1.0/252 - {z} * (1.0/240 - {z} / 132)))) - " + " - ".join(f"1.0 / (({x}) + {k})" for k in range(6)) + ")"


def ppf_sql(p: str) -> str:
    def horner(cs: list[float], x: str, last: float | None = None) -> str:
        out = repr(cs[0])
        for c in cs[1:] + ([last] if last is not None else []):
            out = f"({out} * {x} + {c!r})"
        return out

    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    tail = lambda x: f"({horner(PPF_C, x)} / {horner(PPF_D, x, 1.0)})"
    return f"CASE WHEN {p} < {PPF_TAIL} THEN {tail(low)} WHEN {p} > {1 - PPF_TAIL} THEN -{tail(high)} ELSE {horner(PPF_A, r)} * {q} / {horner(PPF_B, r, 1.0)} END"


def normal_sf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(x)])


def _lower_series(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _upper_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_sf(x: float, shape: float, scale: float) -> float:
    """Upper tail of the gamma distribution."""
    if x <= 0:
        return 1.0
    z = x / scale
    return 1 - _lower_series(shape, z) if z < shape + 1 else _upper_fraction(shape, z)


def digamma_value(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    z = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def fit_gamma(values: np.ndarray) -> tuple[float, float] | None:
    """Shape and scale of greatest likelihood, location 0; None where there is none."""
    values = values[values > 0]
    if len(values) < 2:
        return None
    mean, mean_log = float(values.mean()), float(np.log(values).mean())
    s = math.log(mean) - mean_log
    if not s > 1e-12:
        return None
    shape = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        f = math.log(shape) - digamma_value(shape) - s
        step = f / (1 / shape - (digamma_value(shape + 1e-5) - digamma_value(shape - 1e-5)) / 2e-5)
        new = shape - step
        shape = new if new > 0 else shape / 2
        if abs(step) < 1e-10 * shape:
            break
    return shape, mean / shape
