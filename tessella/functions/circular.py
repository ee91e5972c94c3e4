"""Circular mathematics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def wrap(angle: Column, period: float = TAU) -> Column:
    """Into [0, period)."""
    return F.pmod(angle, F.lit(period))


def difference(a: Column, b: Column, period: float = TAU) -> Column:
    """Signed shortest way from b to a, in [-period / 2, period / 2)."""
    return F.pmod(a - b + period / 2, F.lit(period)) - period / 2


def mean(angle: Column) -> Column:
    """Circular mean, an aggregate, in (-pi, pi]."""
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def resultant(angle: Column) -> Column:
    """Length of the mean direction, an aggregate, 0 to 1."""
    return F.sqrt(F.pow(F.avg(F.sin(angle)), 2) + F.pow(F.avg(F.cos(angle)), 2))


def as_components(angle: Column) -> Column:
    """The two components that stand for a circular feature."""
    return F.array(F.cos(angle), F.sin(angle))


def von_mises(angle: Column, preferred: float, kappa: float) -> Column:
    """Tuning curve with peak 1 at the preferred direction."""
    return F.exp(kappa * (F.cos(angle - preferred) - 1))


def place_gaussian(x: Column, y: Column, cx: float, cy: float, sigma: float) -> Column:
    return F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * sigma * sigma))


def sigmoid(x: Column, slope: float, threshold: float) -> Column:
    return 1 / (1 + F.exp(-slope * (x - threshold)))
