"""The normal distribution function and its inverse as Spark columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the inverse (relative error below 1.2e-9).
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425
#: Coefficients of the error function approximation 7.1.28 of Abramowitz and Stegun (error below 3e-7).
E = (0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def phi(z: Column) -> Column:
    """Standard normal distribution function, within (1e-6, 1 - 1e-6)."""
    x = F.abs(z) / math.sqrt(2)
    s = F.lit(1.0)
    for i, c in enumerate(E):
        s = s + F.lit(c) * F.pow(x, F.lit(float(i + 1)))
    upper = 1 - 0.5 / F.pow(s, F.lit(16.0))
    p = F.when(z >= 0, upper).otherwise(1 - upper)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def phi_inverse(p: Column) -> Column:
    """Standard normal quantile; ``p`` is clipped to [1e-6, 1 - 1e-6]."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    q = p - 0.5
    r = q * q
    middle = _poly(r, A) * q / (_poly(r, B) * r + 1)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda t: _poly(t, C) / (_poly(t, D) * t + 1)
    return F.when(p < LOW, tail(low)).when(p > 1 - LOW, -tail(high)).otherwise(middle)


def phi_of(z: np.ndarray) -> np.ndarray:
    """``phi`` of an array."""
    x = np.abs(z) / math.sqrt(2)
    s = np.zeros_like(x)
    for c in reversed(E):
        s = (s + c) * x
    upper = 1 - 0.5 / (1 + s) ** 16
    return np.clip(np.where(z >= 0, upper, 1 - upper), 1e-6, 1 - 1e-6)


def phi_inverse_of(p: np.ndarray) -> np.ndarray:
    """``phi_inverse`` of an array."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    q = p - 0.5
    tail = lambda t: np.polyval(C, t) / (np.polyval(D, t) * t + 1)
    middle = np.polyval(A, q * q) * q / (np.polyval(B, q * q) * (q * q) + 1)
    return np.where(p < LOW, tail(np.sqrt(-2 * np.log(p))), np.where(p > 1 - LOW, -tail(np.sqrt(-2 * np.log(1 - p))), middle))
