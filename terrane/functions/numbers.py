"""Rounding and tolerances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products are exact.
SPLITTER = 134217729.0


def round_scaled(x: Column, n: int) -> Column:
    """x to n digits as SQL engines do that scale in binary: the nearest integer to x * 10**n, halves away from zero, over 10**n."""
    s = F.lit(float(10**n))
    return F.signum(x) * F.floor(F.abs(x) * s + 0.5) / s


def round_half_even(x: Column, n: int) -> Column:
    """x to n digits by its exact binary value, ties to even: 2.675 gives 2.67, 0.125 gives 0.12.

    The error of x * 10**n is had exactly from the factors' halves, so products that look like ties are told apart.
    """
    s = F.lit(float(10**n))

    def halves(v: Column) -> tuple[Column, Column]:
        high = SPLITTER * v - (SPLITTER * v - v)
        return high, v - high

    size = F.abs(x)
    p = size * s
    (a, b), (c, d) = halves(size), halves(s)
    error = ((a * c - p) + a * d + b * c) + b * d
    low = F.floor(p).cast("double")
    over = (p - low) - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    return F.when(p < 2.0**52, F.signum(x) * (low + F.when(up, 1.0).otherwise(0.0)) / s).otherwise(x)


def close(a: Column, b: Column, most: float) -> Column:
    """Whether a and b differ by at most so much; null if either is."""
    return F.abs(a - b) <= most
