"""Floating-point arithmetic and comparison by IEEE rules.

Spark raises or gives null on division by zero, holds NaN equal to NaN and larger than all,
and gives null for logarithms of non-positive numbers; queries over samples need the plain
rules of floating point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def div(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(F.isnan(b), F.lit(NAN)).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign."""
    bad = F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF)
    return F.when(bad, F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": div, "%": mod, "^": power, "atan2": F.atan2}


def _ordered(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


COMPARISON = {
    "==": lambda a, b: _ordered(a, b) & (a == b),
    "!=": lambda a, b: ~_ordered(a, b) | (a != b),
    ">": lambda a, b: _ordered(a, b) & (a > b),
    "<": lambda a, b: _ordered(a, b) & (a < b),
    ">=": lambda a, b: _ordered(a, b) & (a >= b),
    "<=": lambda a, b: _ordered(a, b) & (a <= b),
}


def _finite(fn) -> object:
    """For functions that return whole numbers: what isn't finite passes through."""
    return lambda v: F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(fn(v).cast("double"))


def _log(fn) -> object:
    return lambda v: F.when(F.isnan(v) | (v < 0), F.lit(NAN)).when(v == 0, F.lit(-INF)).otherwise(fn(v))


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def round_to(v: Column, nearest: float = 1.0) -> Column:
    """To the nearest multiple, halves up."""
    inverse = 1.0 / nearest
    return F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.floor(v * inverse + 0.5).cast("double") / inverse)


UNARY = {
    "abs": F.abs, "ceil": _finite(F.ceil), "floor": _finite(F.floor), "exp": F.exp, "sqrt": F.sqrt, "sgn": F.signum,
    "ln": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "rad": F.radians, "deg": F.degrees,
}

PI = math.pi
