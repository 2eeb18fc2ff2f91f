"""Sums of doubles without rounding on the way: the same in any order and any partitioning.

A finite number is a multiple of a power of two.  It is cut into three parts of 29 bits at
multiples of 2 ** 29, so parts of equal weight are added up as integers, exactly, by plain
aggregates that combine before they are shuffled; one row for each group and class of
exponents is left (numbers within nine decades of each other share a class), and the classes
of a group are put together at the end, from the least weight to the greatest.  So a sum is
right to one unit in the last place, and exact where a double can hold it, whatever cancels.

Infinities and NaN are added up by themselves and win.  A group may have 2 ** 34 rows; beyond
that an overflow is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions import ieee

_BITS = 29
_MASK = (1 << _BITS) - 1


def _times_power(x: Column, exponent: Column) -> Column:
    """x * 2 ** exponent, in two steps, as the power alone may not be a double."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (exponent - half).cast("double"))


def _is_number(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < ieee.INF)


def totals(df: DataFrame, keys: list[str], value: str = "value", **more: Column) -> DataFrame:
    """keys, sum, avg, n of the values that aren't null, and further aggregates of the kinds count, sum, min and max.

    `more` are named aggregates; those of counts and sums are added up, so they are given as
    F.count or F.sum of a column of integers, and come back under their names.
    """
    v = F.col(value)
    cls = F.when(_is_number(v) & (v != 0), F.floor(F.log2(F.abs(v)) / _BITS).cast("int"))
    df = df.withColumn("_c", cls)
    y = _times_power(v, 2 * _BITS - F.col("_c") * _BITS)
    top = F.floor(y / float(1 << 2 * _BITS))
    rest = y - top * float(1 << 2 * _BITS)
    middle = F.floor(rest / float(1 << _BITS))
    parts = [rest - middle * float(1 << _BITS), middle, top]
    first = df.groupBy(*keys, "_c").agg(
        *(F.sum(F.when(F.col("_c").isNotNull(), p.cast("long"))).alias(f"_p{i}") for i, p in enumerate(parts)),
        F.sum(F.when(~_is_number(v), v)).alias("_special"), F.count(v).alias("_n"), *(c.alias(f"_{name}") for name, c in more.items()),
    )
    entry = F.struct(F.col("_c").alias("c"), *(F.col(f"_p{i}").alias(f"p{i}") for i in range(3)))
    g = first.groupBy(*keys).agg(F.collect_list(F.when(F.col("_c").isNotNull(), entry)).alias("_e"), F.sum("_special").alias("_special"), F.sum("_n").alias("n"), *(F.sum(f"_{name}").alias(name) for name in more))
    g = _with_digits(g)
    total, scaled = _value(0), _value(-64)
    none = F.col("n") == 0
    g = g.withColumn("sum", F.when(none, F.lit(None)).when(F.col("_special").isNotNull(), F.col("_special")).otherwise(total))
    over = F.abs(F.col("sum")) == ieee.INF
    mean = F.when(over & F.col("_special").isNull(), scaled / F.col("n") * float(2**64)).otherwise(F.col("sum") / F.col("n"))
    return g.withColumn("avg", mean).select(*keys, "sum", "avg", "n", *more)


def _carried(limbs: Column) -> Column:
    """carry, digits: sums of 29 bits and more brought to digits of 29 bits, the least first."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    step = lambda a, x: F.struct(F.shiftright(x + a["carry"], _BITS).alias("carry"), F.array_append(a["digits"], (x + a["carry"]).bitwiseAND(F.lit(_MASK))).alias("digits"))
    return F.aggregate(limbs, start, step)


def _with_digits(g: DataFrame) -> DataFrame:
    """_low, _limbs, _minus and _digits of the entries _e: each step a column of its own, so that none is computed twice."""
    e, zero = F.col("_e"), F.lit(0).cast("long")
    places = F.transform(e, lambda x: x["c"])
    at = lambda x, j: F.when(x["c"] == j, x["p2"]).when(x["c"] - 1 == j, x["p1"]).when(x["c"] - 2 == j, x["p0"]).otherwise(zero)
    g = g.withColumns({"_low": F.array_min(places) - 2, "_high": F.array_max(places) + 3})
    sums = F.transform(F.sequence("_low", "_high"), lambda j: F.aggregate(e, zero, lambda a, x: a + at(x, j)))
    g = g.withColumn("_limbs", F.when(F.size(e) > 0, sums))
    g = g.withColumn("_minus", _carried(F.col("_limbs"))["carry"] < 0)
    return g.withColumn("_digits", _carried(F.when(F.col("_minus"), F.transform("_limbs", lambda x: -x)).otherwise(F.col("_limbs")))["digits"])


def _value(shift: int) -> Column:
    """The digits' number times 2 ** shift, from the least weight on; 0 of none."""
    each = F.transform("_digits", lambda x, i: _times_power(x.cast("double"), (F.col("_low") + i) * _BITS + shift))
    size = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(F.col("_minus"), -size).otherwise(size), F.lit(0.0))
