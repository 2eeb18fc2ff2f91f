"""Quantiles from sketches that are merged: kept by the minute, put together to hours, days or more.

A sketch (KLL) holds a number of values that its size k bounds, whatever the group has, so no
task holds a group's values and merging is an aggregate like a sum.  The rank of a value that is
read is off by error(k) at most, with a probability of 99 %; groups of up to k values are exact.
Nulls aren't counted; a sketch of nothing has null quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 400


def error(k: int = SIZE) -> float:
    """The share of ranks by which a quantile is off at most, 99 times of 100 (the bound published for KLL)."""
    return 2.296 / k**0.9723


def sketch(value: Column, k: int = SIZE) -> Column:
    """An aggregate: the sketch of the numbers."""
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(k))


def merged(sketches: Column, k: int = SIZE) -> Column:
    """An aggregate: the sketch of all numbers of all sketches."""
    return F.kll_merge_agg_double(sketches, F.lit(k))


def size(of: Column) -> Column:
    return F.kll_sketch_get_n_double(of)


def quantile(of: Column, q: float) -> Column:
    """The least value whose rank is q or more."""
    return F.when(size(of) > 0, F.kll_sketch_get_quantile_double(of, F.lit(float(q))))


def rollup(rows: DataFrame, keys: list[str], time: str, width: int, value: Column, k: int = SIZE) -> DataFrame:
    """keys, bucket, sketch: one sketch for each bucket of time."""
    return rows.groupBy(*keys, (F.col(time) - F.col(time) % width).alias("bucket")).agg(sketch(value, k).alias("sketch"))


def coarser(sketches: DataFrame, keys: list[str], width: int, k: int = SIZE) -> DataFrame:
    """The same by wider buckets, or by fewer keys, without a look at the values."""
    return sketches.groupBy(*keys, (F.col("bucket") - F.col("bucket") % width).alias("bucket")).agg(merged(F.col("sketch"), k).alias("sketch"))


def quantiles(sketches: DataFrame, levels: dict[str, float]) -> DataFrame:
    """A column for each level in place of the sketch."""
    return sketches.withColumns({name: quantile(F.col("sketch"), q) for name, q in levels.items()}).drop("sketch")
