"""Sliding windows by panes: each sample is aggregated once, whatever the windows' overlap.

Where a window is a whole number of steps, samples are first aggregated to panes, one for each
series and step, before anything is shuffled.  Windows of 1, 2, 4 ... panes then follow from one
another by one look back each, and a window of `width` is put together from those that its
number of panes has in binary, so a window of a day at steps of a minute takes eleven looks
back instead of 1,440 copies of every sample.  Nothing is subtracted, so no digits are lost.

The rows after the panes are the windows that hold samples: between two panes the steps that
still see the first one are filled in, and where windows run empty a new run begins.  A series
is dealt to chunks of steps, so a long one is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.functions import ieee

_SERIES = ["metric", "lkey", "_chunk"]


class Fold(NamedTuple):
    """A function of a window by its parts: of a pane's samples, of an earlier and a later part, of the whole."""

    lift: Column
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda s: s


#: With fewer panes to a window, copies of the samples cost less than looking back.
LEAST_PANES = 16


def fits(grid, width: int) -> bool:
    """Whether windows are whole numbers of steps, and more than one."""
    return width % grid.step == 0 and width > grid.step


def applies(grid, width: int) -> bool:
    return fits(grid, width) and width >= LEAST_PANES * grid.step


def _number(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def _moments() -> Fold:
    v = F.col("value")
    # of one pane the deviation is taken from its own mean; two parts join by the distance of their means
    lift = F.struct(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    return Fold(lift, merge)


def _later(a: Column, b: Column) -> Column:
    return b


def _earlier(a: Column, b: Column) -> Column:
    return a


def folds() -> dict[str, Fold]:
    v, ts = F.col("value"), F.col("ts_ms")
    plus = lambda a, b: a + b
    pair = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))
    ends = lambda f: F.struct(f(v, ts).alias("v"), (F.max(ts) if f is F.max_by else F.min(ts)).alias("ts"))
    extreme = lambda sign: Fold(F.max(F.struct((sign * _number(v)).alias("v"), ts.alias("ts"))), lambda a, b: F.greatest(a, b), lambda s: s["ts"] / 1000.0)
    best = lambda f: Fold(F.struct(f(_number(v)).alias("v")), lambda a, b: F.struct((F.greatest if f is F.max else F.least)(a["v"], b["v"]).alias("v")), lambda s: F.coalesce(s["v"], F.lit(ieee.NAN)))
    moments = _moments()
    return {
        "sum": Fold(F.sum(v), plus), "count": Fold(F.count(F.lit(1)), plus), "present": Fold(F.first(F.lit(1.0)), _later),
        "avg": Fold(F.struct(F.sum(v).alias("s"), F.count(v).alias("n")), pair, lambda s: s["s"] / s["n"]),
        "min": best(F.min), "max": best(F.max),
        "last": Fold(ends(F.max_by), _later, lambda s: s["v"]), "first": Fold(ends(F.min_by), _earlier, lambda s: s["v"]),
        "ts_of_last": Fold(F.max(ts), _later, lambda s: s / 1000.0), "ts_of_first": Fold(F.min(ts), _earlier, lambda s: s / 1000.0),
        "ts_of_max": extreme(1), "ts_of_min": extreme(-1),
        "stdvar": moments._replace(finish=lambda s: s["m2"] / s["n"]), "stddev": moments._replace(finish=lambda s: F.sqrt(s["m2"] / s["n"])),
    }


def growth() -> Fold:
    """first and last sample, number and what was counted before resets, of a counter's samples that carry `reset`."""
    ts = F.col("ts_ms")
    lift = F.struct(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min_by("value", ts).alias("first_value"), F.max_by("value", ts).alias("last_value"),
        (F.sum("reset") - F.min_by("reset", ts)).alias("resets"),
    )

    def merge(a: Column, b: Column) -> Column:
        between = F.when(b["first_value"] < a["last_value"], a["last_value"]).otherwise(F.lit(0.0))
        return F.struct((a["n"] + b["n"]).alias("n"), a["first_ts"].alias("first_ts"), b["last_ts"].alias("last_ts"), a["first_value"].alias("first_value"), b["last_value"].alias("last_value"), (a["resets"] + b["resets"] + between).alias("resets"))

    return Fold(lift, merge)


def panes(df: DataFrame, grid, width: int, fold: Fold, keys: list[str]) -> DataFrame:
    """keys, _k, s: the samples between two steps, by the number of the step that ends them."""
    after = F.col("ts_ms") - grid.start + (grid.step - 1)
    k = ((after - F.pmod(after, F.lit(grid.step).cast("long"))) / F.lit(grid.step)).cast("long")
    rows = df.withColumn("_k", k).where((F.col("_k") > -(width // grid.step)) & (F.col("_k") <= grid.last))
    return rows.groupBy(*keys, "_k").agg(fold.lift.alias("s"))


def windows(parts: DataFrame, grid, width: int, fold: Fold, chunk_steps: int | None = None) -> DataFrame:
    """metric, lkey, _chunk, t, s: of each step whose window holds samples, from panes by metric, lkey and _k."""
    m = width // grid.step
    steps = chunk_steps or max(64, 8 * m)
    # a pane is seen by the steps _k to _k + m - 1, and goes to their chunks
    lo, hi = F.greatest(F.lit(0).cast("long"), F.col("_k")), F.least(F.lit(grid.last).cast("long"), F.col("_k") + (m - 1))
    dealt = parts.withColumns({"_a": lo, "_b": hi}).where("_a <= _b").withColumn("_chunk", F.explode(F.sequence(F.expr(f"_a div {steps}"), F.expr(f"_b div {steps}")))).drop("_a", "_b")
    order = Window.partitionBy(*_SERIES).orderBy("_k")
    upto = F.least(F.lit(grid.last).cast("long"), F.col("_chunk") * steps + (steps - 1))
    dealt = dealt.withColumn("_next", F.lead("_k").over(order))
    reach = F.least(F.col("_k") + (m - 1), F.coalesce(F.col("_next") - 1, upto), upto)
    dealt = dealt.withColumn("_breaks", F.coalesce(F.lag("_k").over(order) + m < F.col("_k"), F.lit(False)).cast("long"))
    dealt = dealt.withColumn("_run", F.sum("_breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each step of a run; what a pane's first row has, the filled in ones haven't
    rows = dealt.select("metric", "lkey", "_chunk", "_run", "s", F.col("_k").alias("_p"), F.explode(F.sequence("_k", F.greatest(F.col("_k"), reach))).alias("_k"))
    rows = rows.withColumn("w1", F.when(F.col("_k") == F.col("_p"), F.col("s"))).drop("s", "_p")
    run = Window.partitionBy(*_SERIES, "_run").orderBy("_k")

    def joined(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(fold.merge(a, b))

    rows, size = rows.withColumn("s", F.lit(None).cast(rows.schema["w1"].dataType)), 1
    seen = 0  # panes that s holds already, the latest ones
    while True:
        if m & size:
            rows = rows.withColumn("_o", F.lag(f"w{size}", seen).over(run) if seen else F.col(f"w{size}")).withColumn("s", joined(F.col("_o"), F.col("s")))
            seen += size
        if 2 * size > m:
            break
        rows = rows.withColumn("_o", F.lag(f"w{size}", size).over(run)).withColumn(f"w{2 * size}", joined(F.col("_o"), F.col(f"w{size}"))).drop(f"w{size}")
        size *= 2
    inside = (F.col("_k") >= F.col("_chunk") * steps) & (F.col("_k") <= upto) & (F.col("_k") >= 0) & F.col("s").isNotNull()
    return rows.where(inside).select("metric", "lkey", "_chunk", (F.lit(grid.start) + F.col("_k") * grid.step).alias("t"), "s")
