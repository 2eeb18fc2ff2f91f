"""Evaluation grids, and range functions over the samples before each step.

The core is step expansion: a sample belongs to every step whose window holds it, which is a
contiguous run of steps known by integer arithmetic, so each sample is exploded to its steps
and all functions are aggregates by (series, step).  No join with the grid is needed.  Where a
window is a whole number of steps, the functions that can be put together from parts go by
panes instead (panes.py), and no sample is copied.

Functions of consecutive samples need the sample before.  Steps are dealt into chunks, and a
sample goes to the chunks of its steps (to one, except near an edge), so a series with very
many samples is sorted in pieces of bounded time, not in one task; the aggregation by step
reuses that partitioning.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.functions import ieee
from telemark.model import METADATA_LABELS, VECTOR, drop_labels, label_key, labels_of, samples
from telemark.operators import panes

LOOKBACK_MS = 300_000
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


class Grid(NamedTuple):
    """Evaluation times start, start + step ... up to end, in ms."""

    start: int
    end: int
    step: int = 1

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.last + 1).select((F.lit(self.start) + F.col("id") * self.step).alias("t"))


def instant_at(t: int) -> Grid:
    return Grid(t, t, 1)


def _floor_div(a: Column, b: int) -> Column:
    """Of integers, towards minus infinity; exact below 2 ** 53."""
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / F.lit(b)).cast("long")


def steps_of(ts: Column, grid: Grid, width: int, closed_left: bool = False) -> tuple[Column, Column]:
    """First and last step number whose window (t - width, t] holds ts ([t - width, t] if closed_left)."""
    after = ts - grid.start
    first = F.greatest(F.lit(0).cast("long"), _floor_div(after + (grid.step - 1), grid.step))
    reach = after + (width if closed_left else width - 1)
    return first, F.least(F.lit(grid.last).cast("long"), _floor_div(reach, grid.step))


def at_steps(df: DataFrame, grid: Grid) -> DataFrame:
    """A row for each step from number _lo to _hi."""
    return df.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("t", F.lit(grid.start) + F.col("_k") * grid.step).drop("_k")


def shifted(raw: DataFrame, offset: int = 0) -> DataFrame:
    """`offset`: the samples seen that much later (a negative one looks ahead)."""
    df = samples(raw)
    return df.withColumn("src_ts", F.col("ts_ms")).withColumn("ts_ms", F.col("ts_ms") + F.lit(offset).cast("long"))


def expand(raw: DataFrame, grid: Grid, width: int, offset: int = 0, closed_left: bool = False, keep_stale: bool = False) -> DataFrame:
    """The samples with a row for each step t whose window holds them."""
    df = shifted(raw, offset)
    if not keep_stale:
        df = df.where(~F.col("is_stale"))
    first, last = steps_of(F.col("ts_ms"), grid, width, closed_left)
    df = df.withColumns({"_lo": first, "_hi": last}).where("_lo <= _hi")
    return at_steps(df, grid).drop("_lo", "_hi")


def instant(raw: DataFrame, grid: Grid, offset: int = 0, lookback: int = LOOKBACK_MS) -> DataFrame:
    """At each step the latest sample of the last five minutes, unless it is a staleness marker."""
    rows = expand(raw, grid, lookback, offset, keep_stale=True)
    latest = rows.groupBy("metric", "lkey", "t").agg(*(F.max_by(c, "ts_ms").alias(c) for c in ("src_ts", "value", "is_stale")))
    return latest.where(~F.col("is_stale")).select("metric", labels_of("lkey").alias("labels"), "lkey", "t", "src_ts", "value", F.lit(False).alias("drop_name"))


def instant_smoothed(raw: DataFrame, grid: Grid, offset: int = 0, lookback: int = LOOKBACK_MS) -> DataFrame:
    """At each step the value interpolated between the samples around it; the nearer one where there is but one."""
    before = expand(raw, grid, lookback, offset, closed_left=True).groupBy("metric", "lkey", "t").agg(F.max_by(F.struct("ts_ms", "value"), "ts_ms").alias("a"))
    ahead = expand(raw, grid, lookback, offset - lookback, closed_left=True).withColumn("ts_ms", F.col("ts_ms") + lookback)
    after = ahead.groupBy("metric", "lkey", "t").agg(F.min_by(F.struct("ts_ms", "value"), "ts_ms").alias("b"))
    both = before.join(after, ["metric", "lkey", "t"], "full_outer")
    share = (F.col("t") - F.col("a.ts_ms")) / (F.col("b.ts_ms") - F.col("a.ts_ms")).cast("double")
    value = F.when(F.col("b.ts_ms").isNull(), F.col("a.value")).when(F.col("a.ts_ms").isNull(), F.col("b.value")).when(F.col("a.ts_ms") == F.col("b.ts_ms"), F.col("a.value")).otherwise(F.col("a.value") + (F.col("b.value") - F.col("a.value")) * share)
    return both.select("metric", labels_of("lkey").alias("labels"), "lkey", "t", F.col("t").alias("src_ts"), value.alias("value"), F.lit(False).alias("drop_name"))


def in_chunks(df: DataFrame, steps: int) -> DataFrame:
    """Rows of the steps _lo to _hi dealt to the chunks of that many steps that they touch, with their steps there."""
    df = df.withColumn("_chunk", F.explode(F.sequence(F.expr(f"_lo div {steps}"), F.expr(f"_hi div {steps}"))))
    return df.withColumns({"_lo": F.greatest("_lo", F.col("_chunk") * steps), "_hi": F.least("_hi", F.col("_chunk") * steps + steps - 1)})


def _chunked(raw: DataFrame, grid: Grid, width: int, offset: int, closed_left: bool = False, chunk_steps: int | None = None) -> DataFrame:
    """The samples by series and chunk of steps, each with the sample before it in its chunk and its first and last step there."""
    df = shifted(raw, offset).where(~F.col("is_stale"))
    steps = chunk_steps or max(64, 8 * (width // grid.step + 1))
    first, last = steps_of(F.col("ts_ms"), grid, width, closed_left)
    df = in_chunks(df.withColumns({"_lo": first, "_hi": last}).where("_lo <= _hi"), steps)
    order = Window.partitionBy("metric", "lkey", "_chunk").orderBy("ts_ms")
    return df.withColumns({"prev": F.lag("value").over(order), "prev_ts": F.lag("ts_ms").over(order)})


def _vector(df: DataFrame, value: Column, drop_name: bool = True, src_ts: Column | None = None) -> DataFrame:
    labels, key = labels_of("lkey"), F.col("lkey")
    if drop_name:
        labels = drop_labels(labels, list(METADATA_LABELS))
        key = F.when(key.rlike('"__(type|unit)__":'), label_key(labels)).otherwise(key)
    out = df.select("metric", labels.alias("labels"), key.alias("lkey"), "t", (src_ts if src_ts is not None else F.col("t")).alias("src_ts"), value.cast("double").alias("value"), F.lit(drop_name).alias("drop_name"))
    return out.select(*VECTOR)


def _reset(v: str = "value", prev: str = "prev") -> Column:
    """What a counter had counted when it was reset to a smaller value."""
    return F.when(F.col(v) < F.col(prev), F.col(prev)).otherwise(F.lit(0.0))


def _extrapolated(grid_width: int, is_counter: bool = True) -> Column:
    """The change of a window's samples carried to its edges: by at most 1.1 sample intervals, half of one beyond, and never below zero."""
    sampled = (F.col("last_ts") - F.col("first_ts")) / 1000.0
    between = sampled / (F.col("n") - 1)
    to_start = (F.col("first_ts") - (F.col("t") - grid_width)) / 1000.0
    to_end = (F.col("t") - F.col("last_ts")) / 1000.0
    limit = between * 1.1
    start = F.when(to_start >= limit, between / 2).otherwise(to_start)
    if is_counter:
        to_zero = sampled * (F.col("first_value") / F.col("change"))
        start = F.when((F.col("change") > 0) & (F.col("first_value") >= 0) & (to_zero < start), to_zero).otherwise(start)
    end = F.when(to_end >= limit, between / 2).otherwise(to_end)
    return F.col("change") * ((sampled + start + end) / sampled)


def increase(raw: DataFrame, grid: Grid, width: int, offset: int = 0, chunk_steps: int | None = None) -> DataFrame:
    """Growth of a counter over each window, resets made good, carried to the window's edges; windows of two samples at least."""
    if panes.applies(grid, width):
        return _vector(_grown(raw, grid, width, offset, chunk_steps), _extrapolated(width))
    rows = at_steps(_chunked(raw, grid, width, offset, chunk_steps=chunk_steps).withColumn("reset", _reset()), grid)
    g = rows.groupBy("metric", "lkey", "_chunk", "t").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
        F.min_by("value", "ts_ms").alias("first_value"), F.max_by("value", "ts_ms").alias("last_value"), (F.sum("reset") - F.min_by("reset", "ts_ms")).alias("resets"),
    )
    g = g.where("n > 1").withColumn("change", F.col("last_value") - F.col("first_value") + F.col("resets"))
    return _vector(g, _extrapolated(width))


def _grown(raw: DataFrame, grid: Grid, width: int, offset: int, chunk_steps: int | None) -> DataFrame:
    """The samples of each window by panes: resets inside a pane come from its own samples, those between two from their ends."""
    df = shifted(raw, offset).where(~F.col("is_stale"))
    pane = df.withColumn("_k", F.floor((F.col("ts_ms") - grid.start + grid.step - 1) / grid.step))
    order = Window.partitionBy("metric", "lkey", "_k").orderBy("ts_ms")
    pane = pane.withColumn("prev", F.lag("value").over(order)).withColumn("reset", _reset()).drop("_k")
    parts = panes.panes(pane, grid, width, panes.growth(), ["metric", "lkey"])
    g = panes.windows(parts, grid, width, panes.growth(), chunk_steps).select("metric", "lkey", "_chunk", "t", "s.*")
    return g.where("n > 1").withColumn("change", F.col("last_value") - F.col("first_value") + F.col("resets"))


def rate(raw: DataFrame, grid: Grid, width: int, offset: int = 0, chunk_steps: int | None = None) -> DataFrame:
    return increase(raw, grid, width, offset, chunk_steps).withColumn("value", F.col("value") / (width / 1000.0))


def delta_sum(raw: DataFrame, grid: Grid, width: int, offset: int = 0, per_second: bool = False) -> DataFrame:
    """increase() and rate() of series that hold deltas: the sum of the window."""
    g = expand(raw, grid, width, offset).groupBy("metric", "lkey", "t").agg(F.sum("value").alias("v"))
    return _vector(g, F.col("v") / (width / 1000.0) if per_second else F.col("v"))


def _last_two(raw: DataFrame, grid: Grid, width: int, offset: int) -> DataFrame:
    rows = at_steps(_chunked(raw, grid, width, offset), grid)
    last = rows.groupBy("metric", "lkey", "_chunk", "t").agg(F.count(F.lit(1)).alias("n"), *(F.max_by(c, "ts_ms").alias(c) for c in ("value", "prev", "ts_ms", "prev_ts")))
    return last.where("n > 1")


def irate(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    """Rate between the last two samples; after a reset the last value; of one second at least."""
    g = _last_two(raw, grid, width, offset)
    seconds = F.greatest((F.col("ts_ms") - F.col("prev_ts")) / 1000.0, F.lit(1.0))
    return _vector(g, F.when(F.col("value") < F.col("prev"), F.col("value")).otherwise(F.col("value") - F.col("prev")) / seconds)


def idelta(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    g = _last_two(raw, grid, width, offset)
    return _vector(g, F.col("value") - F.col("prev"))


def delta(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    """Last less first value; a sample at the window's left edge counts."""
    g = expand(raw, grid, width, offset, closed_left=True).groupBy("metric", "lkey", "t").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "ts_ms").alias("b"), F.min_by("value", "ts_ms").alias("a"))
    return _vector(g.where("n > 1"), F.col("b") - F.col("a"))


def changes(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    return _counted(raw, grid, width, offset, ~((F.col("value") == F.col("prev")) | (F.isnan("value") & F.isnan("prev"))))


def resets(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    return _counted(raw, grid, width, offset, F.col("value") < F.col("prev"))


def _counted(raw: DataFrame, grid: Grid, width: int, offset: int, condition: Column) -> DataFrame:
    rows = _chunked(raw, grid, width, offset).withColumn("hit", F.coalesce(condition, F.lit(False)).cast("long"))
    g = at_steps(rows, grid).groupBy("metric", "lkey", "_chunk", "t").agg((F.sum("hit") - F.min_by("hit", "ts_ms")).alias("n"))
    return _vector(g, F.col("n"))


def deriv(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    """Slope by least squares, per second."""
    return _vector(_regression(raw, grid, width, offset), F.col("slope"))


def predict_linear(raw: DataFrame, grid: Grid, width: int, seconds: float, offset: int = 0) -> DataFrame:
    return _vector(_regression(raw, grid, width, offset), F.col("intercept") + F.col("slope") * seconds)


def _regression(raw: DataFrame, grid: Grid, width: int, offset: int) -> DataFrame:
    rows = expand(raw, grid, width, offset).withColumn("x", (F.col("ts_ms") - F.col("t")) / 1000.0)  # centred on the step, against cancellation
    g = rows.groupBy("metric", "lkey", "t").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"))
    return g.where("n > 1")


def double_exponential_smoothing(raw: DataFrame, grid: Grid, width: int, smoothing: float, trend: float, offset: int = 0) -> DataFrame:
    """Holt's linear method over the window's samples in order of time."""
    g = expand(raw, grid, width, offset).groupBy("metric", "lkey", "t").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("w"))
    g = g.where(F.size("w") > 1)
    first, second = F.get("w", F.lit(0))["value"], F.get("w", F.lit(1))["value"]
    start = F.struct(first.alias("level"), (second - first).alias("slope"))

    def step(acc: Column, x: Column) -> Column:
        level = F.lit(smoothing) * x["value"] + F.lit(1 - smoothing) * (acc["level"] + acc["slope"])
        return F.struct(level.alias("level"), (F.lit(trend) * (level - acc["level"]) + F.lit(1 - trend) * acc["slope"]).alias("slope"))

    return _vector(g, F.aggregate(F.slice("w", 2, F.size("w")), start, step, lambda acc: acc["level"]))


def _number(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


_OVER_TIME = {
    "avg": lambda v: F.avg(v), "sum": lambda v: F.sum(v), "count": lambda v: F.count(F.lit(1)), "present": lambda v: F.first(F.lit(1.0)),
    "min": lambda v: F.coalesce(F.min(_number(v)), F.lit(ieee.NAN)), "max": lambda v: F.coalesce(F.max(_number(v)), F.lit(ieee.NAN)),
    "stddev": lambda v: F.stddev_pop(v), "stdvar": lambda v: F.var_pop(v),
    "last": lambda v: F.max_by(v, "ts_ms"), "first": lambda v: F.min_by(v, "ts_ms"),
    "ts_of_last": lambda v: F.max("ts_ms") / 1000.0, "ts_of_first": lambda v: F.min("ts_ms") / 1000.0,
    "ts_of_max": lambda v: F.max_by("ts_ms", F.struct(_number(v), "ts_ms")) / 1000.0,
    "ts_of_min": lambda v: F.max_by("ts_ms", F.struct(-_number(v), "ts_ms")) / 1000.0,
}


def over_time(raw: DataFrame, function: str, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    """avg, sum, count, present, min, max, stddev, stdvar, last, first and ts_of_* of each window; last and first keep the name."""
    keeps_name = function in ("last", "first")
    if panes.applies(grid, width):
        fold = panes.folds()[function]
        parts = panes.panes(shifted(raw, offset).where(~F.col("is_stale")), grid, width, fold, ["metric", "lkey"])
        return _vector(panes.windows(parts, grid, width, fold), fold.finish(F.col("s")), drop_name=not keeps_name)
    g = expand(raw, grid, width, offset).groupBy("metric", "lkey", "t").agg(_OVER_TIME[function](F.col("value")).alias("v"))
    return _vector(g, F.col("v"), drop_name=not keeps_name)


def quantile_over_time(raw: DataFrame, q: float, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    g = expand(raw, grid, width, offset).groupBy("metric", "lkey", "t").agg(F.percentile("value", max(0.0, min(1.0, q))).alias("v"))
    return _vector(g, F.lit(-ieee.INF if q < 0 else ieee.INF) if not 0 <= q <= 1 else F.col("v"))


def mad_over_time(raw: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    """Median of the distances from the median."""
    rows = expand(raw, grid, width, offset)
    middle = rows.groupBy("metric", "lkey", "t").agg(F.percentile("value", 0.5).alias("m"))
    apart = rows.join(middle, ["metric", "lkey", "t"])
    g = apart.groupBy("metric", "lkey", "t").agg(F.percentile(F.abs(F.col("value") - F.col("m")), 0.5).alias("v"))
    return _vector(g, F.col("v"))


def absent_over_time(raw: DataFrame, grid: Grid, width: int, labels: dict[str, str], offset: int = 0) -> DataFrame:
    """1 at the steps whose windows hold no sample at all, with the labels of the selector's equalities."""
    present = expand(raw, grid, width, offset).select("t").distinct()
    return constant(grid.frame(raw.sparkSession).join(present, "t", "left_anti"), F.lit(1.0), labels)


def constant(steps: DataFrame, value: Column, labels: dict[str, str] | None = None) -> DataFrame:
    """A vector of one series at the given steps."""
    m = F.create_map(*(F.lit(x) for kv in sorted((labels or {}).items()) for x in kv)) if labels else F.create_map().cast("map<string,string>")
    return steps.select(F.lit(None).cast("string").alias("metric"), m.alias("labels"), label_key(m).alias("lkey"), "t", F.col("t").alias("src_ts"), value.cast("double").alias("value"), F.lit(True).alias("drop_name"))


def at(evaluate, t: int, grid: Grid, spark: SparkSession) -> DataFrame:
    """An expression evaluated once, at a fixed time, and repeated at every step (`@`)."""
    once = evaluate(instant_at(t)).drop("t")
    times = F.transform(F.sequence(F.lit(0), F.lit(grid.last)), lambda k: F.lit(grid.start) + k.cast("long") * grid.step)
    return once.withColumn("t", F.explode(times)).select(*VECTOR)


def subquery(evaluate, grid: Grid, width: int, step: int, offset: int = 0) -> DataFrame:
    """An expression's values on a grid of absolute multiples of the step, as samples for range functions."""
    if step <= 0:
        raise ValueError("a subquery's step must be positive")
    first = -(-(grid.start - width - offset) // step) * step
    last = (grid.end - offset) // step * step
    inner = evaluate(Grid(first, last, step))
    name = F.when(F.col("drop_name"), F.lit(None)).otherwise(F.col("metric"))
    return inner.select(name.alias("metric"), "labels", "lkey", F.col("t").alias("ts_ms"), "value", F.lit(False).alias("is_stale"))


def anchored(raw: DataFrame, function: str, grid: Grid, width: int, offset: int = 0, lookback: int = LOOKBACK_MS) -> DataFrame:
    """delta, increase, rate, changes or resets from the value that held at the window's start: the last sample before it, up to five minutes back."""
    rows = at_steps(_chunked(raw, grid, width + lookback, offset, closed_left=True), grid)
    begin = F.col("t") - width
    held = rows.withColumn("inside", F.col("ts_ms") > begin).withColumn("x", F.struct("ts_ms", "value"))
    key = ["metric", "lkey", "_chunk", "t"]
    reset, changed = _reset(), F.coalesce(F.col("value") != F.col("prev"), F.lit(False))
    g = held.groupBy(*key).agg(
        F.max(F.when(~F.col("inside"), F.col("x")))["value"].alias("before"), F.min(F.when(F.col("inside"), F.col("x")))["value"].alias("first"),
        F.max("x")["value"].alias("last"), F.count(F.when(F.col("inside"), 1)).alias("n"),
        F.sum(F.when(F.col("inside"), reset)).alias("resets"), F.min_by(F.when(F.col("inside"), reset), F.when(F.col("inside"), F.col("ts_ms"))).alias("first_reset"),
        F.sum(F.when(F.col("inside"), changed.cast("int"))).alias("changed"), F.min_by(F.when(F.col("inside"), changed.cast("int")), F.when(F.col("inside"), F.col("ts_ms"))).alias("first_changed"),
        F.sum(F.when(F.col("inside"), (F.col("value") < F.col("prev")).cast("int"))).alias("fell"), F.min_by(F.when(F.col("inside"), (F.col("value") < F.col("prev")).cast("int")), F.when(F.col("inside"), F.col("ts_ms"))).alias("first_fell"),
    ).where("n > 0")
    has = F.col("before").isNotNull()
    less_first = lambda total, first: F.coalesce(F.col(total), F.lit(0)) - F.when(has, F.lit(0)).otherwise(F.coalesce(F.col(first), F.lit(0)))
    change = F.col("last") - F.coalesce("before", "first")
    value = {"delta": change, "increase": change + less_first("resets", "first_reset"), "rate": (change + less_first("resets", "first_reset")) / (width / 1000.0), "changes": less_first("changed", "first_changed"), "resets": less_first("fell", "first_fell")}[function]
    return _vector(g, value)


def smoothed(raw: DataFrame, function: str, grid: Grid, width: int, offset: int = 0, lookback: int = LOOKBACK_MS) -> DataFrame:
    """delta, increase or rate between values interpolated at both edges of the window."""
    spread = expand(raw, grid, width + 2 * lookback, offset - lookback).withColumn("ts_ms", F.col("ts_ms") + lookback)
    g = spread.groupBy("metric", "lkey", "t").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("w"))
    counter = function != "delta"

    def edge(x: Column) -> Column:
        a = F.get(F.filter("w", lambda s: s["ts_ms"] <= x), F.size(F.filter("w", lambda s: s["ts_ms"] <= x)) - 1)
        b = F.get(F.filter("w", lambda s: s["ts_ms"] >= x), F.lit(0))
        rise = F.when((b["value"] < a["value"]) & F.lit(counter), b["value"]).otherwise(b["value"] - a["value"])
        base = F.when((b["value"] < a["value"]) & F.lit(counter), F.lit(0.0)).otherwise(a["value"])
        share = (x - a["ts_ms"]) / (b["ts_ms"] - a["ts_ms"]).cast("double")
        return F.when(b["ts_ms"].isNull(), a["value"]).when(a["ts_ms"].isNull(), b["value"]).when(a["ts_ms"] == b["ts_ms"], a["value"]).otherwise(base + rise * share)

    lo, hi = F.col("t") - width, F.col("t")
    inner = F.filter("w", lambda s: (s["ts_ms"] > lo) & (s["ts_ms"] < hi))
    path = F.concat(F.array(edge(lo)), F.transform(inner, lambda s: s["value"]), F.array(edge(hi)))
    g = g.withColumn("path", path).where(F.exists("w", lambda s: (s["ts_ms"] > lo) & (s["ts_ms"] <= hi)))
    fell = F.aggregate(F.slice("path", 2, F.size("path")), F.struct(F.get("path", F.lit(0)).alias("p"), F.lit(0.0).alias("r")), lambda acc, v: F.struct(v.alias("p"), (acc["r"] + F.when(v < acc["p"], acc["p"]).otherwise(F.lit(0.0))).alias("r")), lambda acc: acc["r"])
    change = F.element_at("path", -1) - F.element_at("path", 1)
    value = {"delta": change, "increase": change + fell, "rate": (change + fell) / (width / 1000.0)}[function]
    return _vector(g, value)
