"""Operators on vectors: matching, aggregation, functions of values and of labels.

Everything is an aggregate, an equi-join or a projection on (key, step).  The key of a match
or a group is the canonical text of the labels that count, so Spark can shuffle by it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.functions import exact, ieee
from telemark.model import METADATA_LABELS, VECTOR, drop_labels, keep_labels, label, label_key, labels_of, put_label
from telemark.operators.windows import Grid, constant

_LABEL_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def check_label(name: str) -> str:
    if not _LABEL_NAME.fullmatch(name):
        raise ValueError(f"invalid label name: {name!r}")
    return name


class Matcher(NamedTuple):
    """name = value, name != value, name =~ regex or name !~ regex; regexes match the whole value."""

    name: str
    op: str
    value: str

    def condition(self, metric: str = "metric", labels: str = "labels") -> Column:
        v = F.coalesce(F.col(metric), F.lit("")) if self.name == "__name__" else label(labels, self.name)
        whole = v.rlike(f"^(?:{self.value})$")
        return {"=": v == self.value, "!=": v != self.value, "=~": whole, "!~": ~whole}[self.op]


def select(samples: DataFrame, metric: str | None = None, *matchers: Matcher) -> DataFrame:
    """The samples of a metric whose labels match; the metric is a plain column, so that filter reaches the files."""
    out = samples if metric is None else samples.where(F.col("metric") == metric)
    for m in matchers:
        out = out.where(m.condition())
    return out


# --- values -------------------------------------------------------------------------------


def _derived(v: DataFrame, value: Column) -> DataFrame:
    labels = drop_labels("labels", list(METADATA_LABELS))
    return v.select("metric", labels.alias("labels"), label_key(labels).alias("lkey"), "t", "src_ts", value.cast("double").alias("value"), F.lit(True).alias("drop_name"))


def apply(v: DataFrame, function: str) -> DataFrame:
    """abs, ceil, floor, exp, sqrt, sgn, ln, log2, log10, the trigonometric functions, rad and deg."""
    return _derived(v, ieee.UNARY[function](F.col("value")))


def round_to(v: DataFrame, nearest: float = 1.0) -> DataFrame:
    return _derived(v, ieee.round_to(F.col("value"), nearest))


def clamp(v: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Within both bounds; nothing if low is above high."""
    if low is not None and high is not None and low > high:
        return v.limit(0)
    value = F.col("value")
    value = value if low is None else ieee.greatest(value, F.lit(float(low)))
    return _derived(v, value if high is None else ieee.least(value, F.lit(float(high))))


def timestamp(v: DataFrame) -> DataFrame:
    return _derived(v, F.col("src_ts") / 1000.0)


def calendar(v: DataFrame, field: str) -> DataFrame:
    """year, month, day_of_month, day_of_week (Sunday 0), day_of_year, days_in_month, hour, minute of the value as UTC seconds."""
    when = F.timestamp_seconds(F.floor("value"))
    fields = {
        "year": F.year(when), "month": F.month(when), "day_of_month": F.dayofmonth(when), "day_of_week": F.dayofweek(when) - 1, "day_of_year": F.dayofyear(when),
        "days_in_month": F.dayofmonth(F.last_day(when)), "hour": F.hour(when), "minute": F.minute(when),
    }
    return _derived(v, F.when(F.isnan("value"), F.lit(ieee.NAN)).otherwise(fields[field].cast("double")))


def scalar(v: DataFrame, grid: Grid) -> DataFrame:
    """t, value at every step: that of the only series, else NaN."""
    one = v.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("x"))
    steps = grid.frame(v.sparkSession)
    return steps.join(one, "t", "left").select("t", F.when(F.col("n") == 1, F.col("x")).otherwise(F.lit(ieee.NAN)).alias("value"))


def vector(scalars: DataFrame) -> DataFrame:
    """A vector of one series without labels from values by step."""
    return constant(scalars, F.col("value"))


def time(grid: Grid, spark) -> DataFrame:
    return grid.frame(spark).withColumn("value", F.col("t") / 1000.0)


def absent(v: DataFrame, grid: Grid, labels: dict[str, str]) -> DataFrame:
    """1 at the steps at which the vector is empty, with the labels of the selector's equalities."""
    return constant(grid.frame(v.sparkSession).join(v.select("t").distinct(), "t", "left_anti"), F.lit(1.0), labels)


def sort(v: DataFrame, descending: bool = False) -> DataFrame:
    return v.orderBy(F.isnan("value"), F.col("value").desc() if descending else F.col("value").asc(), "lkey")


def _natural(text: Column) -> Column:
    """A key under which digits sort as numbers: each run padded with zeros to twenty."""
    padded = F.regexp_replace(text, "([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "0*([0-9]{20})(?![0-9])", "$1")


def sort_by_label(v: DataFrame, *names: str, descending: bool = False) -> DataFrame:
    keys = [_natural(label("labels", n)) for n in names] + [F.col("lkey")]
    return v.orderBy(*(k.desc() if descending else k.asc() for k in keys))


# --- labels -------------------------------------------------------------------------------


def _relabelled(v: DataFrame, name: str, value: Column, condition: Column) -> DataFrame:
    if name == "__name__":
        return v.withColumns({"metric": F.when(condition, F.when(value != "", value)).otherwise(F.col("metric")), "drop_name": F.col("drop_name") & ~condition})
    labels = F.when(condition, put_label("labels", name, value)).otherwise(F.col("labels"))
    out = v.withColumn("labels", labels)
    return out.withColumn("lkey", label_key("labels")).select(*VECTOR)


def label_replace(v: DataFrame, target: str, replacement: str, source: str, regex: str) -> DataFrame:
    """Where the whole source label matches, set the target to the replacement, with $1 and so on for groups."""
    check_label(target)
    text = F.coalesce("metric", F.lit("")) if source == "__name__" else label("labels", source)
    whole = f"^(?:{regex})$"
    return _relabelled(v, target, F.regexp_replace(text, whole, replacement), text.rlike(whole))


def label_join(v: DataFrame, target: str, separator: str, *sources: str) -> DataFrame:
    check_label(target)
    return _relabelled(v, target, F.concat_ws(separator, *(label("labels", s) for s in sources)), F.lit(True))


def info(v: DataFrame, infos: DataFrame, names: list[str] | None = None, identifying: tuple[str, ...] = ("instance", "job")) -> DataFrame:
    """Labels of the info series with the same identifying labels are added, the vector's own staying as they are."""
    extra = drop_labels("labels", list(identifying)) if names is None else keep_labels("labels", names)
    key = lambda: label_key(keep_labels("labels", list(identifying)))
    right = infos.select(key().alias("_key"), "t", extra.alias("_extra")).groupBy("_key", "t").agg(F.first("_extra").alias("_extra"))
    joined = v.withColumn("_key", key()).join(right, ["_key", "t"], "left")
    own = F.col("labels")
    added = F.map_filter(F.coalesce("_extra", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    return joined.withColumn("labels", F.map_concat(own, added)).withColumn("lkey", label_key("labels")).select(*VECTOR)


# --- aggregation --------------------------------------------------------------------------


def _with_name(labels: str | Column = "labels") -> Column:
    """The labels with the metric's name among them, for groups by __name__; a dropped name isn't there any more."""
    own = F.col(labels) if isinstance(labels, str) else labels
    named = F.col("metric").isNotNull() & ~F.col("drop_name")
    return F.when(named, F.map_concat(F.map_filter(own, lambda k, _: k != "__name__"), F.create_map(F.lit("__name__"), F.col("metric")))).otherwise(own)


def _grouped(v: DataFrame, by: list[str] | None, without: list[str] | None) -> DataFrame:
    if without is not None:
        kept = drop_labels("labels", [*without, *METADATA_LABELS])
    elif by and "__name__" in by:
        kept = keep_labels(_with_name(), by)
    else:
        kept = keep_labels("labels", by or [])
    out = v.withColumn("_group", kept)
    return out.withColumn("_gkey", label_key("_group"))


def _result(g: DataFrame, value: Column) -> DataFrame:
    g = g.withColumn("_group", labels_of("_gkey"))
    named = F.map_contains_key("_group", F.lit("__name__"))
    name = F.when(named, F.try_element_at("_group", F.lit("__name__")))
    labels = F.map_filter("_group", lambda k, _: k != "__name__")
    key = F.when(named, label_key(labels)).otherwise(F.col("_gkey"))
    return g.select(name.alias("metric"), labels.alias("labels"), key.alias("lkey"), "t", F.col("t").alias("src_ts"), value.cast("double").alias("value"), name.isNull().alias("drop_name"))


def _quantile_at(values: Column, q: float) -> Column:
    """Linear between the sorted values, NaN being the smallest."""
    if q != q:
        return F.lit(ieee.NAN)
    if q < 0 or q > 1:
        return F.lit(-ieee.INF if q < 0 else ieee.INF)
    ordered = F.concat(F.filter(values, lambda x: F.isnan(x)), F.array_sort(F.filter(values, lambda x: ~F.isnan(x))))
    rank = F.lit(q) * (F.size(values) - 1)
    low = F.floor(rank).cast("int")
    high = F.least(F.size(values) - 1, low + 1)
    share = rank - low
    return F.get(ordered, low) * (F.lit(1.0) - share) + F.get(ordered, high) * share


_AGGREGATES = {
    "count": lambda v: F.count(F.lit(1)), "group": lambda v: F.first(F.lit(1.0)),
    "min": lambda v: F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(ieee.NAN)), "max": lambda v: F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(ieee.NAN)),
    "stddev": lambda v: F.stddev_pop(v), "stdvar": lambda v: F.var_pop(v),
}


def aggregate(v: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """sum, avg, count, group, min, max, stddev, stdvar of each group and step; sums don't depend on the order of the series."""
    if op in ("sum", "avg"):
        return _result(exact.totals(_grouped(v, by, without), ["_gkey", "t"]), F.col(op))
    g = _grouped(v, by, without).groupBy("_gkey", "t").agg(_AGGREGATES[op](F.col("value")).alias("v"))
    return _result(g, F.col("v"))


def quantile(v: DataFrame, q: float, by: list[str] | None = None, without: list[str] | None = None, exact_nan: bool = False) -> DataFrame:
    """The q-quantile of each group and step.

    percentile() counts equal values together before they are shuffled; with exact_nan the
    values of a group are sorted as an array, NaN being the smallest.
    """
    g = _grouped(v, by, without).groupBy("_gkey", "t")
    if exact_nan or not 0 <= q <= 1:
        return _result(g.agg(F.collect_list("value").alias("w")), _quantile_at(F.col("w"), q))
    return _result(g.agg(F.percentile("value", q).alias("v")), F.col("v"))


def topk(v: DataFrame, k: int, by: list[str] | None = None, without: list[str] | None = None, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) series of each group and step, as they are; NaN comes last."""
    value = F.col("value").desc() if largest else F.col("value").asc()
    order = Window.partitionBy("_gkey", "t").orderBy(F.isnan("value"), value, "lkey", "metric")
    return _grouped(v, by, without).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(*VECTOR)


def limitk(v: DataFrame, k: int, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """k series of each group, always the same ones: the first by a hash of their labels."""
    order = Window.partitionBy("_gkey", "t").orderBy(F.xxhash64("metric", "lkey"), "lkey")
    return _grouped(v, by, without).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(*VECTOR)


def limit_ratio(v: DataFrame, ratio: float) -> DataFrame:
    """About that share of the series, by a hash of their labels; a negative ratio gives the others."""
    if abs(ratio) > 1:
        raise ValueError("the ratio must be between -1 and 1")
    point = F.pmod(F.xxhash64("metric", "lkey"), F.lit(1 << 32).cast("long")) / float(1 << 32)
    return v.where(point < ratio if ratio >= 0 else point >= 1 + ratio).select(*VECTOR)


def format_value(v: Column) -> Column:
    """A number as label text: whole numbers without decimals."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == ieee.INF, "+Inf").when(v == -ieee.INF, "-Inf").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def count_values(v: DataFrame, name: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """How many series of each group have each value; the value becomes a label."""
    check_label(name)
    g = _grouped(v, by, without).withColumn("_value", format_value(F.col("value")))
    g = g.withColumn("_gkey", label_key(put_label("_group", name, F.col("_value")))).groupBy("_gkey", "t")
    return _result(g.agg(F.count(F.lit(1)).alias("n")), F.col("n"))


# --- binary operators ---------------------------------------------------------------------


def arithmetic(v: DataFrame, op: str, number: float | DataFrame, number_left: bool = False) -> DataFrame:
    """+, -, *, /, %, ^ or atan2 with a number, or with a number for each step (t, value)."""
    v, x = _with_number(v, number)
    a, b = (x, F.col("value")) if number_left else (F.col("value"), x)
    return _derived(v, ieee.ARITHMETIC[op](a, b))


def compare(v: DataFrame, op: str, number: float | DataFrame, as_bool: bool = False, number_left: bool = False) -> DataFrame:
    """Keep the samples that compare, or with as_bool give 1 or 0 for all."""
    v, x = _with_number(v, number)
    a, b = (x, F.col("value")) if number_left else (F.col("value"), x)
    holds = ieee.COMPARISON[op](a, b)
    return _derived(v, holds.cast("double")) if as_bool else v.where(holds).select(*VECTOR)


def _with_number(v: DataFrame, number: float | DataFrame) -> tuple[DataFrame, Column]:
    if isinstance(number, DataFrame):
        return v.join(number.select("t", F.col("value").alias("_x")), "t"), F.col("_x")
    return v, F.lit(float(number))


class Matching(NamedTuple):
    """Which labels two vectors are matched by, and which side may have many partners."""

    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] = ()
    group: str | None = None  #: "left" or "right": the side with many series to one of the other
    include: tuple[str, ...] = ()  #: labels taken over from the one side

    def labels(self, labels: str | Column = "labels") -> Column:
        if self.on is not None:
            return keep_labels(_with_name(labels) if "__name__" in self.on else labels, list(self.on))
        return drop_labels(labels, list(self.ignoring))


def _keyed(left: DataFrame, right: DataFrame, m: Matching) -> tuple[DataFrame, DataFrame]:
    """Both sides with their match key; labels of the metric itself count only where both sides know them."""
    if m.on is not None:
        return tuple(v.withColumn("_match", label_key(m.labels())) for v in (left, right))
    known = lambda v, side: v.agg(*(F.coalesce(F.bool_or(label("labels", n) != ""), F.lit(False)).alias(f"{side}{i}") for i, n in enumerate(METADATA_LABELS)))
    unknown = F.array_compact(F.array(*(F.when(~(F.col(f"l{i}") & F.col(f"r{i}")), F.lit(n)) for i, n in enumerate(METADATA_LABELS))))
    one_row = F.broadcast(known(left, "l").crossJoin(known(right, "r")).select(unknown.alias("_unknown")))
    key = label_key(F.map_filter(m.labels(), lambda k, _: ~F.array_contains(F.col("_unknown"), k)))
    return tuple(v.crossJoin(one_row).withColumn("_match", key).drop("_unknown") for v in (left, right))


def _unique(v: DataFrame, side: str) -> DataFrame:
    """One row for each match key and step, or an error."""
    g = v.groupBy("_match", "t").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in ("metric", "labels", "lkey", "src_ts", "value", "drop_name")))
    text = F.concat(F.lit(f"found duplicate series for the match group on the {side} side: "), F.col("_match"))
    return g.withColumn("value", F.when(F.col("_n") > 1, F.raise_error(text)).otherwise(F.col("value"))).drop("_n")


def binary(left: DataFrame, right: DataFrame, op: str, m: Matching = Matching(), as_bool: bool = False, fill_left: float | None = None, fill_right: float | None = None) -> DataFrame:
    """Arithmetic or comparison of two vectors, an equi-join on the match labels and the step.

    A fill value stands in for a missing partner on its side.
    """
    many_left, many_right = m.group == "left", m.group == "right"
    a, b = _keyed(left, right, m)
    a = a if many_left else _unique(a, "left")
    b = b if many_right else _unique(b, "right")
    how = {(False, False): "inner", (True, False): "right_outer", (False, True): "left_outer", (True, True): "full_outer"}[(fill_left is not None, fill_right is not None)]
    names = ("metric", "labels", "lkey", "src_ts", "value", "drop_name")
    x = a.select("_match", "t", *(F.col(c).alias(f"l_{c}") for c in names))
    y = b.select("_match", "t", *(F.col(c).alias(f"r_{c}") for c in names))
    j = x.join(y, ["_match", "t"], how)
    lv, rv = F.coalesce("l_value", F.lit(fill_left)), F.coalesce("r_value", F.lit(fill_right))
    base = F.coalesce(*(("r_labels", "l_labels") if many_right else ("l_labels", "r_labels")))
    if m.group is None:
        labels = m.labels(base)
    else:
        labels = base
        other = F.col("l_labels" if many_right else "r_labels")
        for name in m.include:
            value = F.when(other.isNull() | (label(other, name) == ""), label(labels, name)).otherwise(label(other, name))
            labels = put_label(labels, name, value)
    comparing = op in ieee.COMPARISON
    if comparing and not as_bool:
        out = j.where(ieee.COMPARISON[op](lv, rv))
        kept = F.coalesce(*(("r_labels", "l_labels") if many_right else ("l_labels", "r_labels"))) if m.group is None and m.on is None and not m.ignoring else labels
        name, dropped = F.col("l_metric"), F.coalesce("l_drop_name", F.lit(True))  # the left value passes, whichever side is the many one
        return out.select(name.alias("metric"), kept.alias("labels"), label_key(kept).alias("lkey"), "t", F.col("t").alias("src_ts"), lv.alias("value"), dropped.alias("drop_name"))
    value = ieee.COMPARISON[op](lv, rv).cast("double") if comparing else ieee.ARITHMETIC[op](lv, rv)
    labels = drop_labels(labels, list(METADATA_LABELS))
    return j.select(F.coalesce("l_metric", "r_metric").alias("metric"), labels.alias("labels"), label_key(labels).alias("lkey"), "t", F.col("t").alias("src_ts"), value.alias("value"), F.lit(True).alias("drop_name"))


def and_(left: DataFrame, right: DataFrame, m: Matching = Matching()) -> DataFrame:
    a, b = _keyed(left, right, m)
    return a.join(b.select("_match", "t"), ["_match", "t"], "left_semi").select(*VECTOR)


def unless(left: DataFrame, right: DataFrame, m: Matching = Matching()) -> DataFrame:
    a, b = _keyed(left, right, m)
    return a.join(b.select("_match", "t"), ["_match", "t"], "left_anti").select(*VECTOR)


def or_(left: DataFrame, right: DataFrame, m: Matching = Matching()) -> DataFrame:
    return left.select(*VECTOR).unionByName(unless(right, left, m))
