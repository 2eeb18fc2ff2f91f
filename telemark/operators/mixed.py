"""Vectors that hold floats and native histograms together, and the checks that keep kinds apart.

A mixed vector is a vector with one more column, hist: a row has either a value or a
histogram.  floats() and histograms() give the two parts as the operators of vectors.py and
histograms.py take them; what follows here are the rules for both together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.functions import exact
from telemark.model import VECTOR, drop_labels, label, label_key, labels_of, put_label
from telemark.operators import histograms as H
from telemark.operators import vectors as V
from telemark.operators.windows import at_steps, in_chunks, steps_of
from telemark.tables import Scratch

HIST = "struct<schema:int,zero_threshold:double,zero_count:double,positive_offset:int,positive_buckets:array<double>,negative_offset:int,negative_buckets:array<double>,custom_values:array<double>,sum:double,count:double>"
MIXED = [*VECTOR, "hist"]
_SAMPLE = ["metric", "labels", "lkey", "ts_ms", "value", "hist", "is_stale"]


def samples(floats: DataFrame, histograms: DataFrame) -> DataFrame:
    """Raw points of both kinds in one relation."""
    is_stale = lambda df: F.col("is_stale") if "is_stale" in df.columns else F.lit(False)
    a = floats.select("metric", "labels", "lkey", "ts_ms", "value", F.lit(None).cast(HIST).alias("hist"), is_stale(floats).alias("is_stale"))
    b = histograms.select("metric", "labels", "lkey", "ts_ms", F.lit(None).cast("double").alias("value"), F.col("hist").cast(HIST).alias("hist"), is_stale(histograms).alias("is_stale"))
    return a.unionByName(b)


def of_floats(v: DataFrame) -> DataFrame:
    return v.select(*VECTOR, F.lit(None).cast(HIST).alias("hist"))


def of_histograms(v: DataFrame, drop_name: bool = True) -> DataFrame:
    return v.select("metric", "labels", "lkey", "t", F.col("t").alias("src_ts"), F.lit(None).cast("double").alias("value"), F.lit(drop_name).alias("drop_name"), F.col("hist").cast(HIST).alias("hist"))


def floats(v: DataFrame) -> DataFrame:
    return v.where(F.col("hist").isNull()).select(*VECTOR)


def histograms(v: DataFrame) -> DataFrame:
    return v.where(F.col("hist").isNotNull()).select("metric", "labels", "lkey", "t", "hist")


def instant(raw: DataFrame, grid, offset: int = 0, lookback: int = 300_000) -> DataFrame:
    """At each step a series' latest sample, of whichever kind, unless it is a staleness marker."""
    df = raw.withColumns({"src_ts": F.col("ts_ms"), "ts_ms": F.col("ts_ms") + F.lit(offset).cast("long")})
    lo, hi = steps_of(F.col("ts_ms"), grid, lookback)
    rows = at_steps(df.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi"), grid)
    last = rows.groupBy("metric", "lkey", "t").agg(F.max_by(F.struct("src_ts", "value", "hist", "is_stale"), "ts_ms").alias("s"))
    return last.where("not s.is_stale").select("metric", labels_of("lkey").alias("labels"), "lkey", "t", "s.src_ts", "s.value", F.lit(False).alias("drop_name"), "s.hist")


# --- aggregation --------------------------------------------------------------------------


def _named(g: DataFrame, by: list[str] | None) -> DataFrame:
    """Histograms by their group key: the metric's name, where it is grouped by, is one again."""
    if not by or "__name__" not in by:
        return of_histograms(g)
    own = labels_of("lkey")
    labels = F.map_filter(own, lambda k, _: k != "__name__")
    out = g.select(F.try_element_at(own, F.lit("__name__")).alias("metric"), labels.alias("labels"), label_key(labels).alias("lkey"), "t", "hist")
    return of_histograms(out, drop_name=False)


def aggregate(v: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """sum and avg of groups of one kind (of both: nothing); count and group of all series; min, max, stddev, stdvar of the floats."""
    if op in ("min", "max", "stddev", "stdvar"):
        return of_floats(V.aggregate(floats(v), op, by, without))
    grouped = V._grouped(v, by, without)
    if op in ("count", "group"):
        g = grouped.groupBy("_gkey", "t").agg(F.count(F.lit(1)).alias("n"))
        return of_floats(V._result(g, F.col("n") if op == "count" else F.lit(1.0)))
    # three parts read the vector: it is computed once
    grouped = Scratch(v.sparkSession, "mixed").write(grouped.select("metric", "_gkey", "t", "value", "hist"), "grouped")
    numbers = exact.totals(grouped, ["_gkey", "t"], histograms=F.count("hist")).where("n > 0 and histograms = 0")
    own = grouped.where(F.col("hist").isNotNull()).select("metric", labels_of("_gkey").alias("labels"), F.col("_gkey").alias("lkey"), "t", "hist")
    summed = H.mean(own, without=[]) if op == "avg" else H.combine(own, without=[])
    other = grouped.where(F.col("hist").isNull()).select(F.col("_gkey").alias("lkey"), "t").distinct()
    return of_floats(V._result(numbers, F.col(op))).unionByName(_named(summed.join(other, ["lkey", "t"], "left_anti"), by))


def conflicts(v: DataFrame, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """lkey, t, floats, exponential, custom: the groups that sum and avg give nothing for, and how many series of each kind they have."""
    custom = F.col("hist.schema") == H.CUSTOM
    g = V._grouped(v, by, without).groupBy(F.col("_gkey").alias("lkey"), "t")
    counts = g.agg(F.count_if(F.col("hist").isNull()).alias("floats"), F.count_if(F.col("hist").isNotNull() & ~custom).alias("exponential"), F.count_if(custom).alias("custom"))
    return counts.where((F.col("floats") > 0).cast("int") + (F.col("exponential") > 0).cast("int") + (F.col("custom") > 0).cast("int") > 1)


def _number_text(v: Column) -> Column:
    return F.when((v == F.floor(v)) & (F.abs(v) < 9e18), v.cast("long").cast("string")).otherwise(v.cast("string"))


def format_histogram(h: Column) -> Column:
    """A histogram as label text: count, sum and every bucket with its bounds, from the least value on."""
    ratio = F.pow(F.lit(2.0), -h["schema"].cast("double"))
    custom = h["schema"] == H.CUSTOM

    def bucket(n: Column, p: Column, side: str) -> Column:
        i = p + h[f"{side}_offset"]
        low, high = F.pow(F.lit(2.0), (i - 1) * ratio), F.pow(F.lit(2.0), i * ratio)
        if side == "negative":
            return F.concat(F.lit("["), _number_text(-high), F.lit(","), _number_text(-low), F.lit("):"), _number_text(n))
        low = F.when(custom, F.coalesce(F.get(h["custom_values"], i - 1), F.lit(float("-inf")))).otherwise(low)
        high = F.when(custom, F.coalesce(F.get(h["custom_values"], i), F.lit(float("inf")))).otherwise(high)
        return F.concat(F.lit("("), _number_text(low), F.lit(","), _number_text(high), F.lit("]:"), _number_text(n))

    negative = F.reverse(F.transform(h["negative_buckets"], lambda n, p: bucket(n, p, "negative")))
    positive = F.transform(h["positive_buckets"], lambda n, p: bucket(n, p, "positive"))
    around = F.concat(F.lit("["), _number_text(-h["zero_threshold"]), F.lit(","), _number_text(h["zero_threshold"]), F.lit("]:"), _number_text(h["zero_count"]))
    zero = F.when(h["zero_count"] != 0, F.array(around)).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("count:"), _number_text(h["count"])), F.concat(F.lit("sum:"), _number_text(h["sum"])))
    return F.concat(F.lit("{"), F.array_join(F.concat(head, negative, zero, positive), ", "), F.lit("}"))


def count_values(v: DataFrame, name: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """How many series of each group have each value or histogram, which becomes a label."""
    V.check_label(name)
    text = F.when(F.col("hist").isNull(), V.format_value(F.col("value"))).otherwise(format_histogram(F.col("hist")))
    g = V._grouped(v, by, without).withColumn("_value", text)
    g = g.withColumn("_gkey", label_key(put_label("_group", name, F.col("_value")))).groupBy("_gkey", "t")
    return of_floats(V._result(g.agg(F.count(F.lit(1)).alias("n")), F.col("n")))


# --- operators ----------------------------------------------------------------------------


def arithmetic(v: DataFrame, op: str, number: float, number_left: bool = False) -> DataFrame:
    """Floats as always; histograms are scaled by `*` and, on the left, by `/`, and give nothing otherwise."""
    out = of_floats(V.arithmetic(floats(v), op, number, number_left))
    if op != "*" and (op != "/" or number_left):
        return out
    factor = F.lit(float(number)) if op == "*" else F.lit(1.0) / F.lit(float(number))
    scaled = H.scale(histograms(v), factor).withColumn("labels", drop_labels("labels", list(V.METADATA_LABELS)))
    return out.unionByName(of_histograms(scaled.withColumn("lkey", label_key("labels"))))


def compare(v: DataFrame, op: str, number: float, as_bool: bool = False, number_left: bool = False) -> DataFrame:
    """Only floats compare with a number."""
    return of_floats(V.compare(floats(v), op, number, as_bool, number_left))


def binary(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one arithmetic: float with float, histogram + - histogram, histogram * / float, float * histogram, and histogram </ >/ float.

    Other pairs of kinds give nothing.
    """
    m = V.Matching(on=None if on is None else tuple(on), ignoring=tuple(ignoring))
    out = None
    if op not in ("</", ">/"):
        out = of_floats(V.binary(floats(left), floats(right), op, m))
    key = label_key(m.labels())
    one = lambda df, side: df.select(key.alias("_match"), "t", F.col("labels").alias(f"{side}_labels"), F.col("value").alias(f"{side}_value"), F.col("hist").alias(f"{side}_hist"))
    pairs = one(left, "l").join(one(right, "r"), ["_match", "t"]).where(F.col("l_hist").isNotNull() | F.col("r_hist").isNotNull())
    labels = drop_labels(m.labels(F.col("l_labels")), list(V.METADATA_LABELS))
    pairs = pairs.select(F.lit(None).cast("string").alias("metric"), labels.alias("labels"), label_key(labels).alias("lkey"), "t", "l_value", "r_value", "l_hist", "r_hist")
    keep = ["metric", "labels", "lkey", "t"]
    with_float = pairs.where(F.col("r_hist").isNull()).select(*keep, F.col("l_hist").alias("hist"), F.col("r_value").alias("x"))
    found = None
    if op in ("+", "-"):
        both = pairs.where(F.col("l_hist").isNotNull() & F.col("r_hist").isNotNull())
        a, b = (both.select(*keep, F.col(f"{s}_hist").alias("hist")) for s in "lr")
        found = H.add(a, b if op == "+" else H.scale(b, -1.0))
    elif op in ("*", "/"):
        found = H.scale(with_float, F.col("x") if op == "*" else F.lit(1.0) / F.col("x")).select(*keep, "hist")
        if op == "*":
            turned = pairs.where(F.col("l_hist").isNull()).select(*keep, F.col("r_hist").alias("hist"), F.col("l_value").alias("x"))
            found = found.unionByName(H.scale(turned, F.col("x")).select(*keep, "hist"))
    elif op in ("</", ">/"):
        found = H.trim(with_float, op, F.col("x")).select(*keep, "hist")
    if found is None:
        return out
    return of_histograms(found) if out is None else out.unionByName(of_histograms(found))


# --- ranges -------------------------------------------------------------------------------


def _linked(raw: DataFrame, grid, width: int, offset: int) -> DataFrame:
    """Each sample with the one before it, of whichever kind, and its steps, in chunks of steps."""
    df = raw.where(~F.col("is_stale")).withColumn("ts_ms", F.col("ts_ms") + F.lit(offset).cast("long"))
    lo, hi = steps_of(F.col("ts_ms"), grid, width)
    df = in_chunks(df.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi"), max(64, 8 * (width // grid.step + 1)))
    order = Window.partitionBy("metric", "lkey", "_chunk").orderBy("ts_ms")
    return df.withColumns({"before": F.lag("hist").over(order), "prev": F.lag("value").over(order), "first": F.row_number().over(order) == 1})


def _flagged(raw: DataFrame, grid, width: int, offset: int, flag: Column) -> DataFrame:
    rows = _linked(raw, grid, width, offset).select("metric", "lkey", "_chunk", "_lo", "_hi", "ts_ms", (~F.col("first") & F.coalesce(flag, F.lit(False))).cast("long").alias("hit"))
    g = at_steps(rows, grid).groupBy("metric", "lkey", "_chunk", "t").agg((F.sum("hit") - F.min_by("hit", "ts_ms")).cast("double").alias("value"))
    return of_floats(g.select("metric", labels_of("lkey").alias("labels"), "lkey", "t", F.col("t").alias("src_ts"), "value", F.lit(True).alias("drop_name")))


def _other_kind() -> Column:
    return F.col("hist").isNull() != F.col("before").isNull()


def changes(raw: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    """How often a sample of the window differs from the one before; a float and a histogram always do."""
    number = ~((F.col("value") == F.col("prev")) | (F.isnan("value") & F.isnan("prev")))
    hist = ~H._canonical(F.col("before")).eqNullSafe(H._canonical(F.col("hist")))
    return _flagged(raw, grid, width, offset, F.when(_other_kind(), True).when(F.col("hist").isNull(), number).otherwise(hist))


def resets(raw: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    """How often a sample doesn't continue the one before; a change of kind is a reset."""
    return _flagged(raw, grid, width, offset, F.when(_other_kind(), True).when(F.col("hist").isNull(), F.col("value") < F.col("prev")).otherwise(H._is_reset(F.col("before"), F.col("hist"))))


# --- guards -------------------------------------------------------------------------------


def _checked(df: DataFrame, keys: list[str], bad: DataFrame, text: Column) -> DataFrame:
    """The rows, where none of the keys is bad, or an error: it hangs on the rows' first key, so no projection prunes it."""
    marked = df.join(bad.select(*keys, F.lit(True).alias("_bad")), keys, "left")
    return marked.where(F.when(F.col("_bad"), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def single_representation(explicit: DataFrame, exponential: DataFrame) -> DataFrame:
    """Native histograms of both stores (metric, labels, lkey, ts_ms, hist), or an error for a series that is in both."""
    kinds = explicit.select("metric", "lkey", F.lit(1).alias("kind")).unionByName(exponential.select("metric", "lkey", F.lit(2).alias("kind")))
    bad = kinds.groupBy("metric", "lkey").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b")
    text = F.concat(F.lit("series contains both explicit and exponential histogram representations: "), F.coalesce("metric", F.lit("")), F.col("lkey"))
    return _checked(explicit.unionByName(exponential), ["metric", "lkey"], bad, text)


def histogram_function(v: DataFrame, native, classic) -> DataFrame:
    """native(histograms) and classic(floats) of a mixed vector, whose labels without le tell histograms apart.

    Of a native histogram and classic buckets with the same labels and metric neither counts;
    where their metrics differ, or buckets of several metrics would be one histogram, it is an error.
    """
    is_hist = F.col("hist").isNotNull()
    bucket = ~is_hist & (label("labels", "le") != "")
    rest = F.when(is_hist, label_key("labels")).otherwise(label_key(drop_labels("labels", ["le"])))
    keyed = v.where(is_hist | bucket).withColumn("_key", rest)
    g = keyed.groupBy("_key", "t").agg(F.count_if(is_hist).alias("natives"), F.count_if(bucket).alias("classics"), F.count_distinct(F.coalesce("metric", F.lit(""))).alias("metrics"))
    state = g.select("_key", "t", (F.col("metrics") > 1).alias("_several"), ((F.col("natives") > 0) & (F.col("classics") > 0)).alias("_both"))
    text = F.concat(F.lit("vector contains histograms of several kinds or metrics with the same labels: "), F.col("_key"))
    known = keyed.join(state, ["_key", "t"]).where(F.when(F.col("_several"), F.raise_error(text).cast("boolean")).otherwise(~F.col("_both"))).select(*MIXED)
    return native(histograms(known)).unionByName(classic(floats(known)))
