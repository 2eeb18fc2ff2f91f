"""Histograms: classic buckets, and native ones with exponential or custom buckets.

A native histogram is a struct (schema, zero_threshold, zero_count, positive_offset,
positive_buckets, negative_offset, negative_buckets, custom_values, sum, count).  Bucket i of
schema s covers (2 ** ((i - 1) / 2 ** s), 2 ** (i / 2 ** s)]; schema -53 has the bounds of
custom_values.  Operators explode the buckets to rows of (lower, upper, n), so that sums and
cumulative shares are ordinary aggregates and windows of each (series, step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.functions import ieee
from telemark.model import VECTOR, drop_labels, keep_labels, label, label_key, labels_of, put_label
from telemark.operators.windows import at_steps, in_chunks, steps_of

CUSTOM = -53
_KEY = ["lkey", "t"]


# --- classic ------------------------------------------------------------------------------


def _classic(v: DataFrame) -> DataFrame:
    """Labels without le, step, and the cumulative buckets in order, equal bounds merged and counts made monotone."""
    text = label("labels", "le")
    le = F.when(text.isin("+Inf", "Inf", "inf"), F.lit(ieee.INF)).otherwise(text.try_cast("double"))
    rest = drop_labels("labels", ["le"])
    rows = v.select(label_key(rest).alias("lkey"), "t", le.alias("le"), "value").where(F.col("le").isNotNull())
    merged = rows.groupBy("lkey", "t", "le").agg(F.sum("value").alias("value"))
    g = merged.groupBy("lkey", "t").agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b")).withColumn("labels", labels_of("lkey"))
    start = F.array().cast("array<struct<le:double,value:double>>")
    grown = F.aggregate("b", start, lambda acc, x: F.array_append(acc, F.struct(x["le"].alias("le"), F.greatest(x["value"], F.coalesce(F.get(acc, F.size(acc) - 1)["value"], F.lit(0.0))).alias("value"))))
    return g.withColumn("b", grown)


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def _classic_quantile(q: float) -> Column:
    b, n = F.col("b"), F.size("b")
    total, top = _at(b, n - 1)["value"], _at(b, n - 1)["le"]
    rank = total * q
    at = F.size(F.filter(b, lambda x: x["value"] < rank))  # the first bucket that reaches the rank
    upper, below = _at(b, at)["le"], F.coalesce(_at(b, at - 1)["value"], F.lit(0.0))
    lower = F.when(at == 0, F.lit(0.0)).otherwise(_at(b, at - 1)["le"])
    inside = lower + (upper - lower) * ieee.div(rank - below, _at(b, at)["value"] - below)
    empty = _at(b, at)["value"] == below  # the first bucket, at the quantile 0
    value = F.when(at >= n - 1, _at(b, n - 2)["le"]).when((at == 0) & (upper <= 0) | empty, upper).otherwise(inside)
    return F.when((n < 2) | (top != ieee.INF) | (total == 0) | F.isnan(total), F.lit(ieee.NAN)).otherwise(value)


def histogram_quantile(v: DataFrame, q: float) -> DataFrame:
    """The q-quantile of classic buckets, linear inside a bucket; below the first bound from zero."""
    g = _classic(v)
    value = F.lit(-ieee.INF if q < 0 else ieee.INF) if not 0 <= q <= 1 else _classic_quantile(q)
    return _classic_result(g, value)


def histogram_quantiles(v: DataFrame, name: str, *qs: float) -> DataFrame:
    """One series for each quantile, which becomes a label."""
    g = _classic(v)
    values = F.array(*(F.struct(F.lit(f"{q:g}").alias("q"), _classic_quantile(q).cast("double").alias("value")) for q in qs))
    out = g.withColumn("x", F.explode(values))
    return _classic_result(out, F.col("x.value"), put_label("labels", name, F.col("x.q")))


def histogram_fraction(v: DataFrame, low: float, high: float) -> DataFrame:
    """The share of observations between two values, linear inside a bucket."""
    g = _classic(v)
    b, n = F.col("b"), F.size("b")
    total = _at(b, n - 1)["value"]

    def below(x: float) -> Column:
        if x == ieee.INF:
            return total
        at = F.size(F.filter(b, lambda s: s["le"] < x))
        under = F.coalesce(_at(b, at - 1)["value"], F.lit(0.0))
        lower = F.when(at == 0, F.lit(0.0)).otherwise(_at(b, at - 1)["le"])
        upper = _at(b, at)["le"]
        share = F.when(upper == ieee.INF, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), ieee.div(F.lit(float(x)) - lower, upper - lower)))
        return under + (_at(b, at)["value"] - under) * share

    value = F.when(total == 0, F.lit(ieee.NAN)).otherwise((below(high) - below(low)) / total) if low < high else F.lit(0.0)
    return _classic_result(g, value)


def _classic_result(g: DataFrame, value: Column, labels: Column | None = None) -> DataFrame:
    out = g.withColumn("labels", labels) if labels is not None else g
    return out.select(F.lit(None).cast("string").alias("metric"), "labels", label_key("labels").alias("lkey"), "t", F.col("t").alias("src_ts"), value.cast("double").alias("value"), F.lit(True).alias("drop_name")).select(*VECTOR)


# --- native -------------------------------------------------------------------------------


def native_from_explicit(h: DataFrame) -> DataFrame:
    """Explicit bounds and counts as native histograms with custom buckets."""
    none = F.array().cast("array<double>")
    hist = F.struct(
        F.lit(CUSTOM).alias("schema"), F.lit(0.0).alias("zero_threshold"), F.lit(0.0).alias("zero_count"), F.lit(0).alias("positive_offset"), F.transform("counts", lambda c: c.cast("double")).alias("positive_buckets"),
        F.lit(0).alias("negative_offset"), none.alias("negative_buckets"), F.col("buckets").alias("custom_values"), F.coalesce("sum", F.lit(ieee.NAN)).alias("sum"), F.col("count").cast("double").alias("count"),
    )
    return h.select("metric", F.col("tags").alias("labels"), "lkey", F.col("ts_end_ms").alias("ts_ms"), hist.alias("hist"))


def instant(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    """The latest histogram of each window."""
    df = _in_windows(samples, grid, width, offset)
    return df.groupBy("metric", "lkey", "t").agg(F.first("labels").alias("labels"), F.max_by("hist", "ts_ms").alias("hist"))


def _value(v: DataFrame, value: Column) -> DataFrame:
    labels = F.col("labels")
    return v.select("metric", labels.alias("labels"), "lkey", "t", F.col("t").alias("src_ts"), value.cast("double").alias("value"), F.lit(True).alias("drop_name")).select(*VECTOR)


def count(v: DataFrame) -> DataFrame:
    return _value(v, F.col("hist.count"))


def sum_(v: DataFrame) -> DataFrame:
    return _value(v, F.col("hist.sum"))


def avg(v: DataFrame) -> DataFrame:
    return _value(v, ieee.div(F.col("hist.sum"), F.col("hist.count")))


def bucket_rows(v: DataFrame) -> DataFrame:
    """Every bucket with its bounds: key columns, schema, side (-1, 0, 1), i, lower, upper, n."""
    h = F.col("hist")
    base = v.select("metric", "labels", "lkey", "t", "hist")
    ratio = F.pow(F.lit(2.0), -h["schema"].cast("double"))
    keys = ["metric", "labels", "lkey", "t"]

    def side(sign: int) -> DataFrame:
        name = "positive" if sign > 0 else "negative"
        rows = base.select(*keys, "hist", F.posexplode(f"hist.{name}_buckets").alias("p", "n"))
        i = (F.col("p") + h[f"{name}_offset"]).cast("int")
        outer, inner = F.pow(F.lit(2.0), i * ratio), F.pow(F.lit(2.0), (i - 1) * ratio)
        low = F.when(h["schema"] == CUSTOM, F.coalesce(_at(h["custom_values"], i - 1), F.lit(-ieee.INF))).otherwise(inner if sign > 0 else -outer)
        high = F.when(h["schema"] == CUSTOM, F.coalesce(_at(h["custom_values"], i), F.lit(ieee.INF))).otherwise(outer if sign > 0 else -inner)
        return rows.select(*keys, h["schema"].alias("schema"), F.lit(sign).alias("side"), i.alias("i"), low.alias("lower"), high.alias("upper"), "n")

    # around zero, but only on the side that is filled, if one alone is
    filled = lambda name: F.exists(h[f"{name}_buckets"], lambda n: n != 0)
    low = F.when(filled("negative") | ~filled("positive"), -h["zero_threshold"]).otherwise(F.lit(0.0))
    high = F.when(filled("positive") | ~filled("negative"), h["zero_threshold"]).otherwise(F.lit(0.0))
    zero = base.where("hist.zero_count > 0").select(*keys, h["schema"].alias("schema"), F.lit(0).alias("side"), F.lit(0).alias("i"), low.alias("lower"), high.alias("upper"), h["zero_count"].alias("n"))
    return side(1).unionByName(side(-1)).unionByName(zero).where("n <> 0")


def _cumulative(v: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_KEY).orderBy("lower", "upper")
    every = Window.partitionBy(*_KEY)
    return bucket_rows(v).withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(every), "least": F.min("lower").over(every)})


def _inside(share: Column) -> Column:
    """A value inside a bucket: by the logarithm in exponential buckets, linear around zero and in custom ones."""
    lower, upper = F.col("lower"), F.col("upper")
    linear = lower + (upper - lower) * share
    positive = F.pow(F.lit(2.0), F.log2(lower) + (F.log2(upper) - F.log2(lower)) * share)
    negative = -F.pow(F.lit(2.0), F.log2(-lower) + (F.log2(-upper) - F.log2(-lower)) * share)
    custom = F.when(lower == -ieee.INF, F.when(upper > 0, upper * share).otherwise(upper)).when(upper == ieee.INF, lower).otherwise(linear)
    return F.when(F.col("schema") == CUSTOM, custom).when(F.col("side") == 0, linear).when(F.col("side") > 0, positive).otherwise(negative)


def quantile(v: DataFrame, q: float) -> DataFrame:
    """The q-quantile of native histograms; NaN of empty ones.

    A rank at the edge of an exponential bucket is the lower bound of the next filled one,
    one at the edge of a custom bucket the edge itself.
    """
    if not 0 <= q <= 1:
        return _value(v, F.lit(-ieee.INF if q < 0 else ieee.INF))
    known = v.select(*_KEY, F.col("hist.count").alias("all"), F.get("hist.positive_buckets", F.lit(0)).alias("n0"), F.get("hist.custom_values", F.lit(0)).alias("bound0"))
    rows = _cumulative(v).join(known, _KEY)
    is_custom = F.col("schema") == CUSTOM
    rank = F.when(is_custom, F.col("total")).otherwise(F.col("all")) * q
    below = F.col("upto") - F.col("n")
    reaches = F.when(is_custom, F.col("upto") >= rank).otherwise((F.col("upto") > rank) | (F.col("upto") == F.col("total")) & (rank == F.col("total")))
    x = F.when(rank == below, F.col("lower")).when(rank == F.col("upto"), F.col("upper")).otherwise(_inside(ieee.div(rank - below, F.col("n"))))
    at_zero = F.when((F.col("n0") == 0) | (F.col("bound0") <= 0), F.col("bound0")).otherwise(F.lit(0.0))  # the first custom bucket, empty or not
    x = F.when(is_custom, F.when(F.lit(q == 0), at_zero).otherwise(_inside(ieee.div(rank - below, F.col("n"))))).otherwise(x)
    first = rows.where(reaches).withColumn("x", x).groupBy(*_KEY).agg(F.min_by("x", "upto").alias("x"))
    return _value(v.join(first, _KEY, "left"), F.coalesce("x", F.lit(ieee.NAN)))


def quantiles(v: DataFrame, name: str, *qs: float) -> DataFrame:
    """One series for each quantile of native histograms, which becomes a label."""
    each = [quantile(v, q).withColumn("labels", put_label("labels", name, F.lit(f"{q:g}"))) for q in qs]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.withColumn("lkey", label_key("labels")).select(*VECTOR)


def fraction(v: DataFrame, low: float, high: float) -> DataFrame:
    """The share of observations of native histograms between two values."""
    lower, upper = F.col("lower"), F.col("upper")

    def below(x: float) -> Column:
        at = F.lit(float(x))
        log = F.when(lower > 0, ieee.div(F.log2(at) - F.log2(lower), F.log2(upper) - F.log2(lower))).otherwise(1 - ieee.div(F.log2(-at) - F.log2(-upper), F.log2(-lower) - F.log2(-upper)))
        linear = ieee.div(at - lower, upper - lower)
        share = F.when((F.col("schema") == CUSTOM) | (F.col("side") == 0), F.when(lower == -ieee.INF, ieee.div(at, upper)).when(upper == ieee.INF, F.lit(0.0)).otherwise(linear)).otherwise(log)
        return F.when(upper <= at, F.lit(1.0)).when(lower >= at, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share))

    g = bucket_rows(v).groupBy(*_KEY).agg(F.sum(F.col("n") * (below(high) - below(low))).alias("x"), F.sum("n").alias("total"))
    return _value(v.join(g, _KEY, "left"), F.when(F.lit(low >= high), F.lit(0.0)).otherwise(ieee.div(F.coalesce("x", F.lit(0.0)), F.coalesce("total", F.lit(0.0)))))


def variance(v: DataFrame) -> DataFrame:
    """Around the mean, with each bucket at its geometric mean (zero in the zero bucket, the middle of custom ones)."""
    lower, upper = F.col("lower"), F.col("upper")
    custom = F.when(lower == -ieee.INF, upper / 2).when(upper == ieee.INF, lower).otherwise((lower + upper) / 2)
    middle = F.when(F.col("schema") == CUSTOM, custom).when(F.col("side") == 0, F.lit(0.0)).when(F.col("side") > 0, F.sqrt(lower * upper)).otherwise(-F.sqrt(lower * upper))
    mean = v.select(*_KEY, ieee.div(F.col("hist.sum"), F.col("hist.count")).alias("mean"), F.col("hist.count").alias("all"))
    g = bucket_rows(v).join(mean, _KEY).groupBy(*_KEY).agg(F.sum(F.col("n") * F.pow(middle - F.col("mean"), F.lit(2.0))).alias("x"), F.first("all").alias("all"))
    return _value(v.join(g, _KEY, "left"), F.coalesce(ieee.div(F.col("x"), F.col("all")), F.lit(ieee.NAN)))


def stddev(v: DataFrame) -> DataFrame:
    return variance(v).withColumn("value", F.sqrt("value"))


def scale(v: DataFrame, factor: float | Column) -> DataFrame:
    """All counts and the sum times a number."""
    h, x = F.col("hist"), factor if isinstance(factor, Column) else F.lit(float(factor))
    scaled = lambda c: F.transform(h[c], lambda n: n * x)
    return v.withColumn("hist", h.withField("positive_buckets", scaled("positive_buckets")).withField("negative_buckets", scaled("negative_buckets")).withField("zero_count", h["zero_count"] * x).withField("sum", h["sum"] * x).withField("count", h["count"] * x))


def _combined(v: DataFrame, group: Column) -> DataFrame:
    """gkey, t, series, hist: the sum of the histograms of each group label map and step, and how many they were.

    Every histogram is read once: its buckets and its totals are rows that are added up at their
    own resolution before they are shuffled; the group's resolution or bounds are known once
    they are together, and all further steps keep that partitioning.
    """
    h = F.col("hist")

    def cells(side: str, sign: int) -> Column:
        return F.transform(h[f"{side}_buckets"], lambda n, p: F.struct(F.lit(sign).alias("side"), (p + h[f"{side}_offset"]).cast("int").alias("i"), n.alias("n"), F.lit(0.0).alias("zero_count"), F.lit(None).cast("double").alias("zero_threshold"), F.lit(0.0).alias("sum"), F.lit(0).alias("series")))

    whole = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("i"), h["count"].alias("n"), h["zero_count"].alias("zero_count"), h["zero_threshold"].alias("zero_threshold"), h["sum"].alias("sum"), F.lit(1).alias("series")))
    each = v.select(label_key(group).alias("gkey"), "t", h["schema"].alias("schema"), h["custom_values"].alias("custom_values"), F.explode(F.concat(cells("positive", 1), cells("negative", -1), whole)).alias("x"))
    add = lambda c="": [F.sum(f"{c}n").alias("n"), F.sum(f"{c}zero_count").alias("zero_count"), F.max(f"{c}zero_threshold").alias("zero_threshold"), F.sum(f"{c}sum").alias("sum"), F.sum(f"{c}series").alias("series")]
    part = each.groupBy("gkey", "t", "schema", "custom_values", F.col("x.side").alias("side"), F.col("x.i").alias("i")).agg(*add("x."))
    together = Window.partitionBy("gkey", "t")
    part = part.withColumns({"to": F.min("schema").over(together), "most": F.max("schema").over(together), "bounds": F.collect_set("custom_values").over(together)})
    part = part.where((F.col("to") > CUSTOM) | (F.col("most") == CUSTOM))
    part = part.withColumn("shared", F.aggregate(F.slice("bounds", 2, F.size("bounds")), F.get("bounds", F.lit(0)), lambda a, x: F.array_intersect(a, x)))
    own = _at(F.col("custom_values"), F.col("i"))
    among = F.when(own.isNull(), F.size("shared")).otherwise(F.size(F.filter("shared", lambda b: b < own)))
    shrunk = F.ceil(F.col("i") / F.pow(F.lit(2.0), (F.col("schema") - F.col("to")).cast("double")))
    part = part.withColumn("i", F.when(F.col("side") == 0, 0).when(F.col("to") == CUSTOM, among).otherwise(shrunk).cast("int"))
    keys = ["gkey", "t", "to", "shared"]
    sides = part.groupBy(*keys, "side", "i").agg(*add()).groupBy(*keys, "side").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), *add())
    sides = sides.withColumn("b", F.transform(F.sequence("lo", "hi"), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))))
    pick = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)
    none = F.array().cast("array<double>")
    g = sides.groupBy(*keys).agg(*(pick(s, c).alias(f"{n}_{c}") for s, n in ((1, "p"), (-1, "m")) for c in ("lo", "b")), *(pick(0, c).alias(c) for c in ("n", "zero_count", "zero_threshold", "sum", "series")))
    hist = F.struct(
        F.col("to").alias("schema"), "zero_threshold", "zero_count", F.coalesce("p_lo", F.lit(0)).alias("positive_offset"), F.coalesce("p_b", none).alias("positive_buckets"),
        F.coalesce("m_lo", F.lit(0)).alias("negative_offset"), F.coalesce("m_b", none).alias("negative_buckets"), F.col("shared").alias("custom_values"), "sum", F.col("n").alias("count"),
    )
    return g.select("gkey", "t", "series", hist.alias("hist"))


def _kept(by: list[str] | None, without: list[str] | None) -> Column:
    return drop_labels("labels", without) if without is not None else keep_labels("labels", by or [])


def _as_vector(g: DataFrame, hist: Column) -> DataFrame:
    return g.select(F.lit(None).cast("string").alias("metric"), labels_of("gkey").alias("labels"), F.col("gkey").alias("lkey"), "t", hist.alias("hist"))


def combine(v: DataFrame, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Sum of the native histograms of each group and step.

    Exponential ones are brought to the group's lowest resolution: a bucket i goes to
    ceil(i / 2 ** difference).  Custom ones keep the bounds that all of the group have, and a
    bucket goes to the next of these.  Groups of both kinds give nothing; mixed.conflicts()
    has them.
    """
    return _as_vector(_combined(v, _kept(by, without)), F.col("hist"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Series by series; what has no partner gives nothing."""
    both = a.select(*_KEY, "hist").unionByName(b.select(*_KEY, "hist")).withColumn("labels", F.create_map(F.lit("_key"), F.col("lkey")))
    summed = _combined(both, F.col("labels")).where("series = 2")
    key = F.element_at(labels_of("gkey"), "_key")
    return summed.select(F.lit(None).cast("string").alias("metric"), labels_of(key).alias("labels"), key.alias("lkey"), "t", "hist")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, scale(b, -1.0))


def _canonical(h: Column) -> Column:
    """What makes two histograms equal, whatever empty buckets they list."""
    filled = lambda side: F.filter(F.transform(h[f"{side}_buckets"], lambda n, p: F.struct((p + h[f"{side}_offset"]).alias("i"), n.alias("n"))), lambda b: b["n"] != 0)
    return F.struct(*(h[c] for c in ("schema", "zero_threshold", "zero_count", "custom_values", "sum", "count")), filled("positive"), filled("negative"))


def compare(a: DataFrame, b: DataFrame, op: str, as_bool: bool = False) -> DataFrame:
    """`==` or `!=` series by series: the left histograms for which it holds, or 1 and 0."""
    if op not in ("==", "!="):
        raise ValueError(f"histograms can't be compared by {op}")
    other = b.select(*_KEY, _canonical(F.col("hist")).alias("_other"))
    both = a.join(other, _KEY)
    same = _canonical(F.col("hist")).eqNullSafe(F.col("_other"))
    holds = same if op == "==" else ~same
    return _value(both, holds.cast("double")) if as_bool else both.where(holds).select("metric", "labels", "lkey", "t", "hist")


def mean(v: DataFrame, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """The average histogram of each group."""
    total = _combined(v, _kept(by, without))
    return _as_vector(scale(total, 1.0 / F.col("series")), F.col("hist"))


def _trimmed_side(v: DataFrame, side: str, at: Column, above: bool) -> DataFrame:
    """With _offset, _buckets, _n and _s of a side: its buckets cut at `at`, without the empty ones on the side that goes, their count and sum."""
    h, sign = F.col("hist"), 1 if side == "positive" else -1
    custom, ratio = h["schema"] == CUSTOM, F.pow(F.lit(2.0), -h["schema"].cast("double"))
    offset, buckets, bounds = h[f"{side}_offset"], h[f"{side}_buckets"], h["custom_values"]
    first_low = F.when((F.size(bounds) > 0) & (F.get(bounds, F.lit(0)) > 0), F.lit(0.0)).otherwise(F.lit(-ieee.INF))

    def bounds_of(n: Column, p: Column) -> Column:
        i = p + offset
        outer, inner = F.pow(F.lit(2.0), i * ratio), F.pow(F.lit(2.0), (i - 1) * ratio)
        low = F.when(custom, F.when(i == 0, first_low).otherwise(F.get(bounds, i - 1))).otherwise(inner if sign > 0 else -outer)
        high = F.when(custom, F.coalesce(F.get(bounds, i), F.lit(ieee.INF))).otherwise(outer if sign > 0 else -inner)
        return F.struct(n.alias("n"), low.alias("low"), high.alias("high"))

    name = lambda x: f"_{side}_{x}"
    v = v.withColumn(name("wide"), F.transform(buckets, bounds_of))
    v = v.withColumn(name("parts"), F.transform(name("wide"), lambda x: _cut_bucket(x["n"], x["low"], x["high"], at, above, ~custom)))
    v = v.withColumn(name("counts"), F.transform(name("parts"), lambda x: x["n"]))
    v = v.withColumn(name("places"), F.filter(F.transform(name("counts"), lambda n, p: F.when(n != 0, p)), lambda p: p.isNotNull()))
    counts, places, size = F.col(name("counts")), F.col(name("places")), F.size(buckets)
    leading = above if sign > 0 else not above
    first = F.when(F.size(places) == 0, size).otherwise(F.get(places, F.lit(0))) if leading else F.lit(0)
    last = size if leading else F.when(F.size(places) == 0, F.lit(0)).otherwise(F.try_element_at(places, F.lit(-1)) + 1)
    v = v.withColumns({name("first"): first, name("length"): F.greatest(last - first, F.lit(0))})
    add = lambda f: F.aggregate(name("parts"), F.lit(0.0), lambda a, x: a + x[f])
    v = v.withColumns({name("offset"): (offset + F.col(name("first"))).cast("int"), name("buckets"): F.slice(counts, F.col(name("first")) + 1, F.col(name("length"))), name("n"): add("n"), name("s"): add("s")})
    return v.drop(*(name(x) for x in ("wide", "parts", "counts", "places", "first", "length")))


def _cut_bucket(n: Column, lower: Column, upper: Column, at: Column, above: bool, exponential: Column) -> Column:
    """n, s: what lies on one side of `at`, by its share of the bucket, and an estimate of its sum."""
    lo, hi = (F.greatest(lower, at), upper) if above else (lower, F.least(upper, at))
    x = lo if above else hi  # the edge that cuts
    log = F.when(upper <= 0, ieee.div(F.ln(-x) - F.ln(-lower), F.ln(-upper) - F.ln(-lower))).otherwise(ieee.div(F.ln(x) - F.ln(lower), F.ln(upper) - F.ln(lower)))
    place = F.when(exponential, log).otherwise(ieee.div(x - lower, upper - lower))
    share = F.when(~exponential & ((lower == -ieee.INF) | (upper == ieee.INF)), F.when((hi == ieee.INF) if above else (lo == -ieee.INF), 1.0).otherwise(0.0)).otherwise(1 - place if above else place)
    count = F.when(lo >= hi, 0.0).when((lo <= lower) & (hi >= upper), n).otherwise(n * share)
    geometric = F.when(hi <= 0, -F.sqrt(F.abs(lo * hi))).otherwise(F.sqrt(F.abs(lo * hi)))
    middle = F.when(lo == -ieee.INF, hi).when(hi == ieee.INF, lo).otherwise((lo + hi) / 2)
    total = F.when((lo >= hi) | (count == 0), 0.0).otherwise(count * F.when(exponential, geometric).otherwise(middle))
    return F.struct(count.cast("double").alias("n"), total.cast("double").alias("s"))


def trim(v: DataFrame, op: str, cut: float | Column) -> DataFrame:
    """`</` keeps what lies below the cut, `>/` what lies above: histograms whose bucket at the cut is split by its share, sum and count estimated anew."""
    above, h, at = op == ">/", F.col("hist"), cut if isinstance(cut, Column) else F.lit(float(cut))
    filled = lambda side: F.exists(h[f"{side}_buckets"], lambda n: n != 0)
    low = F.when(filled("negative") | ~filled("positive"), -h["zero_threshold"]).otherwise(F.lit(0.0))
    high = F.when(filled("positive") | ~filled("negative"), h["zero_threshold"]).otherwise(F.lit(0.0))
    zero = _cut_bucket(h["zero_count"], low, high, at, above, F.lit(False))
    zero = F.when(h["schema"] == CUSTOM, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))).otherwise(zero)
    out = _trimmed_side(_trimmed_side(v, "positive", at, above), "negative", at, above).withColumn("_z", zero)
    total = lambda x: F.col(f"_positive_{x}") + F.col(f"_negative_{x}") + F.col("_z")[x]
    kept = {"zero_count": F.col("_z")["n"], "count": total("n"), "sum": total("s")}
    kept |= {f"{side}_{x}": F.col(f"_{side}_{x}") for side in ("positive", "negative") for x in ("offset", "buckets")}
    fields = ("schema", "zero_threshold", "zero_count", "positive_offset", "positive_buckets", "negative_offset", "negative_buckets", "custom_values", "sum", "count")
    new = F.struct(*(kept.get(f, h[f]).alias(f) for f in fields))
    whole = at == (-ieee.INF if above else ieee.INF)
    return out.withColumn("hist", F.when(whole, h).otherwise(new)).select(*v.columns)


def _in_windows(samples: DataFrame, grid, width: int, offset: int) -> DataFrame:
    """The histograms with a row for each step t whose window holds them."""
    df = samples.withColumn("ts_ms", F.col("ts_ms") + F.lit(offset).cast("long"))
    lo, hi = steps_of(F.col("ts_ms"), grid, width)
    return at_steps(df.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi"), grid).drop("_lo", "_hi")


_SERIES = ["metric", "lkey", "t"]


def _is_reset(a: Column, b: Column) -> Column:
    """Whether b doesn't continue a: another schema, or a count, the zero bucket's or any bucket's among them, that fell."""

    def fell(side: str) -> Column:
        shift = a[f"{side}_offset"] - b[f"{side}_offset"]
        now = lambda p: F.when(p + shift >= 0, F.get(b[f"{side}_buckets"], (p + shift).cast("int")))
        return F.exists(F.transform(a[f"{side}_buckets"], lambda n, p: n > F.coalesce(now(p), F.lit(0.0))), lambda x: x)

    return (a["schema"] != b["schema"]) | (b["count"] < a["count"]) | (b["zero_count"] < a["zero_count"]) | fell("positive") | fell("negative")


def _linked(samples: DataFrame, grid, width: int, offset: int) -> DataFrame:
    """Each histogram with the one before it (hist and time) and whether it is a reset, and its steps _lo to _hi, in chunks of steps.

    What two neighbours have to do with one another is settled once, not in every window that
    holds both; a chunk is a bounded time of a series.
    """
    df = samples.withColumn("ts_ms", F.col("ts_ms") + F.lit(offset).cast("long"))
    lo, hi = steps_of(F.col("ts_ms"), grid, width)
    df = in_chunks(df.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi"), max(64, 8 * (width // grid.step + 1)))
    order = Window.partitionBy("metric", "lkey", "_chunk").orderBy("ts_ms")
    df = df.withColumns({"before": F.lag("hist").over(order), "before_ts": F.lag("ts_ms").over(order)})
    return df.withColumn("reset", F.col("before").isNotNull() & F.coalesce(_is_reset(F.col("before"), F.col("hist")), F.lit(False)))


def _at_times(times: DataFrame, samples: DataFrame, offset: int) -> DataFrame:
    """Rows metric, lkey, t, ts_ms, sign to the histograms of those times, times the sign."""
    held = samples.select(F.coalesce("metric", F.lit("")).alias("_name"), "lkey", (F.col("ts_ms") + F.lit(offset).cast("long")).alias("ts_ms"), "labels", "hist")
    named = times.withColumn("_name", F.coalesce("metric", F.lit("")))
    return scale(named.join(held, ["_name", "lkey", "ts_ms"]).drop("_name"), F.col("sign"))


def _summed(parts: DataFrame, mean: bool = False) -> DataFrame:
    """The sum (or mean) of the histograms of each series and step."""
    name = F.create_map(F.lit("_name"), F.coalesce("metric", F.lit("")), F.lit("_key"), F.col("lkey"))
    out = _combined(parts.select(name.alias("labels"), "t", "hist"), F.col("labels"))
    out = scale(out, 1.0 / F.col("series")) if mean else out
    own = labels_of("gkey")
    metric, key = F.try_element_at(own, F.lit("_name")), F.element_at(own, "_key")
    return out.select(metric.alias("metric"), labels_of(key).alias("labels"), key.alias("lkey"), "t", "hist")


def increase(samples: DataFrame, grid, width: int, offset: int = 0, extrapolate: bool = True) -> DataFrame:
    """Growth of cumulative histograms in each window of two at least: last less first, and what they held at each reset.

    Extrapolated to the window's ends as for counters: by half a mean interval where an end is
    further away than 1.1 of them, and not to before the count would have been zero.
    """
    linked = _linked(samples, grid, width, offset)
    light = at_steps(linked.select("metric", "lkey", "_chunk", "_lo", "_hi", "ts_ms", "before_ts", "reset", F.col("hist.count").alias("c")), grid)
    fell = F.when(F.col("reset"), F.struct("ts_ms", "before_ts"))
    stats = light.groupBy("metric", "lkey", "_chunk", "t").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("c", "ts_ms").alias("held"), F.collect_list(fell).alias("fell")).where("n > 1")
    # the last one, less the first one, and the one before each reset inside the window
    inside = F.transform(F.filter("fell", lambda x: x["ts_ms"] > F.col("first")), lambda x: F.struct(x["before_ts"].alias("ts_ms"), F.lit(1.0).alias("sign")))
    ends = F.array(F.struct(F.col("last").alias("ts_ms"), F.lit(1.0).alias("sign")), F.struct(F.col("first").alias("ts_ms"), F.lit(-1.0).alias("sign")))
    times = stats.select(*_SERIES, F.explode(F.concat(ends, inside)).alias("x")).select(*_SERIES, "x.*")
    out = _summed(_at_times(times, samples, offset))
    if not extrapolate:
        return out
    out = out.join(stats.drop("_chunk", "fell"), _SERIES)
    sampled = (F.col("last") - F.col("first")).cast("double")
    gap = sampled / (F.col("n") - 1)
    to_start, to_end = (F.col("first") - (F.col("t") - width)).cast("double"), (F.col("t") - F.col("last")).cast("double")
    to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
    to_zero = sampled * F.col("held") / F.col("hist.count")
    to_start = F.when((F.col("hist.count") > 0) & (F.col("held") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    to_end = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
    return scale(out, ieee.div(sampled + to_start + to_end, sampled)).select("metric", "labels", "lkey", "t", "hist")


def rate(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    """increase() per second of the window."""
    return scale(increase(samples, grid, width, offset), 1000.0 / width)


def irate(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    """Growth from the last but one to the last histogram of each window, per second (of one second at least)."""
    light = at_steps(_linked(samples, grid, width, offset).select("metric", "lkey", "_chunk", "_lo", "_hi", "ts_ms", "before_ts", "reset"), grid)
    last = F.max_by(F.struct("ts_ms", "before_ts", "reset"), "ts_ms")
    two = light.groupBy("metric", "lkey", "_chunk", "t").agg(F.count(F.lit(1)).alias("n"), last.alias("x")).where("n > 1")
    seconds = F.greatest((F.col("x.ts_ms") - F.col("x.before_ts")) / 1000.0, F.lit(1.0))
    now, before = F.struct(F.col("x.ts_ms").alias("ts_ms"), (1 / seconds).alias("sign")), F.struct(F.col("x.before_ts").alias("ts_ms"), (-1 / seconds).alias("sign"))
    times = two.select(*_SERIES, F.explode(F.when(F.col("x.reset"), F.array(now)).otherwise(F.array(now, before))).alias("y")).select(*_SERIES, "y.*")
    return _summed(_at_times(times, samples, offset))


def sum_over_time(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    return _summed(_in_windows(samples, grid, width, offset))


def avg_over_time(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    return _summed(_in_windows(samples, grid, width, offset), mean=True)


def _counted(df: DataFrame, value: Column) -> DataFrame:
    """A number for each series and step."""
    g = df.groupBy(*_SERIES).agg(value.cast("double").alias("value"))
    return g.select("metric", labels_of("lkey").alias("labels"), "lkey", "t", F.col("t").alias("src_ts"), "value", F.lit(True).alias("drop_name")).select(*VECTOR)


def count_over_time(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    return _counted(_in_windows(samples, grid, width, offset), F.count(F.lit(1)))


def _flagged(samples: DataFrame, grid, width: int, offset: int, flag: Column) -> DataFrame:
    """How many histograms of a window, but for its first, have a flag."""
    rows = _linked(samples, grid, width, offset).select("metric", "lkey", "_chunk", "_lo", "_hi", "ts_ms", F.coalesce(flag, F.lit(False)).cast("long").alias("hit"))
    g = at_steps(rows, grid).groupBy("metric", "lkey", "_chunk", "t").agg((F.sum("hit") - F.min_by("hit", "ts_ms")).cast("double").alias("value"))
    return g.select("metric", labels_of("lkey").alias("labels"), "lkey", "t", F.col("t").alias("src_ts"), "value", F.lit(True).alias("drop_name")).select(*VECTOR)


def changes(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    """How often a histogram of the window differs from the one before."""
    differs = F.col("before").isNotNull() & ~_canonical(F.col("before")).eqNullSafe(_canonical(F.col("hist")))
    return _flagged(samples, grid, width, offset, differs)


def resets(samples: DataFrame, grid, width: int, offset: int = 0) -> DataFrame:
    return _flagged(samples, grid, width, offset, F.col("reset"))
