"""Requests over stored metrics: bucketed aggregation, sums, histograms, discovery, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.model import attr_str, label_key

RESOLUTION_MS = {"SECONDLY": 1_000, "MINUTELY": 60_000, "HOURLY": 3_600_000}
HINT_LIMIT = 500
EXEMPLAR_LIMIT = 1000
_PERCENTILES = {"P25": 0.25, "P50": 0.5, "P75": 0.75, "P90": 0.9, "P95": 0.95, "P99": 0.99}


def aggregate_column(name: str, value: Column) -> Column:
    """AVG, SUM, MIN, MAX, COUNT or a percentile P25 to P99."""
    if name in _PERCENTILES:
        return F.percentile(value, _PERCENTILES[name])
    return {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[name](value)


def has_tags(tags: dict[str, str], column: str = "tags") -> Column:
    """The rows that have all of these tags, whatever else they have."""
    out = F.lit(True)
    for k, v in tags.items():
        out = out & (attr_str(column, k) == v)
    return out


def gauge_buckets(gauges: DataFrame, metric: str, start: int, end: int, aggregation: str, resolution: str, tags: dict[str, str] | None = None) -> DataFrame:
    """A row for each series, unit and time bucket of [start, end): tags, lkey, unit, bucket_ms, value."""
    width = RESOLUTION_MS[resolution]
    rows = gauges.where((F.col("metric") == metric) & (F.col("ts_ms") >= start) & (F.col("ts_ms") < end) & has_tags(tags or {}))
    g = rows.groupBy("lkey", "unit", (F.col("ts_ms") - F.col("ts_ms") % width).alias("bucket_ms"))
    return g.agg(F.first("tags").alias("tags"), aggregate_column(aggregation, F.col("value")).cast("double").alias("value"))


def _overlapping(rows: DataFrame, metric: str, start: int, end: int, tags: dict[str, str] | None) -> DataFrame:
    return rows.where((F.col("metric") == metric) & (F.col("ts_start_ms") < end) & (F.col("ts_end_ms") > start) & has_tags(tags or {}))


def sum_query(sums: DataFrame, metric: str, start: int, end: int, temporality: str = "DELTA_AGGREGATE", tags: dict[str, str] | None = None) -> DataFrame:
    """Of samples that overlap the window, by series and unit: deltas added up, or the largest cumulative sample."""
    rows = _overlapping(sums, metric, start, end, tags)
    if temporality == "DELTA_AGGREGATE":
        g = rows.where("sums_type = 'DELTA'").groupBy("lkey", "unit").agg(F.first("tags").alias("tags"), F.min("ts_start_ms").alias("ts_start_ms"), F.max("ts_end_ms").alias("ts_end_ms"), F.sum("value").alias("value"))
        return g.select("tags", "lkey", "unit", "ts_start_ms", "ts_end_ms", "value")
    best = rows.where("sums_type = 'CUMULATIVE'").groupBy("lkey", "unit").agg(F.first("tags").alias("tags"), F.max(F.struct("value", "ts_end_ms", "ts_start_ms")).alias("s"))
    return best.select("tags", "lkey", "unit", "s.ts_start_ms", "s.ts_end_ms", "s.value")


def cumulative_to_delta(sums: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """Cumulative samples as deltas: less the one before, or the value itself at the start and after a reset.

    A series is sorted in chunks of time; a chunk's first sample goes on from the last one of the chunk before that has any.
    """
    stream, chunk = ["metric", "lkey", "unit"], F.floor(F.col("ts_end_ms") / chunk_ms)
    place = F.struct("ts_end_ms", "ts_start_ms", "value")
    rows = sums.withColumns({"_chunk": chunk, "_place": place})
    ends = rows.groupBy(*stream, "_chunk").agg(F.max("_place").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*stream).orderBy("_chunk"))["value"])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*stream, "_chunk")]
    rows = rows.join(ends.select(*(F.col(c).alias(f"_of_{c}") for c in (*stream, "_chunk")), "_before"), same)
    before = F.coalesce(F.lag("value").over(Window.partitionBy(*stream, "_chunk").orderBy("_place")), "_before")
    rows = rows.withColumn("_change", F.col("value") - before)
    out = rows.withColumns({"value": F.when(F.col("_change").isNull() | (F.col("_change") < 0), F.col("value")).otherwise(F.col("_change")), "sums_type": F.lit("DELTA")})
    return out.select(*sums.columns)


def sum_scan(sums: DataFrame, metric: str, start: int, end: int, tags: dict[str, str] | None = None) -> DataFrame:
    """Samples that overlap the window, as deltas: a series' own deltas if it has any there, else its cumulative samples' changes.

    Each series chooses for itself; the first cumulative sample of the window counts as a whole.
    """
    rows = _overlapping(sums, metric, start, end, tags)
    deltas, totals = rows.where("sums_type = 'DELTA'"), rows.where("sums_type = 'CUMULATIVE'")
    have = deltas.select(F.col("lkey").alias("_lkey"), F.col("unit").alias("_unit")).distinct()
    alone = totals.join(have, F.col("lkey").eqNullSafe(F.col("_lkey")) & F.col("unit").eqNullSafe(F.col("_unit")), "left_anti")
    return deltas.unionByName(cumulative_to_delta(alone))


def histogram_merge(histograms: DataFrame, metric: str, start: int, end: int, tags: dict[str, str] | None = None) -> DataFrame:
    """Delta histograms of the window added up by series, unit and bounds: tags, lkey, unit, buckets, counts, sum, count."""
    rows = _overlapping(histograms, metric, start, end, tags).where("histo_type = 'DELTA'")
    each = rows.select("lkey", "unit", "buckets", F.posexplode("counts").alias("i", "n"))
    counts = each.groupBy("lkey", "unit", "buckets", "i").agg(F.sum("n").alias("n"))
    arrays = counts.groupBy("lkey", "unit", "buckets").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("counts"))
    totals = rows.groupBy("lkey", "unit", "buckets").agg(F.first("tags").alias("tags"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return totals.join(arrays, ["lkey", "unit", "buckets"])


def rebin(merged: DataFrame, bounds: list[float]) -> DataFrame:
    """Histograms of different bounds on common ones: counts spread evenly inside each bucket, then added up by series and unit.

    The lowest bucket's counts stay at its bound, those of the highest just over theirs.
    """
    edges = [float("-inf"), *bounds, float("inf")]
    low, high = F.get("buckets", F.col("i") - 1), F.get("buckets", F.col("i"))
    each = merged.select("lkey", "unit", "tags", "sum", "count", "buckets", F.posexplode("counts").alias("i", "n")).withColumns({"low": F.coalesce(low, high), "high": F.coalesce(high, low)})

    def share(a: float, b: float) -> Column:
        inside = F.greatest(F.lit(0.0), F.least(F.lit(b), F.col("high")) - F.greatest(F.lit(a), F.col("low"))) / (F.col("high") - F.col("low"))
        point = F.when(F.col("i") == F.size("buckets"), (F.col("low") >= a) & (F.col("low") < b)).otherwise((F.col("low") > a) & (F.col("low") <= b)).cast("double")
        return F.sum(F.col("n") * F.when(F.col("high") == F.col("low"), point).otherwise(inside))

    counts = each.groupBy("lkey", "unit").agg(F.first("tags").alias("tags"), F.array(*(share(a, b) for a, b in zip(edges, edges[1:], strict=False))).alias("counts"))
    totals = merged.groupBy("lkey", "unit").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return counts.join(totals, ["lkey", "unit"]).withColumn("buckets", F.array(*map(F.lit, map(float, bounds))))


#: Cumulative counts at foreign bounds are kept in this fraction of one, as integers, so that they add up alike in any order.
_PART = 1 << 20


def merge_bounds(merged: DataFrame) -> DataFrame:
    """Histograms of different bounds put together by series and unit, on all the bounds that occur there.

    The counts up to a bound are those of each histogram, on a straight line between its own
    bounds; its lowest bucket counts from its bound on, its highest stays above all.  Counts are
    whole and add up to all that was counted; the order in which rows are merged doesn't matter.
    """
    key = ["lkey", "unit"]
    none = F.array().cast("array<double>")
    given = merged.withColumn("buckets", F.coalesce(F.col("buckets").cast("array<double>"), none))
    bounds = given.select(*key, F.explode("buckets").alias("b")).groupBy(*key).agg(F.array_sort(F.collect_set("b")).alias("_bounds"))
    same = lambda df: df.select(*(F.col(c).alias(f"_{c}") for c in key), *(c for c in df.columns if c not in key))
    on = lambda: F.col("lkey").eqNullSafe(F.col("_lkey")) & F.col("unit").eqNullSafe(F.col("_unit"))
    upto = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, n: a + n))
    each = given.join(same(bounds), on()).select(*key, "buckets", upto.alias("upto"), F.posexplode("_bounds").alias("j", "x"))
    each = each.withColumn("k", F.size(F.filter("buckets", lambda b: b < F.col("x"))))  # its bounds below x
    low, high, below, above = F.get("buckets", F.col("k") - 1), F.get("buckets", F.col("k")), F.get("upto", F.col("k") - 1), F.get("upto", F.col("k"))
    at = F.when(high.isNull(), below).when(high == F.col("x"), above).when(low.isNull(), 0).otherwise(below + (above - below) * (F.col("x") - low) / (high - low))
    part = F.floor(F.coalesce(at, F.lit(0)).cast("double") * _PART + 0.5).cast("long")
    cells = each.groupBy(*key, "j").agg(F.floor((F.sum(part) + _PART // 2) / _PART).cast("long").alias("n"), F.first("x").alias("x"))
    arrays = cells.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("j", "x", "n"))).alias("_cells"))
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    totals = given.groupBy(*key).agg(F.first("tags").alias("tags"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.sum(size).alias("_all"))
    reached = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cells", lambda c: c["n"]), F.array("_all"))
    out = totals.join(same(arrays), on(), "left").withColumn("_cells", F.coalesce("_cells", F.array().cast("array<struct<j:int,x:double,n:bigint>>")))
    steps = F.zip_with(F.slice(reached, 1, F.size("_cells") + 1), F.slice(reached, 2, F.size("_cells") + 1), lambda a, b: b - a)
    return out.select("tags", *key, F.transform("_cells", lambda c: c["x"]).alias("buckets"), steps.alias("counts"), "sum", "count")


def histogram_latest(histograms: DataFrame, metric: str, start: int, end: int, tags: dict[str, str] | None = None) -> DataFrame:
    """The cumulative histogram with the largest count, the first of equal ones, by series and unit."""
    rows = _overlapping(histograms, metric, start, end, tags).where("histo_type = 'CUMULATIVE'")
    best = rows.groupBy("lkey", "unit").agg(F.first("tags").alias("tags"), F.max_by(F.struct("ts_start_ms", "ts_end_ms", "buckets", "counts", "sum", "count"), F.struct("count", -F.col("ts_start_ms"))).alias("h"))
    return best.select("tags", "lkey", "unit", "h.*")


def exemplars(rows: DataFrame, metric: str, start_ns: int, end_ns: int, tags: dict[str, str] | None = None, limit: int = EXEMPLAR_LIMIT) -> DataFrame:
    """The first exemplars of the range, in order of time."""
    return rows.where((F.col("metric") == metric) & F.col("ts_ns").between(start_ns, end_ns) & has_tags(tags or {})).orderBy("ts_ns", *(c for c in ("lkey", "span_id") if c in rows.columns)).limit(limit)


# --- discovery ----------------------------------------------------------------------------


_STREAM = ["event_type", "metric", "lkey", "unit"]


def streams(df: DataFrame, kind: str, first: str, last: str) -> DataFrame:
    """A row for each stream of one kind: event_type, metric, tags, lkey, unit, ts_start_ms, ts_end_ms."""
    g = df.groupBy("metric", "lkey", "unit").agg(F.first("tags").alias("tags"), F.min(first).alias("ts_start_ms"), F.max(last).alias("ts_end_ms"))
    return g.select(F.lit(kind).alias("event_type"), "metric", "tags", "lkey", "unit", "ts_start_ms", "ts_end_ms")


def stream_index(gauges: DataFrame, sums: DataFrame, histograms: DataFrame) -> DataFrame:
    """The streams of samples of all kinds; ingest.stream_index() has those that were kept at ingest, without reading samples."""
    return streams(gauges, "GAUGE", "ts_ms", "ts_ms").unionByName(streams(sums, "SUM", "ts_start_ms", "ts_end_ms")).unionByName(streams(histograms, "HISTO", "ts_start_ms", "ts_end_ms"))


def merged_streams(rows: DataFrame) -> DataFrame:
    """One row for each stream, from rows of parts of its time; the same whatever the parts, and however often merged."""
    g = rows.groupBy(*_STREAM).agg(F.first("tags").alias("tags"), F.min("ts_start_ms").alias("ts_start_ms"), F.max("ts_end_ms").alias("ts_end_ms"))
    return g.select("event_type", "metric", "tags", "lkey", "unit", "ts_start_ms", "ts_end_ms")


def live(index: DataFrame, start: int, end: int) -> DataFrame:
    """Streams that overlap the window, both ends included."""
    return index.where((F.col("ts_start_ms") <= end) & (F.col("ts_end_ms") >= start))


def series(index: DataFrame, start: int, end: int, metric: str | None = None, *matchers) -> DataFrame:
    """Distinct series; the unit counts as the label __unit__ for matchers."""
    rows = live(index, start, end)
    rows = rows if metric is None else rows.where(F.col("metric") == metric)
    rows = rows.withColumn("labels", F.when(F.col("unit") != "", F.map_concat("tags", F.create_map(F.lit("__unit__"), F.col("unit")))).otherwise(F.col("tags")))
    for m in matchers:
        rows = rows.where(m.condition())
    return rows.groupBy("metric", label_key("labels").alias("lkey")).agg(F.first("labels").alias("labels"), F.first("event_type").alias("event_type"))


def kind_of(index: DataFrame) -> DataFrame:
    """metric, lkey, unit, event_type; an error for a series that has several kinds."""
    g = index.groupBy("metric", "lkey", "unit").agg(F.collect_set("event_type").alias("kinds"))
    text = F.concat(F.lit("conflicting metric types for "), F.col("metric"))
    return g.select("metric", "lkey", "unit", F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise(F.raise_error(text)).alias("event_type"))


def name_hints(index: DataFrame, start: int, end: int, prefix: str = "", event_type: str | None = None, limit: int = HINT_LIMIT) -> DataFrame:
    rows = live(index, start, end).where(F.col("metric").startswith(prefix))
    rows = rows if event_type is None else rows.where(F.col("event_type") == event_type)
    return rows.select("metric").distinct().orderBy("metric").limit(limit)


def tag_hints(index: DataFrame, start: int, end: int, metric: str, prefix: str = "", tags: dict[str, str] | None = None, limit: int = HINT_LIMIT) -> DataFrame:
    rows = live(index, start, end).where((F.col("metric") == metric) & has_tags(tags or {}))
    return rows.select(F.explode(F.map_keys("tags")).alias("tag")).where(F.col("tag").startswith(prefix)).distinct().orderBy("tag").limit(limit)


def tag_value_hints(index: DataFrame, start: int, end: int, metric: str, tag: str, prefix: str = "", tags: dict[str, str] | None = None, limit: int = HINT_LIMIT) -> DataFrame:
    rows = live(index, start, end).where((F.col("metric") == metric) & has_tags(tags or {}))
    value = attr_str("tags", tag)
    return rows.select(value.alias("value")).where((F.col("value") != "") & F.col("value").startswith(prefix)).distinct().orderBy("value").limit(limit)


def search(index: DataFrame, start: int, end: int, name: str | None = None, name_pattern: str | None = None, tags: dict[str, str] | None = None, tag_patterns: dict[str, str] | None = None, anywhere: str | None = None) -> DataFrame:
    """Streams by name, pattern of the whole name, tags, patterns of tags, or a pattern of the name or any tag value."""
    whole = lambda c, p: c.rlike(f"^(?:{p})$")
    rows = live(index, start, end).where(has_tags(tags or {}))
    if name is not None:
        rows = rows.where(F.col("metric") == name)
    if name_pattern is not None:
        rows = rows.where(whole(F.col("metric"), name_pattern))
    for k, p in (tag_patterns or {}).items():
        rows = rows.where(whole(attr_str("tags", k), p))
    if anywhere is not None:
        rows = rows.where(whole(F.col("metric"), anywhere) | F.exists(F.map_values("tags"), lambda v: whole(v, anywhere)))
    return rows.select("metric", "lkey").distinct()


def label_names(index: DataFrame, start: int, end: int) -> DataFrame:
    names = live(index, start, end).select(F.explode(F.map_keys("tags")).alias("label")).distinct()
    return names.unionByName(live(index, start, end).select(F.lit("__name__").alias("label")).distinct()).orderBy("label")


def label_values(index: DataFrame, start: int, end: int, name: str) -> DataFrame:
    value = F.col("metric") if name == "__name__" else attr_str("tags", name)
    return live(index, start, end).select(value.alias("value")).where("value <> ''").distinct().orderBy("value")


def metadata(index: DataFrame, start: int, end: int, limit: int = 1000) -> DataFrame:
    """metric, type as its clients name it, unit."""
    kind = F.when(F.col("event_type") == "GAUGE", "gauge").when(F.col("event_type") == "SUM", "counter").otherwise("histogram")
    return live(index, start, end).select("metric", kind.alias("type"), "unit").distinct().orderBy("metric", "type", "unit").limit(limit)


def overview(sources: dict[str, tuple[DataFrame, Column]], now_ms: int, ranges_ms: dict[str, int]) -> DataFrame:
    """Rows of each source in each half-open range that ends now: one pass over each source."""
    out = None
    for name, (df, ts) in sources.items():
        counts = df.agg(*(F.count(F.when((ts >= now_ms - w) & (ts < now_ms), 1)).alias(r) for r, w in ranges_ms.items()))
        one = counts.select(F.lit(name).alias("source"), *ranges_ms)
        out = one if out is None else out.unionByName(one)
    return out
