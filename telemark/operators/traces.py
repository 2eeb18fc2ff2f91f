"""Trace analytics: span search and statistics, rate-error-duration summaries, flame graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.model import attr_num, attr_str, has_attr
from telemark.operators import sketches as K
from telemark.operators.metrics import aggregate_column
from telemark.tables import Scratch

RESOLUTION_NS = {"SECONDLY": 10**9, "MINUTELY": 60 * 10**9, "HOURLY": 3600 * 10**9}
OPERATIONS = 20
_LEVELS = [0.5, 0.75, 0.9, 0.99]


def matching(start_ns: int | None = None, end_ns: int | None = None, min_duration_ns: int | None = None, max_duration_ns: int | None = None, attributes: dict[str, str] | None = None, numbers: dict[str, float] | None = None, **columns: str | int) -> Column:
    """Spans inside a window, of a duration, with column values and attributes; `*` stands for anything in a text."""

    def same(c: Column, v: str | int | float) -> Column:
        if not isinstance(v, str):
            return c == v
        return c.like(v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")) if "*" in v else c == v

    out = F.lit(True)
    duration = F.col("ts_end_ns") - F.col("ts_start_ns")
    for bound, c in ((start_ns, lambda b: F.col("ts_start_ns") >= b), (end_ns, lambda b: F.col("ts_end_ns") <= b), (min_duration_ns, lambda b: duration >= b), (max_duration_ns, lambda b: duration <= b)):
        out = out if bound is None else out & c(bound)
    for k, v in columns.items():
        out = out & same(F.col(k), v)
    for k, v in (attributes or {}).items():
        out = out & same(attr_str("attrs_str", k), v)
    for k, v in (numbers or {}).items():
        out = out & has_attr("attrs_num", k) & (attr_num("attrs_num", k) == v)
    return out


def search(spans: DataFrame, condition: Column, limit: int = 1000) -> DataFrame:
    return spans.where(condition).orderBy(F.desc("ts_start_ns"), "trace_id", "span_id").limit(limit)


def count(spans: DataFrame, condition: Column) -> DataFrame:
    return spans.where(condition).agg(F.count(F.lit(1)).alias("spans"))


def checked_aggregation(spans: DataFrame, attributes: list[str], aggregation: str, resolution: str | None = None) -> None:
    """An error for an aggregation of attributes that aren't numbers, or without a resolution; a count takes any.

    The types are looked up in the catalog of the given attributes' names, one row for each.
    """
    if aggregation == "COUNT":
        return
    if resolution is None:
        raise ValueError("a resolution is required for numerical aggregations")
    asked = [a for a in attributes if a != "duration"]
    known = {r["attribute_name"]: r["attribute_type"] for r in attribute_catalog(spans).where(F.col("attribute_name").isin(*asked)).collect()} if asked else {}
    for a in asked:
        if known.get(a) != "number":
            raise ValueError(f"numerical aggregation is not supported for the non-numerical attribute {a!r}")


def numeric_series(spans: DataFrame, attributes: list[str], aggregation: str, resolution: str, condition: Column | None = None) -> DataFrame:
    """attribute, bucket_ns, value: an aggregate over the spans that have the attribute; `duration` is one of all spans."""
    width = RESOLUTION_NS[resolution]
    value = lambda a: F.when(F.lit(a == "duration"), (F.col("ts_end_ns") - F.col("ts_start_ns")).cast("double")).otherwise(F.try_element_at("attrs_num", F.lit(a)))
    rows = spans if condition is None else spans.where(condition)
    each = rows.select((F.col("ts_start_ns") - F.col("ts_start_ns") % width).alias("bucket_ns"), F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), value(a).alias("v")) for a in attributes))).alias("x"))
    return each.where("x.v is not null").groupBy("x.attribute", "bucket_ns").agg(aggregate_column(aggregation, F.col("x.v")).cast("double").alias("value"))


def distribution(spans: DataFrame, attributes: list[str], condition: Column | None = None, limit: int = 100) -> DataFrame:
    """attribute, value, spans: the most frequent values of each text attribute, in one pass."""
    rows = spans if condition is None else spans.where(condition)
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), (F.col(a) if a in spans.columns else attr_str("attrs_str", a)).cast("string").alias("value")) for a in attributes))
    counts = rows.select(F.explode(pairs).alias("x")).where("x.value <> ''").groupBy("x.attribute", "x.value").agg(F.count(F.lit(1)).alias("spans"))
    order = Window.partitionBy("attribute").orderBy(F.desc("spans"), "value")
    return counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def attribute_kinds(spans: DataFrame) -> DataFrame:
    """attribute_name, kind (string or number): each that occurs, in one pass."""
    named = lambda c, kind: F.transform(F.map_keys(c), lambda k: F.struct(k.alias("attribute_name"), F.lit(kind).alias("kind")))
    both = F.concat(*(F.coalesce(named(c, kind), F.array().cast("array<struct<attribute_name:string,kind:string>>")) for c, kind in (("attrs_str", "string"), ("attrs_num", "number"))))
    return spans.select(F.explode(both).alias("x")).select("x.*").distinct()


def catalog_of(kinds: DataFrame) -> DataFrame:
    """attribute_name, attribute_type of the kinds that were seen: string, number, or mixed where both were."""
    g = kinds.groupBy("attribute_name").agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    return g.select("attribute_name", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("attribute_type"))


def attribute_catalog(spans: DataFrame) -> DataFrame:
    """The catalog of a table of spans; ingest.attribute_catalog() has the one kept at ingest."""
    return catalog_of(attribute_kinds(spans))


def red_events(spans: DataFrame) -> DataFrame:
    """What red(), red_totals(), red_operations() and services() need of a span, and nothing else."""
    return spans.select("ts_start_ns", "ts_end_ns", "service_name", "service_peer_name", "span_name", "kind", "span_status")


def attribute_hints(spans: DataFrame, defaults: list[str], limit: int = 100) -> DataFrame:
    first = spans.sparkSession.createDataFrame([(d,) for d in defaults], "attribute_name string")
    return first.unionByName(attribute_catalog(spans).select("attribute_name")).distinct().orderBy("attribute_name").limit(limit)


def number_summary(spans: DataFrame, attribute: str) -> DataFrame:
    """avg, p25, p50, p75, p90 of a numeric attribute."""
    v = F.try_element_at("attrs_num", F.lit(attribute))
    p = F.percentile(v, [0.25, 0.5, 0.75, 0.9])
    g = spans.agg(F.avg(v).alias("avg"), p.alias("p"))
    return g.select("avg", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))))


def value_hints(spans: DataFrame, attribute: str, limit: int = 100) -> DataFrame:
    return spans.select(attr_str("attrs_str", attribute).alias("value")).where("value <> ''").distinct().orderBy("value").limit(limit)


# --- rate, errors, duration ---------------------------------------------------------------


def _inside(start_ns: int, end_ns: int) -> Column:
    """Spans that begin and end within [start, end]."""
    return (F.col("ts_start_ns") >= start_ns) & (F.col("ts_end_ns") <= end_ns)


def red(spans: DataFrame, keys: list[str], start_ns: int, end_ns: int, resolution: str) -> DataFrame:
    """By keys and time bucket, of the spans within [start, end]: count, errors, percentiles of the durations of OK spans, rates.

    A span without a status counts, but is neither an error nor part of the percentiles.
    """
    width = RESOLUTION_NS[resolution]
    rows = spans.where(_inside(start_ns, end_ns))
    duration = F.col("ts_end_ns") - F.col("ts_start_ns")
    timed = F.when((F.col("span_status") == "OK") & (duration > 0), duration)
    g = rows.groupBy(*keys, (F.col("ts_start_ns") - F.col("ts_start_ns") % width).alias("bucket_ns")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("span_status") == "ERROR").alias("errors"), F.percentile(timed, _LEVELS).alias("p"))
    percentiles = {f"p{round(q * 100)}": F.get("p", F.lit(i)) for i, q in enumerate(_LEVELS)}
    return g.withColumns({**percentiles, **_rates(width)}).drop("p")


def _rates(width: int) -> dict[str, Column]:
    seconds = width / 10**9
    return {"rps": F.col("count") / seconds, "rpm": F.col("count") / seconds * 60, "error_rate": F.col("errors") / F.col("count")}


def red_sketches(spans: DataFrame, keys: list[str], resolution: str = "MINUTELY", k: int = K.SIZE) -> DataFrame:
    """keys, ts_start_ns (of the bucket), count, errors, sketch of the durations of OK spans: what red_merged() reads."""
    width = RESOLUTION_NS[resolution]
    duration = F.col("ts_end_ns") - F.col("ts_start_ns")
    timed = F.when((F.col("span_status") == "OK") & (duration > 0), duration)
    g = spans.groupBy(*keys, (F.col("ts_start_ns") - F.col("ts_start_ns") % width).alias("ts_start_ns"))
    return g.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("span_status") == "ERROR").alias("errors"), K.sketch(timed, k).alias("sketch"))


def red_merged(kept: DataFrame, keys: list[str], start_ns: int, end_ns: int, resolution: str, k: int = K.SIZE) -> DataFrame:
    """red() from sketches of finer buckets that begin in [start, end): the same columns, percentiles within K.error(k) in rank.

    Kept rows of one bucket may come from many batches; spans that end after `end` count in the bucket where they begin.
    """
    width = RESOLUTION_NS[resolution]
    rows = kept.where((F.col("ts_start_ns") >= start_ns) & (F.col("ts_start_ns") < end_ns))
    g = rows.groupBy(*keys, (F.col("ts_start_ns") - F.col("ts_start_ns") % width).alias("bucket_ns"))
    g = g.agg(F.sum("count").alias("count"), F.sum("errors").alias("errors"), K.merged(F.col("sketch"), k).alias("sketch"))
    percentiles = {f"p{round(q * 100)}": K.quantile(F.col("sketch"), q) for q in _LEVELS}
    return g.withColumns({**percentiles, **_rates(width)}).drop("sketch")


def red_totals(spans: DataFrame, keys: list[str], start_ns: int, end_ns: int) -> DataFrame:
    """By keys: count, errors, availability (null without spans)."""
    rows = spans.where(_inside(start_ns, end_ns))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("span_status") == "ERROR").alias("errors"))
    return g.withColumn("availability", F.when(F.col("count") > 0, 1 - F.col("errors") / F.col("count")))


def red_operations(spans: DataFrame, service: str, start_ns: int, end_ns: int, resolution: str, most: int = OPERATIONS) -> DataFrame:
    """The first operations by name of a service, each with its own buckets."""
    own = spans.where(F.col("service_name") == service)
    names = own.where(_inside(start_ns, end_ns)).select("span_name").distinct().orderBy("span_name").limit(most)
    return red(own.join(F.broadcast(names), "span_name", "left_semi"), ["span_name"], start_ns, end_ns, resolution)


def operation_count(spans: DataFrame, service: str, start_ns: int, end_ns: int) -> DataFrame:
    return spans.where((F.col("service_name") == service) & _inside(start_ns, end_ns) & (F.col("span_name") != "")).agg(F.countDistinct("span_name").alias("operations"))


def services(spans: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return spans.where(_inside(start_ns, end_ns)).select("service_name").distinct().orderBy("service_name")


def _located(spans: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(spans with _parent, null for roots; trace_id, span_id, depth of those that a root reaches)."""
    last = F.max_by(F.struct("parent_span_id", "ts_start_ns", "ts_end_ns"), F.struct("ts_start_ns", "ts_end_ns", "parent_span_id"))
    rows = spans.groupBy("trace_id", "span_id").agg(last.alias("s")).select("trace_id", "span_id", "s.*")
    ids = rows.select(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_parent"))
    known = rows.join(ids, (F.col("trace_id") == F.col("_trace")) & (F.col("parent_span_id") == F.col("_parent")), "left").drop("_trace")
    known = scratch.write(known, "known")
    # the path to the root is found for all spans at once: each round doubles the length of the jump;
    # a span whose jump has reached its root is settled and leaves the rounds, but is looked at by the others
    settled = known.where("_parent IS NULL").select("trace_id", "span_id", F.lit(0).cast("long").alias("depth"))
    going = known.where("_parent IS NOT NULL").select("trace_id", "span_id", F.col("_parent").alias("up"), F.lit(1).cast("long").alias("jump"))
    k, most = 0, None
    while not going.isEmpty():
        most = most or known.groupBy("trace_id").count().agg(F.max("count")).first()[0]
        if 2**k >= most:  # longer than any path to a root: what is left runs in a cycle or hangs below one
            break
        on = settled.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.lit(None).cast("string").alias("_up"), F.col("depth").alias("_d"))
        on = on.unionByName(going.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("up").alias("_up"), F.col("jump").alias("_d")))
        longer = going.join(on, (F.col("trace_id") == F.col("_t")) & (F.col("up") == F.col("_s"))).select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("jump") + F.col("_d")).alias("jump"))
        k += 1
        longer = scratch.write(longer, f"longer-{k}")
        settled = settled.unionByName(longer.where("up IS NULL").select("trace_id", "span_id", F.col("jump").alias("depth")))
        going = longer.where("up IS NOT NULL")
    return known, settled


def _with_places(spans: pa.Table) -> pa.Table:
    """Adds depth, begin and place to whole traces in order of trace_id and span_id; depth is null where no root is reached."""
    n = spans.num_rows
    own, parent, name = (spans[c].combine_chunks() for c in ("span_id", "parent_span_id", "trace_id"))
    new = np.ones(n, bool)
    new[1:] = pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)
    trace, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
    codes = pc.fill_null(pc.dictionary_encode(pa.concat_arrays([own, parent])).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    nameless, no_parent = codes[:n] < 0, codes[n:] < 0
    key, wanted = trace * (2 * n) + codes[:n], trace * (2 * n) + codes[n:]
    key[nameless], wanted[no_parent] = -1, -2
    order = np.argsort(key, kind="stable")
    found = order[np.minimum(np.searchsorted(key[order], wanted), n - 1)]
    up = np.where(key[found] == wanted, found, -1)
    # the length of the jump doubles: after a trace's size every span that has a root is there
    at, depth = np.where(up < 0, np.arange(n), up), (up >= 0).astype(np.int64)
    for _ in range(int(np.diff(np.append(firsts, n)).max()).bit_length()):
        if (up[at] < 0).all():
            break
        depth, at = depth + depth[at], at[at]
    starts = spans["ts_start_ns"].combine_chunks()
    begin = np.minimum.reduceat(pc.fill_null(starts, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), firsts)[trace]
    family = np.where(nameless, -2, up)
    order = np.lexsort((pc.fill_null(starts, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), family, trace))  # stable: of one start by span_id
    begins = np.ones(n, bool)
    begins[1:] = (np.diff(family[order]) != 0) | (np.diff(trace[order]) != 0)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0)) + 1
    more = {"depth": pa.array(depth.astype(np.int32), mask=(up[at] >= 0) | nameless), "begin": pa.array(begin), "place": pa.array(place.astype(np.int32))}
    for c, values in more.items():
        spans = spans.append_column(c, values)
    return spans


def _trace_by_trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_with_places() of batches that a trace may run across: the last trace of one waits for the next."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if rows.num_rows == 0:
            continue
        same = pc.equal(rows["trace_id"], rows["trace_id"][-1])
        whole = pc.index(same, True).as_py()
        held = rows.slice(whole)
        if whole:
            yield from _with_places(rows.slice(0, whole)).combine_chunks().to_batches()
    if held is not None:
        yield from _with_places(held).combine_chunks().to_batches()


def _by_trace(spans: DataFrame) -> DataFrame:
    """Spans with depth, begin and place, each trace in one task: one shuffle, whatever the depth."""
    dealt = spans.select("trace_id", "span_id", "parent_span_id", "ts_start_ns", "ts_end_ns").where("trace_id IS NOT NULL").repartition("trace_id")
    last = F.max(F.struct("ts_start_ns", "ts_end_ns", "parent_span_id"))
    rows = dealt.groupBy("trace_id", "span_id").agg(last.alias("s")).select("trace_id", "span_id", "s.parent_span_id", "s.ts_start_ns", "s.ts_end_ns")
    schema = "trace_id string, span_id string, parent_span_id string, ts_start_ns long, ts_end_ns long, depth int, begin long, place int"
    return rows.sortWithinPartitions("trace_id", "span_id").mapInArrow(_trace_by_trace, schema)


def _across_tasks(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by joins that deal a trace to all tasks."""
    known, depths = _located(spans, scratch)
    begins = known.groupBy("trace_id").agg(F.min("ts_start_ns").alias("begin"))
    siblings = Window.partitionBy("trace_id", "_parent", F.col("span_id").isNull()).orderBy("ts_start_ns", "span_id")
    placed = known.join(depths, ["trace_id", "span_id"], "left").join(begins, "trace_id").withColumn("place", F.row_number().over(siblings))
    return placed.select("trace_id", "span_id", "parent_span_id", "ts_start_ns", "ts_end_ns", F.col("depth").cast("int").alias("depth"), "begin", "place")


def flame_graph(spans: DataFrame, trace_id: str | None = None, most_spans: int = 100_000) -> DataFrame:
    """trace_id, span_id, parent_span_id, depth, offset_ns, duration_ns, place among its siblings.

    A span whose parent is missing is a root; of spans with one id the last one counts.
    Spans that no root reaches, as their parents form a cycle, aren't in any graph: they are
    left out of a table's graphs (unreached() has them), and an error of the one trace asked for.
    Traces of more than `most_spans` rows are not brought to one task, but dealt to all.
    """
    scratch = Scratch(spans.sparkSession, "flames")
    rows = spans if trace_id is None else spans.where(F.col("trace_id") == trace_id)
    large = scratch.write(rows.groupBy("trace_id").count().where(F.col("count") > most_spans).select("trace_id"), "large")
    if large.isEmpty():
        placed = _by_trace(rows)
    else:
        placed = _by_trace(rows.join(large, "trace_id", "left_anti")).unionByName(_across_tasks(rows.join(large, "trace_id", "left_semi"), scratch))
    if trace_id is not None and not placed.where("depth IS NULL AND span_id IS NOT NULL").isEmpty():
        raise ValueError("the parents of some spans form a cycle")
    found = placed.where("depth IS NOT NULL")
    return found.select("trace_id", "span_id", "parent_span_id", "depth", (F.col("ts_start_ns") - F.col("begin")).alias("offset_ns"), F.greatest(F.lit(0).cast("long"), F.col("ts_end_ns") - F.col("ts_start_ns")).alias("duration_ns"), "place")


def unreached(spans: DataFrame) -> DataFrame:
    """trace_id, spans: how many of a trace's spans no root reaches."""
    known, depths = _located(spans, Scratch(spans.sparkSession, "flames"))
    return known.join(depths, ["trace_id", "span_id"], "left_anti").groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))
