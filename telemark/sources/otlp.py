"""OTLP payloads (JSON, one export request a line) to typed rows, by nested explodes and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.model import label_key

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINT = f"attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string"
_EXEMPLARS = f"exemplars:array<struct<timeUnixNano:string,spanId:string,traceId:string,asDouble:double,asInt:string,filteredAttributes:{_ATTRS}>>"
_NUMBER = f"array<struct<{_POINT},asDouble:double,asInt:string,{_EXEMPLARS}>>"
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
_METRIC = (
    f"struct<name:string,unit:string,gauge:struct<dataPoints:{_NUMBER}>,sum:struct<dataPoints:{_NUMBER},aggregationTemporality:int,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<struct<{_POINT},count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,{_EXEMPLARS}>>,aggregationTemporality:int>,"
    f"exponentialHistogram:struct<dataPoints:array<struct<{_POINT},count:string,sum:double,scale:int,zeroCount:string,zeroThreshold:double,positive:{_BUCKETS},negative:{_BUCKETS},{_EXEMPLARS}>>,aggregationTemporality:int>>"
)
METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>>"
LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},attributes:{_ATTRS},traceId:string,spanId:string>>>>>>>"
SPANS = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:int>>>>>>>>"

#: Column of a span and the attributes that it is read from, the first that is there.  Fixed values: names of the semantic conventions.
FALLBACKS = {
    "service_peer_name": ("service.peer.name", "peer.service"),
    "http_method": ("http.request.method", "http.method"),
    "http_status_code": ("http.response.status_code", "http.status_code"),
    "http_request_size": ("http.request.body.size", "http.request_content_length"),
    "http_response_size": ("http.response.body.size", "http.response_content_length"),
    "http_origin": ("http.request.header.origin", "http.origin"),
    "http_host": ("http.request.header.host", "http.host"),
    "server_address": ("server.address",),
    "server_port": ("server.port",),
    "client_address": ("client.address",),
    "client_port": ("client.port",),
    "source_address": ("source.address",),
    "source_port": ("source.port",),
    "network_protocol_type": ("network.protocol.name", "network.type"),
    "network_protocol_version": ("network.protocol.version",),
    "db_system": ("db.system.name", "db.system"),
    "db_collection_name": ("db.collection.name",),
    "db_namespace": ("db.namespace", "db.name"),
    "db_operation_name": ("db.operation", "db.operation.name"),
    "db_response_status_code": ("db.response.status_code",),
    "db_query_text": ("db.query.text", "db.statement"),
    "db_query_summary": ("db.query.summary",),
    "db_stored_procedure_name": ("db.stored_procedure.name",),
    "db_response_returned_rows": ("db.response.returned_rows",),
    "rpc_method": ("rpc.method",),
    "rpc_method_original": ("rpc.method.original", "rpc.method"),
    "rpc_response_status_code": ("rpc.response.status_code",),
}
#: Those that are numbers, null where a span has none; the others are texts, empty there.
NUMBERS = frozenset(c for c in FALLBACKS if c.endswith(("_status_code", "_size", "_port", "_rows")))
_KINDS = ("UNK", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "payload")


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """`x` of each payload; payloads that can't be read are left out."""
    return payloads.select(F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("x")).where("x is not null")


def strings(attributes: Column) -> Column:
    """The attributes that are texts, as a map; of repeated keys the last."""
    return _map(attributes, lambda v: v["stringValue"], "string")


def numbers(attributes: Column) -> Column:
    return _map(attributes, lambda v: F.coalesce(v["doubleValue"], v["intValue"].try_cast("double")), "double")


def _map(attributes: Column, value, kind: str) -> Column:
    kept = F.filter(F.coalesce(attributes, F.array().cast(_ATTRS)), lambda a: value(a["value"]).isNotNull() & a["key"].isNotNull())
    last = F.filter(kept, lambda a, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"].alias("key"), value(a["value"]).cast(kind).alias("value"))))


def tags(resource: Column, point: Column) -> Column:
    """All attributes of a point and its resource as text, the point's own first."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    own, outer = _map(point, text, "string"), _map(resource, text, "string")
    return F.map_concat(own, F.map_filter(outer, lambda k, _: ~F.map_contains_key(own, k)))


def _ms(nanos: Column) -> Column:
    return F.floor(nanos.try_cast("long") / 1_000_000).cast("long")


def _metrics(payloads: DataFrame, prometheus: bool) -> DataFrame:
    rows = parsed(payloads, METRICS).select(F.explode("x.resourceMetrics").alias("r"))
    rows = rows.select("r.resource.attributes", F.explode("r.scopeMetrics").alias("s")).select("attributes", F.explode("s.metrics").alias("m"))
    name = F.regexp_replace("m.name", "\\.", "_") if prometheus else F.col("m.name")
    return rows.select(name.alias("metric"), F.coalesce("m.unit", F.lit("")).alias("unit"), F.col("attributes").alias("resource"), "m")


def _tagged(points: DataFrame, prometheus: bool) -> DataFrame:
    """Dots in names become underscores in the Prometheus dialect."""
    t = tags(F.col("resource"), F.col("p.attributes"))
    t = F.transform_keys(t, lambda k, _: F.regexp_replace(k, "\\.", "_")) if prometheus else t
    return points.withColumn("tags", t).withColumn("lkey", label_key("tags"))


def _temporality(code: Column) -> Column:
    return F.when(code == 2, "CUMULATIVE").otherwise("DELTA")


def gauges(payloads: DataFrame, prometheus: bool = False) -> DataFrame:
    points = _metrics(payloads, prometheus).select("metric", "unit", "resource", F.explode("m.gauge.dataPoints").alias("p"))
    value = F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"))
    return _tagged(points, prometheus).select("metric", "tags", "lkey", _ms(F.col("p.timeUnixNano")).alias("ts_ms"), value.alias("value"), "unit").where("ts_ms is not null and value is not null")


def sums(payloads: DataFrame, prometheus: bool = False) -> DataFrame:
    points = _metrics(payloads, prometheus).select("metric", "unit", "resource", _temporality(F.col("m.sum.aggregationTemporality")).alias("sums_type"), F.explode("m.sum.dataPoints").alias("p"))
    value = F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"))
    return _tagged(points, prometheus).select("metric", "tags", "lkey", _ms(F.col("p.startTimeUnixNano")).alias("ts_start_ms"), _ms(F.col("p.timeUnixNano")).alias("ts_end_ms"), value.alias("value"), "sums_type", "unit").where("value is not null")


def _longs(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.try_cast("long"))


def histograms(payloads: DataFrame, prometheus: bool = False) -> DataFrame:
    points = _metrics(payloads, prometheus).select("metric", "unit", "resource", _temporality(F.col("m.histogram.aggregationTemporality")).alias("histo_type"), F.explode("m.histogram.dataPoints").alias("p"))
    return _tagged(points, prometheus).select(
        "metric", "tags", "lkey", _ms(F.col("p.startTimeUnixNano")).alias("ts_start_ms"), _ms(F.col("p.timeUnixNano")).alias("ts_end_ms"), F.col("p.explicitBounds").alias("buckets"), _longs(F.col("p.bucketCounts")).alias("counts"),
        F.col("p.sum").alias("sum"), F.col("p.count").try_cast("long").alias("count"), "unit", "histo_type",
    )


def exponential_histograms(payloads: DataFrame, prometheus: bool = False) -> DataFrame:
    points = _metrics(payloads, prometheus).select("metric", "unit", "resource", _temporality(F.col("m.exponentialHistogram.aggregationTemporality")).alias("histo_type"), F.explode("m.exponentialHistogram.dataPoints").alias("p"))
    return _tagged(points, prometheus).select(
        "metric", "tags", "lkey", _ms(F.col("p.startTimeUnixNano")).alias("ts_start_ms"), _ms(F.col("p.timeUnixNano")).alias("ts_end_ms"), F.col("p.scale").alias("scale"), F.coalesce("p.zeroThreshold", F.lit(0.0)).alias("zero_threshold"),
        F.coalesce(F.col("p.zeroCount").try_cast("long"), F.lit(0)).alias("zero_count"), F.coalesce("p.positive.offset", F.lit(0)).alias("positive_offset"), _longs(F.col("p.positive.bucketCounts")).alias("positive_counts"),
        F.coalesce("p.negative.offset", F.lit(0)).alias("negative_offset"), _longs(F.col("p.negative.bucketCounts")).alias("negative_counts"), F.col("p.sum").alias("sum"), F.col("p.count").try_cast("long").alias("count"), "unit", "histo_type",
    )


def exemplars(payloads: DataFrame, prometheus: bool = False) -> DataFrame:
    m = _metrics(payloads, prometheus)
    none = F.array().cast(f"array<struct<attributes:{_ATTRS},{_EXEMPLARS}>>")
    of = lambda kind: F.coalesce(F.transform(F.col(f"m.{kind}.dataPoints"), lambda p: F.struct(p["attributes"].alias("attributes"), p["exemplars"].alias("exemplars"))), none)
    points = m.select("metric", "unit", "resource", F.explode(F.concat(*(of(k) for k in ("gauge", "sum", "histogram", "exponentialHistogram")))).alias("p"))
    rows = _tagged(points, prometheus).select("metric", "tags", "lkey", F.explode("p.exemplars").alias("e"))
    return rows.select("metric", "tags", "lkey", F.col("e.timeUnixNano").try_cast("long").alias("ts_ns"), F.col("e.spanId").alias("span_id"), F.col("e.traceId").alias("trace_id"), F.col("e.asDouble").alias("double_value"), F.col("e.asInt").try_cast("long").alias("int_value"), F.to_json("e.filteredAttributes").alias("attributes_json"))


def logs(payloads: DataFrame) -> DataFrame:
    """Records of resources that name their service; the stream is the record's, the resource's, or the service."""
    rows = parsed(payloads, LOGS).select(F.explode("x.resourceLogs").alias("r")).select("r.resource.attributes", F.explode("r.scopeLogs").alias("s")).select("attributes", F.explode("s.logRecords").alias("l"))
    record, resource = strings(F.col("l.attributes")), strings(F.col("attributes"))
    at = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    service = at(resource, "service.name")
    stream = F.coalesce(at(record, "log.stream"), at(resource, "log.stream"), service)
    time = F.coalesce(F.nullif(F.col("l.timeUnixNano").try_cast("long"), F.lit(0).cast("long")), F.col("l.observedTimeUnixNano").try_cast("long"))
    out = rows.select(
        time.alias("ts_ns"), service.alias("service_name"), stream.alias("log_stream"), F.coalesce("l.severityNumber", F.lit(0)).alias("log_level"), F.coalesce("l.severityText", F.lit("")).alias("severity_text"), F.coalesce("l.traceId", F.lit("")).alias("trace_id"), F.coalesce("l.spanId", F.lit("")).alias("span_id"),
        F.coalesce("l.body.stringValue", F.lit("")).alias("body"), record.alias("attrs_str"), numbers(F.col("l.attributes")).alias("attrs_num"), resource.alias("res_str"), numbers(F.col("attributes")).alias("res_num"),
    )
    return out.where("service_name is not null")


def spans(payloads: DataFrame, keep: Column | None = None) -> DataFrame:
    """`keep` is a condition on the finished rows: what it rejects is never stored."""
    rows = parsed(payloads, SPANS).select(F.explode("x.resourceSpans").alias("r")).select("r.resource.attributes", F.explode("r.scopeSpans").alias("s")).select("attributes", F.explode("s.spans").alias("p"))
    # maps first, as columns of their own: each is made once, not once for every column that is read from it
    rows = rows.select("p", strings(F.col("p.attributes")).alias("_s"), numbers(F.col("p.attributes")).alias("_n"), strings(F.col("attributes")).alias("_r"))
    s, n, resource = F.col("_s"), F.col("_n"), F.col("_r")
    first_text = lambda c: F.coalesce(*(F.try_element_at(s, F.lit(k)) for k in FALLBACKS[c]), F.lit(""))
    first_number = lambda c: F.coalesce(*(F.try_element_at(n, F.lit(k)) for k in FALLBACKS[c]))
    promoted = [k for ks in FALLBACKS.values() for k in ks]
    rest = lambda m: F.map_filter(m, lambda k, _: ~k.isin(*promoted))
    status = F.when(F.col("p.status.code") == 1, "OK").when(F.col("p.status.code") == 2, "ERROR").otherwise("UNK")
    kind = F.coalesce(F.get(F.array(*map(F.lit, _KINDS)), F.col("p.kind")), F.lit("UNK"))
    out = rows.select(
        F.col("p.startTimeUnixNano").try_cast("long").alias("ts_start_ns"), F.col("p.endTimeUnixNano").try_cast("long").alias("ts_end_ns"), F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.coalesce("p.parentSpanId", F.lit("")).alias("parent_span_id"),
        status.alias("span_status"), kind.alias("kind"), F.coalesce(F.try_element_at(resource, F.lit("service.name")), F.lit("")).alias("service_name"), F.col("p.name").alias("span_name"),
        *((first_number(c).cast("int") if c in NUMBERS else first_text(c)).alias(c) for c in FALLBACKS), rest(s).alias("attrs_str"), rest(n).alias("attrs_num"),
    )
    return out if keep is None else out.where(keep)


def response(result: DataFrame) -> DataFrame:
    """A vector by series as JSON: the metric's labels and its points [seconds, text]."""
    named = F.when(F.col("metric").isNotNull(), F.map_concat("labels", F.create_map(F.lit("__name__"), F.col("metric")))).otherwise(F.col("labels"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda p: F.array((p["t"] / 1000).cast("string"), p["value"].cast("string")))
    g = result.groupBy("metric", "lkey").agg(F.first("labels").alias("labels"), points.alias("values"))
    return g.select(F.to_json(F.struct(named.alias("metric"), "values")).alias("json"))
