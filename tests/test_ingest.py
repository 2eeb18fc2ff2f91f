"""OTLP payloads to tables, in batch and as a stream."""

import json

from pyspark.sql import functions as F

from telemark.operators import filters as Q
from telemark.operators import metrics as M
from telemark.operators import traces as T
from telemark.sources import otlp
from telemark.streaming import ingest


def attrs(**kv):
    return [{"key": k.replace("__", "."), "value": {"stringValue": v} if isinstance(v, str) else {"intValue": str(v)} if isinstance(v, int) else {"doubleValue": v}} for k, v in kv.items()]


def metrics():
    point = {"attributes": attrs(host__name="h1"), "startTimeUnixNano": "1000000000", "timeUnixNano": "2000000000"}
    found = [
        {"name": "cpu.load", "unit": "1", "gauge": {"dataPoints": [{**point, "asDouble": 0.5, "exemplars": [{"timeUnixNano": "5", "spanId": "s", "traceId": "t", "asDouble": 1.5}]}]}},
        {"name": "requests", "sum": {"aggregationTemporality": 2, "dataPoints": [{**point, "asInt": "7"}]}},
        {"name": "latency", "histogram": {"dataPoints": [{**point, "count": "3", "sum": 6.0, "bucketCounts": ["1", "2"], "explicitBounds": [10.0]}]}},
        {"name": "sizes", "exponentialHistogram": {"dataPoints": [{**point, "count": "3", "scale": 1, "positive": {"offset": 2, "bucketCounts": ["1", "2"]}}]}},
    ]
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": attrs(service__name="shop")}, "scopeMetrics": [{"metrics": found}]}]})


def spans(n=2, code=2):
    rows = [{"traceId": "t", "spanId": f"s{i}", "parentSpanId": "" if i == 0 else f"s{i - 1}", "name": "op", "kind": 2, "startTimeUnixNano": str(10**18 + i), "endTimeUnixNano": str(10**18 + 100), "attributes": attrs(http__method="GET", http__status_code=404, other="x"), "status": {"code": code}} for i in range(n)]
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attrs(service__name="shop")}, "scopeSpans": [{"spans": rows}]}]})


def logs():
    record = {"timeUnixNano": "0", "observedTimeUnixNano": "9", "severityNumber": 17, "body": {"stringValue": "a \"b\" \\"}, "attributes": attrs(log__stream="own", n=3)}
    plain = {"timeUnixNano": "8", "body": {"stringValue": "x"}}
    return json.dumps({"resourceLogs": [{"resource": {"attributes": attrs(service__name="shop")}, "scopeLogs": [{"logRecords": [record, plain]}]}, {"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [plain]}]}]})


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_metrics(spark):
    p = payloads(spark, metrics(), "not json", "{}")
    g = otlp.gauges(p).first()
    assert (g["metric"], g["tags"], g["ts_ms"], g["value"]) == ("cpu.load", {"host.name": "h1", "service.name": "shop"}, 2000, 0.5)
    g = otlp.gauges(p, prometheus=True).first()
    assert (g["metric"], sorted(g["tags"])) == ("cpu_load", ["host_name", "service_name"])
    s = otlp.sums(p).first()
    assert (s["value"], s["sums_type"], s["ts_start_ms"]) == (7.0, "CUMULATIVE", 1000)
    h = otlp.histograms(p).first()
    assert (h["counts"], h["buckets"], h["histo_type"]) == ([1, 2], [10.0], "DELTA")
    e = otlp.exponential_histograms(p, prometheus=True).first()
    assert (e["scale"], e["positive_offset"], e["positive_counts"], e["negative_counts"]) == (1, 2, [1, 2], [])
    assert otlp.exemplars(p).first()["double_value"] == 1.5


def test_spans_and_logs(spark):
    s = otlp.spans(payloads(spark, spans())).orderBy("span_id").first()
    assert (s["http_method"], s["http_status_code"], s["attrs_str"], s["span_status"], s["kind"], s["service_name"]) == ("GET", 404, {"other": "x"}, "ERROR", "SERVER", "shop")
    assert otlp.spans(payloads(spark, spans()), keep=F.col("span_id") == "s1").count() == 1
    rows = {r["ts_ns"]: r for r in otlp.logs(payloads(spark, logs())).collect()}
    assert sorted(rows) == [8, 9]
    assert (rows[9]["log_stream"], rows[9]["body"], rows[9]["attrs_num"], rows[8]["log_stream"]) == ("own", 'a "b" \\', {"n": 3.0}, "shop")


def test_flame_graph(spark):
    rows = T.flame_graph(otlp.spans(payloads(spark, spans(6)))).orderBy("span_id").collect()
    assert [(r["depth"], r["offset_ns"], r["place"]) for r in rows] == [(i, i, 1) for i in range(6)]
    orphan = otlp.spans(payloads(spark, spans(3))).where("span_id <> 's1'")
    assert {r["span_id"]: r["depth"] for r in T.flame_graph(orphan).collect()} == {"s0": 0, "s2": 0}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text(spans(3) + "\nbroken\n")
    root = str(tmp_path / "out")

    def run():
        ingest.ingest(ingest.payload_files(spark, str(source)), ingest.SPAN_TABLES, root, str(tmp_path / "cp")).awaitTermination(120)

    run()
    (source / "b.txt").write_text(spans(2, code=1) + "\n")
    run()
    got = ingest.table(spark, root, "spans", first_day=0)
    want = otlp.spans(otlp.read_lines(spark, str(source)))
    key = ["trace_id", "span_id", "span_status", "ts_start_ns"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert ingest.table(spark, root, "spans", last_day=0).count() == 0


def test_rollup_stream(spark, tmp_path):
    stored = str(tmp_path / "spans")
    otlp.spans(payloads(spark, spans(4))).select("ts_start_ns", "service_name", "span_status").write.parquet(stored)
    stream = spark.readStream.schema("ts_start_ns long, service_name string, span_status string").parquet(stored)
    q = ingest.red_rollup(stream).writeStream.format("memory").queryName("rollup").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("SELECT service_name, count, errors FROM rollup").collect()] == [("shop", 4, 4)]


def test_response(spark):
    from telemark.operators import windows as W

    s = spark.createDataFrame([("m", {"a": "b"}, 1000, 2.0)], "metric string, labels map<string,string>, ts_ms long, value double")
    out = json.loads(otlp.response(W.instant(s, W.instant_at(1000))).first()["json"])
    assert out == {"metric": {"a": "b", "__name__": "m"}, "values": [["1.0", "2.0"]]}


def gauge(name, ts, value=1.0, **kv):
    point = {"attributes": attrs(**kv), "timeUnixNano": str(ts * 1_000_000), "asDouble": value}
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [{"name": name, "unit": "1", "gauge": {"dataPoints": [point]}}]}]}]})


def streams_of(df):
    return sorted((r["event_type"], r["metric"], r["lkey"], r["unit"], r["ts_start_ms"], r["ts_end_ms"]) for r in df.collect())


def test_index_of_streams_is_kept_at_ingest(spark, tmp_path):
    """Batches, one of them run again, and compaction in between give what all samples would."""
    root = str(tmp_path / "out")
    write = ingest.write_tables(ingest.METRIC_TABLES, root)
    batches = [[gauge("load", 50, host="a"), gauge("load", 70, host="a"), metrics()], [gauge("load", 10, host="a"), gauge("load", 60, host="b")], [gauge("load", 90, host="b"), gauge("heat", 5, host="a")]]
    seen = []
    for k, texts in enumerate(batches):
        seen += texts
        write(payloads(spark, *texts), k)
        if k == 1:
            write(payloads(spark, *texts), k)
            ingest.compact(spark, root, "streams")
        p = payloads(spark, *seen)
        kinds = [(otlp.gauges(p), "GAUGE", "ts_ms", "ts_ms"), (otlp.sums(p), "SUM", "ts_start_ms", "ts_end_ms"), (otlp.histograms(p), "HISTO", "ts_start_ms", "ts_end_ms"), (otlp.exponential_histograms(p), "HISTO", "ts_start_ms", "ts_end_ms")]
        want = sorted(x for args in kinds for x in streams_of(M.streams(*args)))
        assert streams_of(ingest.stream_index(spark, root)) == want
    ingest.compact(spark, root, "streams")
    index = ingest.stream_index(spark, root)
    assert streams_of(index) == want and len(want) == 7
    assert [r["metric"] for r in M.name_hints(index, 0, 100).collect()] == ["heat", "load"]
    assert [r["value"] for r in M.label_values(index, 80, 100, "host").collect()] == ["b"]
    assert all("/streams" in f for f in M.name_hints(index, 0, 100).inputFiles())


def span(i, service="shop", code=1, **kv):
    row = {"traceId": f"t{i}", "spanId": f"s{i}", "name": "op", "kind": 2, "startTimeUnixNano": str(10**18 + i), "endTimeUnixNano": str(10**18 + i + 1000 * (i + 1)), "attributes": attrs(**kv), "status": {"code": code}}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attrs(service__name=service)}, "scopeSpans": [{"spans": [row]}]}]})


def test_catalog_and_events_are_kept_at_ingest(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    found = []
    for k, texts in enumerate([[span(0, user="a", size=1)], [span(1, user="b", code=2), span(2, "other", size=2)], [span(3, size="big")]]):
        (source / f"{k}.txt").write_text("\n".join(texts) + "\n")
        ingest.ingest(ingest.payload_files(spark, str(source)), ingest.SPAN_TABLES, root, str(tmp_path / "cp")).awaitTermination(120)
        found.append({r["attribute_name"]: r["attribute_type"] for r in ingest.attribute_catalog(spark, root).collect()})
        if k == 1:
            ingest.compact(spark, root, "span_attributes")
    assert found == [{"user": "string", "size": "number"}, {"user": "string", "size": "number"}, {"user": "string", "size": "mixed"}]
    spans_so_far = otlp.spans(otlp.read_lines(spark, str(source)))
    assert sorted(map(tuple, T.attribute_catalog(spans_so_far).collect())) == sorted(found[-1].items())
    window = (10**18, 10**18 + 10**9)
    for keys in (["service_name"], ["service_name", "service_peer_name"]):
        got, want = (sorted(map(str, T.red(df, keys, *window, "HOURLY").collect())) for df in (ingest.red_events(spark, root), spans_so_far))
        assert got == want and got
    assert all("/red_events/" in f for f in T.red(ingest.red_events(spark, root), ["service_name"], *window, "HOURLY").inputFiles())


def test_typed_columns_of_spans(spark):
    """Each typed column from its first attribute that is there; what is promoted leaves the maps; absent ones are empty or null."""
    of = lambda k, v: {"key": k, "value": {"intValue": str(v)} if isinstance(v, int) else {"stringValue": v}}
    given = [of("db.name", "shop"), of("db.collection.name", "orders"), of("db.operation.name", "select"), of("db.statement", "select 1"), of("rpc.method", "Get"), of("rpc.response.status_code", 5), of("http.host", "h"), of("http.request.header.host", "first"), of("server.port", 80), of("own", "kept")]
    row = {"traceId": "t", "spanId": "s", "name": "op", "kind": 2, "startTimeUnixNano": "1", "endTimeUnixNano": "2", "attributes": given}
    text = json.dumps({"resourceSpans": [{"resource": {"attributes": attrs(service__name="shop")}, "scopeSpans": [{"spans": [row]}]}]})
    s = otlp.spans(payloads(spark, text)).first()
    assert (s["db_namespace"], s["db_collection_name"], s["db_operation_name"], s["db_query_text"], s["rpc_method"], s["rpc_method_original"], s["rpc_response_status_code"], s["http_host"], s["server_port"]) == ("shop", "orders", "select", "select 1", "Get", "Get", 5, "first", 80)
    assert s["attrs_str"] == {"own": "kept"} and s["attrs_num"] == {} and s["db_query_summary"] == "" and s["client_port"] is None
    assert set(Q.SPANS.defaults) <= set(s.asDict()) and Q.find(otlp.spans(payloads(spark, text)), Q.SPANS).count() == 1
