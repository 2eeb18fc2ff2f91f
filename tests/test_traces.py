"""Flame graphs of any depth."""

import pytest
from pyspark.sql import functions as F

from telemark.operators import traces


def frame(spark, parents):
    rows = [("t", s, p, 10 + k, 20 + k) for k, (s, p) in enumerate(parents)]
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, ts_start_ns long, ts_end_ns long")


def test_depth_has_no_limit(spark):
    chain = frame(spark, [(f"s{k}", f"s{k - 1}" if k else "") for k in range(150)])
    assert {r["span_id"]: r["depth"] for r in traces.flame_graph(chain).collect()} == {f"s{k}": k for k in range(150)}


def test_a_cycle_stays_in_its_trace(spark):
    cyclic = frame(spark, [("a", ""), ("b", "d"), ("c", "b"), ("d", "c"), ("e", "c"), ("f", "a")])
    fine = frame(spark, [("a", "gone"), ("b", "a")]).withColumn("trace_id", F.lit("u"))
    both = cyclic.unionByName(fine)
    got = {(r["trace_id"], r["span_id"]): (r["depth"], r["offset_ns"]) for r in traces.flame_graph(both).collect()}
    assert got == {("t", "a"): (0, 0), ("t", "f"): (1, 5), ("u", "a"): (0, 0), ("u", "b"): (1, 1)}
    assert [tuple(r) for r in traces.unreached(both).collect()] == [("t", 4)]
    assert {r["span_id"] for r in traces.flame_graph(both, "u").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="cycle"):
        traces.flame_graph(both, "t")


def test_of_spans_with_one_id_the_last_counts(spark):
    rows = [("t", "a", "", 5, 9), ("t", "b", "a", 6, 7), ("t", "b", "", 8, 9), ("t", "b", "a", 8, 8)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, ts_start_ns long, ts_end_ns long")
    assert {(r["span_id"], r["depth"], r["offset_ns"], r["duration_ns"]) for r in traces.flame_graph(df).collect()} == {("a", 0, 0, 4), ("b", 0, 3, 1)}


def test_a_search_gives_as_many_as_asked_for(spark):
    spans = spark.range(2500).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.col("id").alias("ts_start_ns"))
    assert traces.search(spans, F.lit(True), 2400).count() == 2400 and traces.search(spans, F.lit(True)).count() == 1000


def test_red_takes_spans_that_end_in_the_window(spark):
    rows = [("svc", "op", 10, 20, "OK"), ("svc", "late", 90, 120, "OK"), ("svc", "", 20, 100, "ERROR"), ("other", "op", 5, 30, "OK")]
    spans = spark.createDataFrame(rows, "service_name string, span_name string, ts_start_ns long, ts_end_ns long, span_status string")
    assert {(r["service_name"], r["count"], r["errors"]) for r in traces.red_totals(spans, ["service_name"], 10, 100).collect()} == {("svc", 2, 1)}
    assert traces.operation_count(spans, "svc", 10, 100).first()[0] == 1
    assert [r["service_name"] for r in traces.services(spans, 0, 100).collect()] == ["other", "svc"]
