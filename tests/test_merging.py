"""What is merged: sketches of quantiles, histograms of different bounds, sums of both representations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from telemark.operators import metrics as M
from telemark.operators import sketches as K
from telemark.operators import traces as T
from telemark.sources import otlp
from telemark.streaming import ingest


def rank_range(values, v):
    return sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)


def test_sketches_of_minutes_make_those_of_hours(spark):
    rng = random.Random(4)
    rows = [("ab"[i % 2], i * 500, rng.lognormvariate(3, 2) if i % 7 else None) for i in range(40_000)]
    df = spark.createDataFrame(rows, "k string, ts long, v double").repartition(7)
    minutes = K.rollup(df, ["k"], "ts", 60_000, F.col("v"))
    hours = K.coarser(minutes, ["k"], 3_600_000)
    levels = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = K.quantiles(hours.withColumn("n", K.size(F.col("sketch"))), levels).collect()
    assert len(got) == 12 and minutes.count() > 600
    for r in got:
        values = [v for k, ts, v in rows if k == r["k"] and ts // 3_600_000 * 3_600_000 == r["bucket"] and v is not None]
        assert r["n"] == len(values)
        for name, q in levels.items():
            below, upto = rank_range(values, r[name])
            assert below - 3 * K.error() <= q <= upto + 3 * K.error()
    few = K.quantiles(K.rollup(df.where("ts < 100000"), ["k"], "ts", 3_600_000, F.col("v")), levels).collect()
    for r in few:  # fewer than the size: exact
        values = sorted(v for k, ts, v in rows if k == r["k"] and ts < 100_000 and v is not None)
        assert r["p50"] == values[-(-len(values) // 2) - 1]


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, ts long, v double")
    rows = K.quantiles(K.coarser(K.rollup(df, ["k"], "ts", 10, F.col("v")), ["k"], 100), {"p50": 0.5}).collect()
    assert [(r["k"], r["p50"]) for r in rows] == [("a", None)]
    assert K.rollup(df.limit(0), ["k"], "ts", 10, F.col("v")).count() == 0


def span(i, name, start, length, code):
    row = {"traceId": f"t{i}", "spanId": f"s{i}", "name": "op", "kind": 2, "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + length), "status": {"code": code}, "attributes": []}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": name}}]}, "scopeSpans": [{"spans": [row]}]}]})


def test_summaries_from_sketches_kept_at_ingest(spark, tmp_path):
    """Batches that meet in a minute are merged; a batch that runs again counts once."""
    hour = 3600 * 10**9
    lines = [span(i, "ab"[i % 2], hour + i * 10**9, 1000 + i * i % 97, 1 + i % 3 // 2) for i in range(300)]
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name, part in (("1", lines[::2]), ("2", lines[1::2])):
        (source / name).write_text("\n".join(part) + "\n")
        ingest.ingest(ingest.payload_files(spark, str(source)), {"spans": otlp.spans}, root, str(tmp_path / "checkpoint")).awaitTermination()
    write = ingest.write_tables({"spans": otlp.spans}, root)
    write(spark.createDataFrame([(x,) for x in lines[::2]], "payload string"), 0)
    got = {(r["service_name"], r["bucket_ns"]): r for r in T.red_merged(ingest.red_sketches(spark, root), ["service_name"], 0, 10 * hour, "HOURLY").collect()}
    want = T.red(otlp.spans(otlp.read_lines(spark, str(source))), ["service_name"], 0, 10 * hour, "HOURLY").collect()
    assert len(want) == len(got) == 2
    for r in want:
        g = got[r["service_name"], r["bucket_ns"]]
        assert [g[c] for c in ("count", "errors", "rps", "rpm", "error_rate")] == [r[c] for c in ("count", "errors", "rps", "rpm", "error_rate")]
        assert abs(g["p50"] - r["p50"]) <= 1 and abs(g["p99"] - r["p99"]) <= 2


HISTOGRAM = "lkey string, unit string, tags map<string,string>, buckets array<double>, counts array<long>, sum double, count long"


def merged_plainly(histograms):
    bounds = sorted({b for _, buckets, _ in histograms for b in buckets})
    reached = []
    for x in bounds:
        total = 0.0
        for _, buckets, counts in histograms:
            upto = [sum(counts[: i + 1]) for i in range(len(counts))]
            k = sum(b < x for b in buckets)
            if k == len(buckets):
                total += upto[k - 1] if k else 0
            elif buckets[k] == x:
                total += upto[k]
            elif k:
                total += upto[k - 1] + (upto[k] - upto[k - 1]) * (x - buckets[k - 1]) / (buckets[k] - buckets[k - 1])
        reached.append(total)
    return bounds, reached, sum(sum(c) for _, _, c in histograms)


def test_histograms_of_unlike_bounds(spark):
    rng = random.Random(6)
    rows = []
    for key in "abcd":
        for _ in range(5):
            buckets = sorted(rng.sample([1.0, 2.0, 3.5, 5.0, 8.0, 13.0, 21.0], rng.randint(0, 5)))
            rows.append((key, buckets, [rng.randint(0, 50) for _ in range(len(buckets) + 1)]))
    rows += [("none", [], [7]), ("same", [1.0, 2.0], [1, 2, 3]), ("same", [1.0, 2.0], [4, 5, 6])]
    results = []
    for order in (rows, rows[::-1], rng.sample(rows, len(rows))):
        df = spark.createDataFrame([(k, None, {"k": k}, b, c, float(sum(c)), sum(c)) for k, b, c in order], HISTOGRAM).repartition(rng.randint(1, 5))
        results.append({r["lkey"]: (r["buckets"], r["counts"], r["count"]) for r in M.merge_bounds(df).collect()})
    assert results[0] == results[1] == results[2]
    for key, (buckets, counts, count) in results[0].items():
        bounds, reached, total = merged_plainly([r for r in rows if r[0] == key])
        assert buckets == bounds and sum(counts) == count == total and min(counts) >= 0
        assert all(abs(sum(counts[: i + 1]) - x) <= 0.5 + 1e-4 for i, x in enumerate(reached))
    assert results[0]["none"][:2] == ([], [7]) and results[0]["same"][1] == [5, 7, 9]
    assert M.merge_bounds(df.limit(0)).count() == 0


def test_rebin_keeps_what_is_above_all_bounds(spark):
    df = spark.createDataFrame([("a", "1", {"k": "v"}, [10.0, 20.0], [1, 2, 4], 7.0, 7)], HISTOGRAM)
    assert M.rebin(df, [5.0, 20.0]).first()["counts"] == [0.0, 3.0, 4.0]


SUMS = "metric string, tags map<string,string>, lkey string, unit string, ts_start_ms long, ts_end_ms long, value double, sums_type string"


def test_each_series_chooses_its_representation(spark):
    of = lambda key, ts, v, kind: ("m", {"k": key}, key, None, ts - 1, ts, v, kind)
    rows = [*(of("both", t, float(t), "CUMULATIVE") for t in range(0, 50, 10)), of("both", 25, 3.0, "DELTA"), *(of("total", t, v, "CUMULATIVE") for t, v in ((0, 5.0), (10, 7.0), (20, 2.0), (30, 2.0), (45, 9.0))), of("delta", 7, 1.5, "DELTA"), of("delta", 907, 1.5, "DELTA")]
    df = spark.createDataFrame(rows, SUMS).repartition(3)
    got = sorted((r["lkey"], r["ts_end_ms"], r["value"], r["sums_type"]) for r in M.sum_scan(df, "m", -5, 100).collect())
    assert got == [("both", 25, 3.0, "DELTA"), ("delta", 7, 1.5, "DELTA"), ("total", 0, 5.0, "DELTA"), ("total", 10, 2.0, "DELTA"), ("total", 20, 2.0, "DELTA"), ("total", 30, 0.0, "DELTA"), ("total", 45, 7.0, "DELTA")]
    assert M.sum_scan(df, "m", -5, 100).columns == df.columns and M.sum_scan(df.limit(0), "m", 0, 1).count() == 0


@pytest.mark.parametrize("chunk", [1, 10, 25, 10_000])
def test_chunks_of_time_don_t_change_deltas(spark, chunk):
    rng = random.Random(chunk)
    values, rows = {}, []
    for key in "ab":
        total = 0.0
        for t in sorted(rng.sample(range(500), 60)):
            total = float(rng.randint(0, 3)) if rng.random() < 0.1 else total + rng.randint(0, 9)
            before = values.get(key)
            values[key] = total
            rows.append((("m", {}, key, "1", t - 1, t, total, "CUMULATIVE"), total if before is None or total < before else total - before))
    got = {(r["lkey"], r["ts_end_ms"]): r["value"] for r in M.cumulative_to_delta(spark.createDataFrame([r for r, _ in rows], SUMS), chunk).collect()}
    assert got == {(r[2], r[5]): v for r, v in rows}
