"""Floats and histograms in one vector, and the errors where kinds must not meet."""

import math

import pytest
from pyspark.sql import functions as F

from telemark.operators import histograms as H
from telemark.operators import mixed as M
from telemark.operators import traces
from telemark.operators import windows as W

MIN = 60_000


def hist(*counts, schema=0, offset=1, total=None, custom=(), negative=(), zero=0.0):
    return (schema, 0.001, zero, offset, [float(c) for c in counts], 1, [float(c) for c in negative], list(custom), 10.0 if total is None else total, float(sum(counts) + sum(negative) + zero))


def vector(spark, rows):
    """(metric, labels, t, float or histogram) rows."""
    out = [(m, d, None, t, None if isinstance(x, tuple) else x, x if isinstance(x, tuple) else None) for m, d, t, x in rows]
    df = spark.createDataFrame(out, f"metric string, labels map<string,string>, lkey string, t long, value double, hist {M.HIST}")
    from telemark.model import label_key

    return df.withColumns({"lkey": label_key("labels"), "src_ts": F.col("t"), "drop_name": F.lit(False)}).select(*M.MIXED)


def shown(v, name="g"):
    return {(r["labels"].get(name, ""), r["t"]): r["value"] if r["hist"] is None else (r["hist"]["positive_buckets"], r["hist"]["sum"], r["hist"]["count"]) for r in v.collect()}


@pytest.fixture(scope="module")
def both(spark):
    """Groups f (floats), h (histograms), x (both), c (exponential and custom)."""
    rows = [("m", {"g": "f", "i": str(i)}, 0, x) for i, x in enumerate([1e16, 1.0, -1e16])]
    rows += [("m", {"g": "h", "i": "0"}, 0, hist(1, 2)), ("m", {"g": "h", "i": "1"}, 0, hist(3, 4, 5, total=2.0))]
    rows += [("m", {"g": "x", "i": "0"}, 0, 5.0), ("m", {"g": "x", "i": "1"}, 0, hist(1))]
    rows += [("m", {"g": "c", "i": "0"}, 0, hist(1)), ("m", {"g": "c", "i": "1"}, 0, hist(1, 1, schema=H.CUSTOM, offset=0, custom=(5.0,)))]
    return vector(spark, rows)


def test_aggregates(both):
    by = ["g"]
    assert shown(M.aggregate(both, "sum", by)) == {("f", 0): 1.0, ("h", 0): ([4.0, 6.0, 5.0], 12.0, 15.0)}
    assert shown(M.aggregate(both, "avg", by)) == {("f", 0): 1 / 3, ("h", 0): ([2.0, 3.0, 2.5], 6.0, 7.5)}
    assert shown(M.aggregate(both, "count", by)) == {("f", 0): 3, ("h", 0): 2, ("x", 0): 2, ("c", 0): 2}
    assert shown(M.aggregate(both, "group", by)) == {(g, 0): 1 for g in "fhxc"}
    assert shown(M.aggregate(both, "max", by)) == {("f", 0): 1e16, ("x", 0): 5}
    assert {(r["lkey"], r["floats"], r["exponential"], r["custom"]) for r in M.conflicts(both, by).collect()} == {('{"g":"x"}', 1, 1, 0), ('{"g":"c"}', 0, 1, 1)}
    named = M.aggregate(both, "sum", ["__name__", "g"]).collect()
    assert {(r["metric"], r["labels"]["g"], r["drop_name"]) for r in named} == {("m", "f", False), ("m", "h", False)}


def test_count_values_of_histograms(spark):
    a = hist(1, 2, total=18.4)
    v = vector(spark, [("m", {"i": "0"}, 0, a), ("m", {"i": "1"}, 0, a), ("m", {"i": "2"}, 0, 3.0), ("m", {"i": "3"}, 0, hist(1, negative=(0.5, 2), zero=4.0))])
    got = {r["labels"]["v"]: r["value"] for r in M.count_values(v, "v").collect()}
    assert got == {"{count:3, sum:18.4, (1,2]:1, (2,4]:2}": 2, "3": 1, "{count:7.5, sum:10, [-4,-2):2, [-2,-1):0.5, [-0.001,0.001]:4, (1,2]:1}": 1}


def test_operators(spark, both):
    kinds = lambda v: {(k[0], isinstance(x, tuple)) for k, x in shown(v).items()}
    assert kinds(M.arithmetic(both, "+", 1.0)) == {("f", False), ("x", False)}
    assert ("h", True) in kinds(M.arithmetic(both, "*", 2.0)) and ("h", True) in kinds(M.arithmetic(both, "/", 2.0))
    assert ("h", True) not in kinds(M.arithmetic(both, "/", 2.0, number_left=True))
    left = vector(spark, [("a", {"g": g}, 0, x) for g, x in (("ff", 6.0), ("hh", hist(4, 2)), ("hf", hist(4, 2)), ("fh", 2.0))])
    right = vector(spark, [("b", {"g": g}, 0, x) for g, x in (("ff", 3.0), ("hh", hist(1, 1, total=4.0)), ("hf", 2.0), ("fh", hist(3)))])
    assert shown(M.binary(left, right, "+")) == {("ff", 0): 9.0, ("hh", 0): ([5.0, 3.0], 14.0, 8.0)}
    assert shown(M.binary(left, right, "-")) == {("ff", 0): 3.0, ("hh", 0): ([3.0, 1.0], 6.0, 4.0)}
    assert shown(M.binary(left, right, "*")) == {("ff", 0): 18.0, ("hf", 0): ([8.0, 4.0], 20.0, 12.0), ("fh", 0): ([6.0], 20.0, 6.0)}
    assert shown(M.binary(left, right, "/")) == {("ff", 0): 2.0, ("hf", 0): ([2.0, 1.0], 5.0, 3.0)}
    assert shown(M.binary(left, right, "</")) == {("hf", 0): ([4.0], 4 * math.sqrt(2), 4.0)}
    assert shown(M.binary(left, right, ">/")) == {("hf", 0): ([2.0], 2 * math.sqrt(8), 2.0)}


def test_ranges(spark):
    rows = [("m", {"i": "0"}, k * MIN, x) for k, x in enumerate([1.0, 1.0, hist(1), hist(1), hist(2), 7.0, 3.0])]
    raw = vector(spark, rows).select("metric", "labels", "lkey", F.col("t").alias("ts_ms"), "value", "hist", F.lit(False).alias("is_stale"))
    grid = W.Grid(2 * MIN, 6 * MIN, 2 * MIN)
    assert {r["t"] // MIN: r["value"] for r in M.changes(raw, grid, 10 * MIN).collect()} == {2: 1, 4: 2, 6: 4}
    assert {r["t"] // MIN: r["value"] for r in M.resets(raw, grid, 10 * MIN).collect()} == {2: 1, 4: 1, 6: 3}
    now = {r["t"] // MIN: (r["value"], r["hist"] and r["hist"]["count"]) for r in M.instant(raw, grid).collect()}
    assert now == {2: (None, 1.0), 4: (None, 2.0), 6: (3.0, None)}


def test_trim(spark):
    """Empty buckets on the side that goes are left out, sum and count are estimated anew."""
    whole = hist(2, 4, 8, negative=(1, 3), zero=2.0)
    v = vector(spark, [("m", {}, 0, whole)])
    one = lambda op, at: H.trim(M.histograms(v), op, at).first()["hist"]
    below = one("</", 3.0)
    share = math.log(3 / 2) / math.log(2)
    assert (below["positive_offset"], below["negative_offset"], below["negative_buckets"], below["zero_count"]) == (1, 1, [1.0, 3.0], 2.0)
    assert below["positive_buckets"] == [2.0, pytest.approx(4 * share)] and below["count"] == pytest.approx(2 + 4 * share + 6)
    assert below["sum"] == pytest.approx(2 * 2**0.5 + 4 * share * 6**0.5 - 2**0.5 - 3 * 8**0.5)
    above = one(">/", 3.0)
    assert (above["positive_offset"], above["negative_buckets"], above["zero_count"]) == (2, [], 0.0)
    assert above["positive_buckets"] == [pytest.approx(4 * (1 - share)), 8.0] and above["count"] + below["count"] == pytest.approx(20)
    assert tuple(one("</", math.inf)) == whole and tuple(one(">/", -math.inf)) == whole
    assert one("</", -1e9)["count"] == 0
    custom = vector(spark, [("m", {}, 0, hist(2, 4, 6, schema=H.CUSTOM, offset=0, custom=(5.0, 10.0)))])
    cut = H.trim(M.histograms(custom), ">/", 7.5)
    h = cut.first()["hist"]
    assert (h["positive_offset"], h["positive_buckets"], h["count"], h["sum"]) == (1, [2.0, 6.0], 8.0, 2 * 8.75 + 6 * 10.0)
    assert {(r["lower"], r["upper"], r["n"]) for r in H.bucket_rows(cut).collect()} == {(5.0, 10.0, 2.0), (10.0, math.inf, 6.0)}


def test_guard_of_representations(spark):
    frame = lambda rows: vector(spark, rows).select("metric", "labels", "lkey", F.col("t").alias("ts_ms"), "hist")
    a, b, c = frame([("m", {"i": "0"}, 0, hist(1))]), frame([("m", {"i": "1"}, 0, hist(1))]), frame([("m", {"i": "0"}, 9, hist(1))])
    assert M.single_representation(a, b).count() == 2
    with pytest.raises(Exception, match="both explicit and exponential"):
        M.single_representation(a, c).select("ts_ms").collect()


def test_guard_of_classic_and_native(spark):
    bucket = lambda m, i, le, n: (m, {"i": i, "le": le}, 0, n)
    run = lambda rows: {r["lkey"]: r["value"] for r in M.histogram_function(vector(spark, rows), lambda h: H.quantile(h, 0.5), lambda f: H.histogram_quantile(f, 0.5)).collect()}
    apart = [bucket("m", "0", "1", 1.0), bucket("m", "0", "+Inf", 1.0), ("m", {"i": "1"}, 0, hist(4))]
    assert run(apart) == {'{"i":"0"}': 0.5, '{"i":"1"}': pytest.approx(2**0.5)}
    assert run([*apart, ("m", {"i": "0"}, 0, hist(4))]) == {'{"i":"1"}': pytest.approx(2**0.5)}
    with pytest.raises(Exception, match="several kinds or metrics"):
        run([*apart, ("other", {"i": "0"}, 0, hist(4))])
    with pytest.raises(Exception, match="several kinds or metrics"):
        run([*apart, bucket("other", "0", "2", 1.0)])


def test_guard_of_aggregations(spark):
    df = spark.createDataFrame([({"s": "x", "b": "y"}, {"n": 1.0, "b": 2.0})], "attrs_str map<string,string>, attrs_num map<string,double>")
    traces.checked_aggregation(df, ["n", "duration"], "AVG", "HOURLY")
    traces.checked_aggregation(df, ["s"], "COUNT")
    for wrong in ("s", "b", "missing"):
        with pytest.raises(ValueError, match="non-numerical"):
            traces.checked_aggregation(df, [wrong], "AVG", "HOURLY")
    with pytest.raises(ValueError, match="resolution"):
        traces.checked_aggregation(df, ["n"], "AVG")
