"""Functions of samples on small series with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from telemark.model import label, materialize
from telemark.operators import histograms as H
from telemark.operators import vectors as V
from telemark.operators import windows as W

MIN = 60_000


def load(spark, series, step=MIN):
    """series: {(metric, ((label, value), ...)): [values]}; None is a missing sample, "stale" a marker."""
    rows = []
    for (metric, labels), values in series.items():
        for i, v in enumerate(values):
            if v is not None:
                rows.append((metric, dict(labels), i * step, math.nan if v == "stale" else float(v), v == "stale"))
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double, is_stale boolean")


def values(v, *names):
    return {(*(r[n] for n in names), r["t"]): r["value"] for r in v.select("t", *(label("labels", n).alias(n) for n in names), "value").collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert (math.isnan(got[k]) and math.isnan(want[k])) or got[k] == pytest.approx(want[k], rel=1e-9), k


def counter(spark):
    return load(spark, {("c", (("j", "a"),)): [0, 10, 20, 30, 5, 15, 25]})


def test_increase_and_rate_make_resets_good(spark):
    at = W.instant_at(6 * MIN)
    # 0 10 20 30 | reset | 5 15 25 in (1 min, 6 min]: samples at 2..6 min, change 25 - 20 + 30 over 4 minutes, to 5 minutes
    close(values(W.increase(counter(spark), at, 5 * MIN), "j"), {("a", 6 * MIN): 35 * 5 / 4})
    close(values(W.rate(counter(spark), at, 5 * MIN), "j"), {("a", 6 * MIN): 35 * 5 / 4 / 300})
    assert values(W.increase(counter(spark), W.instant_at(0), 5 * MIN)) == {}  # one sample


def test_chunks_do_not_change_a_result(spark):
    grid = W.Grid(0, 6 * MIN, MIN // 2)
    a = values(W.increase(counter(spark), grid, 2 * MIN, chunk_steps=1), "j")
    close(a, values(W.increase(counter(spark), grid, 2 * MIN, chunk_steps=1000), "j"))
    assert len(a) > 5


def test_irate_idelta_changes_resets(spark):
    at = W.instant_at(4 * MIN)
    close(values(W.irate(counter(spark), at, 5 * MIN)), {(4 * MIN,): 5 / 60})
    close(values(W.idelta(counter(spark), at, 5 * MIN)), {(4 * MIN,): -25})
    close(values(W.changes(counter(spark), at, 5 * MIN)), {(4 * MIN,): 4})
    close(values(W.resets(counter(spark), at, 5 * MIN)), {(4 * MIN,): 1})


def test_instant_lookback_and_staleness(spark):
    s = load(spark, {("m", ()): [1, 2, "stale", None, None, None, None, None, 3]})
    got = values(W.instant(s, W.Grid(0, 14 * MIN, MIN)))
    want = {(0,): 1, (MIN,): 2, **{(t * MIN,): 3 for t in range(8, 13)}}
    close(got, want)  # nothing after the marker, and five minutes of lookback, open on the left


def test_offset_at_and_subquery(spark):
    s = load(spark, {("m", ()): range(10)})
    close(values(W.instant(s, W.instant_at(5 * MIN), offset=2 * MIN)), {(5 * MIN,): 3})
    close(values(W.at(lambda g: W.instant(s, g), 4 * MIN, W.Grid(0, 2 * MIN, MIN), spark)), {(0,): 4, (MIN,): 4, (2 * MIN,): 4})
    inner = W.subquery(lambda g: W.instant(s, g), W.instant_at(9 * MIN), 4 * MIN, 2 * MIN)
    close(values(W.over_time(inner, "sum", W.instant_at(9 * MIN), 4 * MIN)), {(9 * MIN,): 6 + 8})
    with pytest.raises(ValueError):
        W.subquery(lambda g: W.instant(s, g), W.instant_at(0), MIN, 0)


def test_over_time_with_nan(spark):
    s = load(spark, {("m", ()): [3, math.nan, 1]})
    at = W.instant_at(2 * MIN)
    close(values(W.over_time(s, "max", at, 5 * MIN)), {(2 * MIN,): 3})
    close(values(W.over_time(s, "min", at, 5 * MIN)), {(2 * MIN,): 1})
    close(values(W.over_time(s, "sum", at, 5 * MIN)), {(2 * MIN,): math.nan})
    close(values(W.over_time(s, "ts_of_min", at, 5 * MIN)), {(2 * MIN,): 120})


def test_smoothed_and_anchored(spark):
    s = load(spark, {("m", ()): [0, 10, 20, 30]})
    at = W.instant_at(5 * MIN // 2)
    close(values(W.instant_smoothed(s, at)), {(5 * MIN // 2,): 25})
    close(values(W.smoothed(s, "delta", at, MIN)), {(5 * MIN // 2,): 10})
    close(values(W.anchored(s, "increase", at, MIN)), {(5 * MIN // 2,): 10})


def test_holt(spark):
    s = load(spark, {("m", ()): [1, 3, 4]})
    # level 1, slope 2; 3: level 3, slope 2; 4: level 4.5
    close(values(W.double_exponential_smoothing(s, W.instant_at(2 * MIN), 5 * MIN, 0.5, 0.5)), {(2 * MIN,): 4.5})


def pair(spark):
    s = load(spark, {("m", (("g", "a"), ("i", "1"))): [1], ("m", (("g", "a"), ("i", "2"))): [3], ("m", (("g", "b"), ("i", "1"))): [math.nan]})
    return W.instant(s, W.instant_at(0))


def test_aggregation(spark):
    v = pair(spark)
    close(values(V.aggregate(v, "sum", by=["g"]), "g"), {("a", 0): 4, ("b", 0): math.nan})
    close(values(V.aggregate(v, "max", without=["i"]), "g"), {("a", 0): 3, ("b", 0): math.nan})
    close(values(V.aggregate(v, "count")), {(0,): 3})
    close(values(V.topk(v, 1), "g", "i"), {("a", "2", 0): 3})
    close(values(V.topk(v, 3, largest=False), "g", "i"), {("a", "2", 0): 3, ("a", "1", 0): 1, ("b", "1", 0): math.nan})
    close(values(V.quantile(v, 0.5, by=["g"], exact_nan=True), "g"), {("a", 0): 2, ("b", 0): math.nan})
    close(values(V.quantile(v, 2, by=["g"]), "g"), {("a", 0): math.inf, ("b", 0): math.inf})
    close(values(V.count_values(v, "x"), "x"), {("1", 0): 1, ("3", 0): 1, ("NaN", 0): 1})
    assert V.limitk(v, 1, by=["g"]).count() == 2
    assert V.limit_ratio(v, 0.4).count() + V.limit_ratio(v, -0.6).count() == 3


def test_ieee(spark):
    v = pair(spark)
    close(values(V.arithmetic(V.arithmetic(v, "-", 1.0), "/", 1.0, number_left=True), "g", "i"), {("a", "1", 0): math.inf, ("a", "2", 0): 0.5, ("b", "1", 0): math.nan})
    close(values(V.compare(v, ">", 0.0, as_bool=True), "g", "i"), {("a", "1", 0): 1, ("a", "2", 0): 1, ("b", "1", 0): 0})
    close(values(V.apply(V.arithmetic(v, "-", 1.0), "ln"), "g", "i"), {("a", "1", 0): -math.inf, ("a", "2", 0): math.log(2), ("b", "1", 0): math.nan})


def test_matching_errors_and_fill(spark):
    v = pair(spark)
    with pytest.raises(Exception, match="duplicate series"):
        V.binary(v, v, "+", V.Matching(on=("g",))).collect()
    one = V.aggregate(v, "sum", by=["g"])
    got = values(V.binary(v, one, "/", V.Matching(on=("g",), group="left")), "g", "i")
    close(got, {("a", "1", 0): 0.25, ("a", "2", 0): 0.75, ("b", "1", 0): math.nan})
    a, b = V.compare(v, "==", 1.0), V.compare(v, "==", 3.0)
    close(values(V.binary(a, b, "+", fill_left=10.0, fill_right=100.0), "g", "i"), {("a", "1", 0): 101, ("a", "2", 0): 13})


def test_names(spark):
    v = pair(spark)
    assert {r["metric"] for r in materialize(v).collect()} == {"m"}
    assert {r["metric"] for r in materialize(V.apply(v, "abs")).collect()} == {None}
    twice = v.unionByName(V.label_replace(v, "__name__", "n", "g", ".*"))
    assert materialize(twice).count() == 6
    with pytest.raises(Exception, match="same labelset"):
        materialize(V.apply(twice, "abs")).collect()
    with pytest.raises(ValueError):
        V.label_replace(v, "0x", "", "g", "")


def test_natural_order(spark):
    s = load(spark, {("m", (("i", f"n{k}"),)): [k] for k in (10, 9, 2, 100)})
    ordered = V.sort_by_label(W.instant(s, W.instant_at(0)), "i").select(label("labels", "i").alias("i")).collect()
    assert [r["i"] for r in ordered] == ["n2", "n9", "n10", "n100"]


def native(spark, *rows):
    fields = "metric string, labels map<string,string>, lkey string, ts_ms long, hist struct<schema:int,zero_threshold:double,zero_count:double,positive_offset:int,positive_buckets:array<double>,negative_offset:int,negative_buckets:array<double>,custom_values:array<double>,sum:double,count:double>"
    return spark.createDataFrame([("h", {"i": str(k)}, f'{{"i":"{k}"}}', t, h) for k, t, h in rows], fields)


def hist(schema, offset, buckets, total, custom=(), zero=0.0):
    return (schema, 0.001, zero, offset, list(map(float, buckets)), 0, [], list(map(float, custom)), float(total), float(sum(buckets) + zero))


def test_native_merge_to_lower_resolution(spark):
    # schema 1: buckets 1, 2, 3 cover (1, 1.41], (1.41, 2], (2, 2.83]; at schema 0 they are buckets 1, 1, 2
    v = H.instant(native(spark, (1, 0, hist(1, 1, [1, 2, 4], 12)), (2, 0, hist(0, 1, [10, 20], 50))), W.instant_at(0), MIN)
    merged = H.combine(v)
    h = merged.select("hist.*").first()
    assert (h["schema"], h["positive_offset"], h["positive_buckets"], h["sum"], h["count"]) == (0, 1, [13.0, 24.0], 62.0, 37.0)
    close(values(H.quantile(merged, 0.0)), {(0,): 1.0})
    close(values(H.quantile(merged, 1.0)), {(0,): 4.0})
    close(values(H.fraction(merged, 1.0, 2.0)), {(0,): 13 / 37})
    close(values(H.avg(merged)), {(0,): 62 / 37})


def test_custom_bounds_that_all_have(spark):
    v = H.instant(native(spark, (1, 0, hist(H.CUSTOM, 0, [1, 2, 3, 4], 9, (5, 10, 20))), (2, 0, hist(H.CUSTOM, 0, [1, 1, 1], 3, (5, 20)))), W.instant_at(0), MIN)
    h = H.combine(v).select("hist.*").first()
    assert (h["custom_values"], h["positive_buckets"]) == ([5.0, 20.0], [2.0, 6.0, 5.0])


def test_native_increase_and_difference(spark):
    s = native(spark, (1, 0, hist(0, 1, [1, 1], 3)), (1, MIN, hist(0, 1, [4, 2], 9)), (1, 2 * MIN, hist(0, 1, [1, 0], 1)))
    h = H.increase(s, W.instant_at(2 * MIN), 5 * MIN, extrapolate=False).select("hist.*").first()
    assert (h["positive_buckets"], h["count"]) == ([4.0, 1.0], 5.0)  # 6 - 2 until the reset, then 1
    h = H.increase(s, W.instant_at(2 * MIN), 5 * MIN).select("hist.*").first()
    assert (h["positive_buckets"], h["count"]) == ([5.0, 1.25], 6.25)  # two minutes sampled, half a minute before them
    h = H.rate(s, W.instant_at(2 * MIN), 5 * MIN).select("hist.*").first()
    assert h["count"] == pytest.approx(6.25 / 300)
    h = H.irate(s, W.instant_at(2 * MIN), 5 * MIN).select("hist.*").first()
    assert h["count"] == pytest.approx(1 / 60)  # after a reset the last one as it is
    h = H.irate(s, W.instant_at(MIN), 5 * MIN).select("hist.*").first()
    assert h["positive_buckets"] == pytest.approx([3 / 60, 1 / 60])
    close(values(H.resets(s, W.instant_at(2 * MIN), 5 * MIN)), {(2 * MIN,): 1})
    close(values(H.changes(s, W.instant_at(2 * MIN), 5 * MIN)), {(2 * MIN,): 2})
    close(values(H.count_over_time(s, W.instant_at(2 * MIN), 5 * MIN)), {(2 * MIN,): 3})
    assert H.sum_over_time(s, W.instant_at(2 * MIN), 5 * MIN).select("hist.count").first()[0] == 9
    assert H.avg_over_time(s, W.instant_at(2 * MIN), 5 * MIN).select("hist.count").first()[0] == 3
    # one bucket that fell is a reset, though the count grew
    s2 = native(spark, (1, 0, hist(0, 1, [5, 1], 3)), (1, MIN, hist(0, 0, [0, 3, 9], 9)))
    close(values(H.resets(s2, W.instant_at(MIN), 5 * MIN)), {(MIN,): 1})
    v = H.instant(s, W.instant_at(MIN), MIN)
    assert H.subtract(v, v).select("hist.count").first()[0] == 0
    assert H.mean(v).select("hist.count").first()[0] == 6


def test_classic_quantile(spark):
    rows = {("b", (("le", le),)): [v] for le, v in (("0.1", 50), ("0.2", 70), ("1e0", 90), ("+Inf", 100))}
    v = W.instant(load(spark, rows), W.instant_at(0))
    close(values(H.histogram_quantile(v, 0.8)), {(0,): 0.2 + 0.8 * 10 / 20})
    close(values(H.histogram_quantile(v, 0.99)), {(0,): 1.0})
    close(values(H.histogram_quantile(v, -1)), {(0,): -math.inf})
    close(values(H.histogram_fraction(v, 0.1, 0.2)), {(0,): 0.2})
    assert V.absent(v.where(F.lit(False)), W.instant_at(0), {"job": "x"}).select("labels").first()[0] == {"job": "x"}
    # an empty first bucket at the quantile 0 gives its bound
    rows = {("b", (("le", le),)): [v] for le, v in (("0.1", 0), ("0.2", 70), ("+Inf", 100))}
    close(values(H.histogram_quantile(W.instant(load(spark, rows), W.instant_at(0)), 0.0)), {(0,): 0.1})


def test_native_quantile_at_edges(spark):
    """Ranks at an edge go on to the next filled bucket; the zero bucket reaches to the filled side alone."""
    at = lambda h: H.instant(native(spark, (1, 0, h)), W.instant_at(0), MIN)
    gap = at(hist(0, 1, [2, 0, 2], 9))  # (1, 2] and (4, 8]
    close(values(H.quantile(gap, 0.5)), {(0,): 4.0})
    close(values(H.quantile(gap, 1.0)), {(0,): 8.0})
    close(values(H.quantiles(gap, "q", 0.5, 0.0), "q"), {("0.5", 0): 4.0, ("0", 0): 1.0})
    positive = at(hist(0, 1, [2], 3, zero=2.0))
    close(values(H.quantile(positive, 0.25)), {(0,): 0.0005})  # half way from 0 to 0.001
    alone = at(hist(0, 1, [0], 0, zero=2.0))
    close(values(H.quantile(alone, 0.5)), {(0,): 0.0})
    negative = at((0, 0.001, 2.0, 0, [], 1, [2.0], [], -3.0, 4.0))
    close(values(H.quantile(negative, 0.75)), {(0,): -0.0005})
    custom = at(hist(H.CUSTOM, 0, [0, 2, 2], 9, (5, 10)))
    close(values(H.quantiles(custom, "q", 0.0, 0.5, 1.0), "q"), {("0", 0): 5.0, ("0.5", 0): 10.0, ("1", 0): 10.0})


def test_native_comparison(spark):
    v = H.instant(native(spark, (1, 0, hist(0, 1, [1, 1], 3)), (2, 0, hist(0, 1, [1, 1], 3))), W.instant_at(0), MIN)
    w = H.instant(native(spark, (1, 0, hist(0, 0, [0, 1, 1, 0], 3)), (2, 0, hist(0, 1, [1, 2], 3))), W.instant_at(0), MIN)
    assert [r["lkey"] for r in H.compare(v, w, "==").collect()] == ['{"i":"1"}'] and [r["lkey"] for r in H.compare(v, w, "!=").collect()] == ['{"i":"2"}']
    close(values(H.compare(v, w, "==", as_bool=True), "i"), {("1", 0): 1, ("2", 0): 0})
    with pytest.raises(ValueError):
        H.compare(v, w, "<")


def test_matching_rules(spark):
    """Comparisons keep the left value with many series on the right; included labels that are missing leave the own ones; units count where both sides know them."""
    l = W.instant(load(spark, {("l", (("x", "1"), ("y", "a"))): [5]}), W.instant_at(0))
    r = W.instant(load(spark, {("r", (("x", "1"), ("z", "p"), ("y", "own"))): [3], ("r", (("x", "1"), ("z", "q"), ("y", "own"))): [4]}), W.instant_at(0))
    out = V.binary(l, r, ">", V.Matching(on=("x",), group="right"))
    close(values(out, "z", "y"), {("p", "own", 0): 5, ("q", "own", 0): 5})
    assert {x["metric"] for x in out.collect()} == {"l"}
    out = V.binary(r, l, "+", V.Matching(on=("x",), group="left", include=("z", "y")))
    close(values(out, "z", "y"), {("p", "a", 0): 8, ("q", "a", 0): 9})
    one = W.instant(load(spark, {("a", (("x", "1"), ("__unit__", "s"))): [1]}), W.instant_at(0))
    two = W.instant(load(spark, {("b", (("x", "1"),)): [2]}), W.instant_at(0))
    three = W.instant(load(spark, {("c", (("x", "1"), ("__unit__", "m"))): [3]}), W.instant_at(0))
    close(values(V.binary(one, two, "+"), "x"), {("1", 0): 3})
    assert V.binary(one, three, "+").count() == 0 and V.and_(one, three).count() == 0
    assert V.and_(one, two).count() == 1 and V.unless(one, two).count() == 0 and V.or_(one, two).count() == 1
